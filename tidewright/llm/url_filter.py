"""URL filters: rules first, then the likelihood ratio of two character language models.

Rules name a host and a path; a rule fits its host and all subdomains, if the URL's path starts with the rule's, and the
longest that fits decides. A URL that no rule fits is judged by two variable-order Markov models of characters, one of
accepted and one of rejected URLs, interpolated by Witten-Bell smoothing: the difference of their log-likelihoods,
divided by the URL's length, against a threshold that is calibrated on URLs which neither model was trained on.

The models count the characters of all distinct URLs that rules decide, but for a fifth of them, by hash, which calibrates; so
what they gather grows with the table. Counts are summed within tasks first. The contexts seen most often, up to a set number of
entries, are sent to all tasks; the rest stay in a table. Bytes that need one of those are looked up by joins, once for each
distinct window of context and byte, so every ratio is that of the whole models, however large they are.

Defined results: a null URL, or one without `://`, has host and path empty and fits no rule; null and empty URLs have
ratio 0. If rules decide no URL one way or the other, the ratio is 0 and the threshold 0, which allows. Repeated URLs count
once; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm import _common as C

_K = np.uint64(0xD6E8FEB86659FD93)
_BYTE = C.random_u64(257, 23)
VERDICTS = ("allow", "block")
#: Ratios are counted in bins, to find the threshold: so many between -RATIOS and RATIOS, and beyond as many as occur.
RATIOS, BINS = 12.0, 1 << 15
#: Windows that are common enough to be sent to all tasks instead of joined, at most.
COMMON = 1 << 16


def host_of(url: str = "url") -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case."""
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none. rules: (verdict, host and path)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class Markov:
    """Counts of characters after contexts of 0 to `order` bytes; every probability is mixed with that of the shorter context."""

    def __init__(self, order: int = 5):
        self.order = order
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []  # for each order: hashes of context and byte, counts
        self.contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # hashes of contexts, counts, kinds of next byte
        self.whole = True  # whether these are all contexts; if not, each of them still has all its pairs

    def _hashes(self, buf: np.ndarray, start: np.ndarray):
        """For each order, the hashes of the context before each byte, and of context and byte. A text begins with blanks."""
        context = np.full(len(buf), np.uint64(1))
        symbol = _BYTE[buf]
        for k in range(self.order + 1):
            if k:
                before = np.arange(len(buf)) - k
                context = context * _K + np.where(before >= start, _BYTE[buf[before]], _BYTE[256])
            yield context, C.mix64(context * _K + symbol)

    def counts(self, texts: list[bytes]):
        """(order, contexts, pairs, counts): what texts add, for each order; each pair of context and byte once."""
        buf, start, _ = _joined(texts)
        for k, (context, pair) in enumerate(self._hashes(buf, start)):
            keys, first, counts = np.unique(pair, return_index=True, return_counts=True)
            yield k, context[first], keys, counts

    def learn(self, found) -> Markov:
        """Sets the model to (order, contexts, pairs, counts) of every order; totals and kinds of a context are those of its pairs."""
        self.pairs, self.contexts = [], []
        for _, context, keys, counts in sorted(found, key=lambda x: x[0]):
            order = np.argsort(keys)
            contexts, at = np.unique(context, return_inverse=True)
            self.pairs.append((keys[order], counts[order]))
            self.contexts.append((contexts, np.bincount(at, counts, len(contexts)).astype(np.int64), np.bincount(at, minlength=len(contexts))))
        return self

    def train(self, texts: list[bytes]) -> Markov:
        return self.learn(self.counts(texts))

    def log_likelihood(self, texts: list[bytes]) -> np.ndarray:
        buf, start, doc = _joined(texts)
        p, _ = self.probabilities(len(buf), self._hashes(buf, start))
        return np.bincount(doc, weights=np.log(p), minlength=len(texts))

    def probabilities(self, size: int, hashes) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each byte, how many of its contexts are here, from the shortest on), given what _hashes() yields."""
        p, known = np.full(size, 1 / 256), np.zeros(size, np.int64)
        if self.pairs:
            for (context, pair), (keys, counts), (contexts, totals, kinds) in zip(hashes, self.pairs, self.contexts, strict=True):
                n, total, kind = _look_up(pair, keys, counts), _look_up(context, contexts, totals), _look_up(context, contexts, kinds)
                p = np.where(total > 0, (n + kind * p) / np.maximum(total + kind, 1), p)
                known += total > 0
        return p, known


def _look_up(h: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], 0)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lens) - lens
    return np.frombuffer(b"".join(texts), np.uint8), np.repeat(starts, lens), np.repeat(np.arange(len(texts)), lens)


@dataclass
class Judge:
    accepted: Markov
    rejected: Markov
    threshold: float
    trained: bool
    rest: DataFrame | None = None  # (v, k, context, total, kinds, next) of the contexts that the models lack, if they aren't whole

    @property
    def models(self) -> dict[str, Markov]:
        return dict(zip(VERDICTS, (self.accepted, self.rejected), strict=True))

    def ratios(self, texts: list[bytes]) -> np.ndarray:
        if not self.trained or not texts:
            return np.zeros(len(texts))
        lens = np.maximum([len(t) for t in texts], 1)
        return (self.accepted.log_likelihood(texts) - self.rejected.log_likelihood(texts)) / lens

    def opened(self, texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
        """(sum of the bytes' log ratios, the windows left out of it) of each text. A window is a byte that may have contexts in `rest`,
        after all of the text's bytes that its contexts reach; a shorter one begins the text."""
        buf, start, doc = _joined(texts)
        hashes, order = list(self.accepted._hashes(buf, start)), self.accepted.order
        p, is_open = {}, np.zeros(len(buf), bool)
        for v, model in self.models.items():
            p[v], known = model.probabilities(len(buf), hashes)
            if not model.whole:
                is_open |= known <= order
        sums = np.bincount(doc, weights=np.where(is_open, 0, np.log(p["allow"]) - np.log(p["block"])), minlength=len(texts))
        at = np.flatnonzero(is_open)
        first = np.maximum(start[at], at - order)
        ends = np.concatenate([[0], np.cumsum(at + 1 - first)])
        data = buf[np.repeat(first - ends[:-1], np.diff(ends)) + np.arange(ends[-1])]
        windows = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        lists = np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=len(texts)))])
        return sums, pa.ListArray.from_arrays(pa.array(lists, pa.int32()), windows)

    def wanted(self, windows: list[bytes]):
        """(verdict, order, which windows, their contexts, their pairs) to look up in `rest`, and before these the windows'
        probabilities by the contexts at hand, for each verdict."""
        buf, start, _ = _joined(windows)
        last = np.cumsum(np.array([len(w) for w in windows], np.int64)) - 1
        hashes = [(context[last], pair[last]) for context, pair in self.accepted._hashes(buf, start)]
        found = {v: model.probabilities(len(last), hashes) for v, model in self.models.items()}
        looks = []
        for v, model in self.models.items():
            for k, (context, pair) in enumerate(hashes):
                at = np.flatnonzero(found[v][1] <= k)
                if len(at) and not model.whole:
                    looks.append((v, k, at, context[at], pair[at]))
        return {v: p for v, (p, _) in found.items()}, looks


def calibrate(edges: np.ndarray, rejected: np.ndarray, accepted: np.ndarray) -> float:
    """The edge with the best mean of both classes' accuracies if what lies below it is rejected; the middle of the widest best stretch.

    rejected, accepted: how many URLs of each class lie between each edge and the next.
    """
    if not rejected.sum() or not accepted.sum():
        return 0.0
    good = np.concatenate([[0], np.cumsum(rejected)]) / rejected.sum() + 1 - np.concatenate([[0], np.cumsum(accepted)]) / accepted.sum()
    best = np.isclose(good, good.max())
    starts = np.flatnonzero(best & ~np.concatenate([[False], best[:-1]]))
    ends = np.flatnonzero(best & ~np.concatenate([best[1:], [False]]))
    k = int(np.argmax(ends - starts))
    return float((edges[starts[k]] + edges[ends[k]]) / 2)


def fit(pages: DataFrame, rules: list[tuple[str, str]], *, url: str = "url", order: int = 5, entries: int = 1 << 18) -> Judge:
    """Learns from all distinct URLs that the rules decide. entries: the most pairs of context and byte of a model that are sent to
    tasks; contexts beyond them, the rarest, stay in a table, the judge's `rest`."""
    spark = pages.sparkSession
    C.ship(spark)
    decided = pages.select(F.col(url).alias("u")).filter(F.length("u") > 0).distinct()
    decided = decided.select("u", matched_rule(host_of("u"), path_of("u"), rules)["verdict"].alias("v"), (F.pmod(F.xxhash64(F.lit("held back"), "u"), F.lit(5)) == 0).alias("held"))
    decided = C.as_table(decided.filter("v IS NOT NULL"), "decided", **{f"{v}_{k}": F.count_if((F.col("v") == v) & (F.col("held") == k)) for v in VERDICTS for k in (True, False)})
    none = Judge(Markov(order), Markov(order), 0.0, False)
    if not all(decided.measured[f"{v}_False"] for v in VERDICTS):
        return none
    learnt = T.StructType([T.StructField("v", T.StringType()), T.StructField("k", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("context", "pair", "n"))])

    def count(batches):
        for b in batches:
            urls, verdicts = [u.encode("utf-8", "replace") for u in b.column("u").to_pylist()], b.column("v").to_pylist()
            for v in VERDICTS:
                for k, context, pair, n in (x for some in pieces([u for u, x in zip(urls, verdicts, strict=True) if x == v]) for x in Markov(order).counts(some)):
                    yield pa.RecordBatch.from_arrays([pa.array([v] * len(n)), pa.array(np.full(len(n), k, np.int32)), pa.array(context.view(np.int64)), pa.array(pair.view(np.int64)), pa.array(n)], names=learnt.names)

    counts = C.map_arrow(decided.filter("NOT held").select("u", "v"), count, learnt).groupBy("v", "k", "pair").agg(F.first("context").alias("context"), F.sum("n").alias("n"))
    # a row for each context, with the bytes after it: 256 at most
    after = F.map_from_entries(F.collect_list(F.struct("pair", "n"))).alias("next")
    contexts = C.as_table(counts.groupBy("v", "k", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), after), "contexts")
    # the least count with which the pairs of a verdict's contexts are few enough; beyond 1000 it is exact to a thousandth. A context is
    # seen no more often than the shorter ones in it, so what is kept has those too
    often = F.when(F.col("total") < 1000, F.col("total")).otherwise(F.floor(F.log(F.col("total")) * 1000).cast("long") * 1_000_000)
    sizes = contexts.filter("k > 0").groupBy("v", often.alias("often")).agg(F.sum("kinds").alias("pairs")).collect()  # a row for each count
    models, rest = {}, F.lit(False)
    for v in VERDICTS:
        left, least, whole = entries, None, True
        for at, n in sorted(((r["often"], r["pairs"]) for r in sizes if r["v"] == v), reverse=True):
            left -= n
            if left < 0:
                whole = False
                break
            least = at
        here = (F.col("k") == 0) | ((often >= least) if least is not None else F.lit(False))
        kept = contexts.filter((F.col("v") == v) & here).select("k", "context", F.explode("next").alias("pair", "n")).toPandas()
        of = lambda k, kept=kept: kept[kept["k"] == k]
        models[v] = Markov(order).learn((k, of(k)["context"].to_numpy(np.int64).view(np.uint64), of(k)["pair"].to_numpy(np.int64).view(np.uint64), of(k)["n"].to_numpy(np.int64)) for k in range(order + 1))
        models[v].whole = whole
        if not whole:
            rest = rest | ((F.col("v") == v) & ~here)
    judge = Judge(models["allow"], models["block"], 0.0, True, None if all(m.whole for m in models.values()) else contexts.filter(rest))
    held = decided.filter("held") if all(decided.measured[f"{v}_True"] for v in VERDICTS) else decided
    place = F.floor((F.col("ratio") + RATIOS) / (2 * RATIOS) * BINS).cast("long").alias("bin")
    bins = with_ratios(held.select("u", "v"), "u", judge).groupBy("v", place).count().collect()  # two rows a bin at most
    low, high = min(0, *(r["bin"] for r in bins)), max(BINS, *(r["bin"] + 1 for r in bins))
    found = {v: np.zeros(high - low, np.int64) for v in VERDICTS}
    for r in bins:
        found[r["v"]][r["bin"] - low] = r["count"]
    judge.threshold = calibrate(-RATIOS + np.arange(low, high + 1) * (2 * RATIOS / BINS), found["block"], found["allow"])
    return judge


def pieces(urls: list[bytes]):
    """Runs of urls with about C.CHUNK_BYTES each; a longer one alone."""
    ends = np.concatenate([[0], np.cumsum([len(u) for u in urls])])
    for i, j in C.chunks(ends):
        yield urls[i:j]


def ratios_of(model: Judge, urls: list[bytes]) -> np.ndarray:
    """model.ratios() in pieces of bounded size."""
    return np.concatenate([np.zeros(0), *(model.ratios(some) for some in pieces(urls))])


def with_ratios(rows: DataFrame, url: str, judge: Judge) -> DataFrame:
    """rows without url, and with ratio."""
    others = [c for c in rows.columns if c != url]
    fields = [rows.schema[c] for c in others]
    shared = rows.sparkSession.sparkContext.broadcast(replace(judge, rest=None))  # bounded by fit()'s entries
    texts = lambda b: [(u or "").encode("utf-8", "replace") for u in b.column(url).to_pylist()]
    if judge.rest is None:
        schema = T.StructType([*fields, T.StructField("ratio", T.DoubleType())])

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(ratios_of(shared.value, texts(b)))], names=schema.names)

        return C.map_arrow(rows, run, schema)
    opened = T.StructType([*fields, T.StructField("_size", T.LongType()), T.StructField("_sum", T.DoubleType()), T.StructField("_open", T.ArrayType(T.BinaryType()))])

    def run_opened(batches):
        for b in batches:
            urls = texts(b)
            sizes = np.array([len(u) for u in urls], np.int64)
            for i, j in C.chunks(np.concatenate([[0], np.cumsum(sizes)])):
                sums, windows = shared.value.opened(urls[i:j])
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in others), pa.array(sizes[i:j]), pa.array(sums), windows], names=opened.names)

    table = C.with_row(C.as_table(C.map_arrow(rows, run_opened, opened), "opened"))
    windows = table.select("_row", F.explode("_open").alias("_w"))
    counted = C.as_table(windows.groupBy("_w").agg(F.count(F.lit(1)).alias("_times")), "windows", places=F.sum("_times"))
    least = counted.measured["places"] // COMMON + 1  # at most COMMON windows are so common
    values = C.as_table(_log_ratios(counted.select("_w"), judge, shared).join(counted, "_w"), "values")
    common, others_ = values.filter(F.col("_times") >= least), values.filter(F.col("_times") < least)
    found = windows.join(F.broadcast(common), "_w").unionByName(windows.join(F.broadcast(common.select("_w")), "_w", "left_anti").join(others_, "_w"))
    # as decimals, so that the sum of a text doesn't depend on the order of its windows
    sums = found.groupBy("_row").agg(F.sum(F.col("_value").cast("decimal(28,18)")).cast("double").alias("_more"))
    ratio = (F.col("_sum") + F.coalesce("_more", F.lit(0.0))) / F.greatest("_size", F.lit(1))
    return table.select("_row", *others, "_size", "_sum").join(sums, "_row", "left").select(*others, ratio.alias("ratio"))


def _log_ratios(windows: DataFrame, judge: Judge, shared) -> DataFrame:
    """(_w, _value): the log ratio of the last byte of each distinct window, with the contexts of judge.rest."""
    schema = "_w binary, p_allow double, p_block double, v string, k int, context long, pair long"

    def run(batches):
        for b in batches:
            p, looks = shared.value.wanted(b.column("_w").to_pylist())
            for v, k, at, context, pair in looks:
                which = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column("_w").take(which), *(pa.array(p[x][at]) for x in VERDICTS), pa.array([v] * len(at), pa.string()), pa.array(np.full(len(at), k, np.int32)), pa.array(context.view(np.int64)), pa.array(pair.view(np.int64))], names=["_w", "p_allow", "p_block", "v", "k", "context", "pair"])

    seen = C.map_arrow(windows, run, schema).join(judge.rest, ["v", "k", "context"], "left")
    step = F.struct("k", F.coalesce(F.try_element_at("next", F.col("pair")), F.lit(0)).alias("n"), "total", "kinds")
    steps = lambda v: F.array_sort(F.collect_list(F.when((F.col("v") == v) & F.col("total").isNotNull(), step)))
    seen = seen.groupBy("_w").agg(*(F.first(f"p_{v}").alias(f"p_{v}") for v in VERDICTS), *(steps(v).alias(f"s_{v}") for v in VERDICTS))
    mixed = lambda v: F.aggregate(f"s_{v}", F.col(f"p_{v}"), lambda p, s: (s["n"] + s["kinds"] * p) / (s["total"] + s["kinds"]))
    return seen.select("_w", (F.log(mixed("allow")) - F.log(mixed("block"))).alias("_value"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], model: Judge, *, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, and ratio of every row."""
    source = pages.select(key, F.col(url).alias("_url"), host_of(url).alias("host"), path_of(url).alias("path"), matched_rule(host_of(url), path_of(url), rules).alias("_rule"))
    source = source.select(key, "_url", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("_verdict"))
    judged = with_ratios(source, "_url", model)
    verdict = F.coalesce("_verdict", F.when(F.col("ratio") >= model.threshold, "allow").otherwise("block"))
    return judged.select(key, "host", "path", "rule", verdict.alias("verdict"), "ratio")
