"""Mixing sources to target weights: balanced sampling by the cube method.

Each source has a target, its share of all words by weight, but at most `most_repeats` times its own words, the excess
being shared among the others by weight. A document of a source with target / words = r is taken floor(r) times for
certain and once more with the fractional part as its inclusion probability. The cube method draws these: a flight
moves the probabilities of three documents at a time along the null space of two constraints, the number of documents
and the number of words, until all but two are 0 or 1. It runs in chunks of a source, by hash of the key; what the chunks
leave over, two documents each, flies again in groups of chunks, level by level, until each source has one small
landing problem of two documents at most. What their rounding misses is made good by exchanging documents of the
source, whichever flight settled them. No source is gathered in one task, however large.

Long documents fly first, so that those left to land are short. Randomness is seeded by source, chunk and level, and
rows of one size are ordered by a hash of the key, then by their place in the table, so reruns agree.

Defined results: null and empty texts have size 0 and take no word; a null source is a source of its own, last in
order; a repeated row is a document of its own; sources of no words have target 0; an empty table gives no row.
"""

from __future__ import annotations

import bisect
import functools
import math
import operator
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm import _common as C

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a chunk on the first level, and chunks of a group on the next ones.
CHUNK, GROUP = 1024, 256
#: Sources up to which their totals are broadcast, and sources of a range when they are put in order.
BROADCAST_SOURCES, RANGE_ROWS = 50_000, 1_000_000


def _running(rows: DataFrame, n: int, order: list, before: dict, name: str) -> DataFrame:
    """The n rows with, for each name in before, the sum of that column over all rows that stand before it in the order.

    More than RANGE_ROWS rows are dealt out by ranges of the order, so many in each: a window within a range, and one over the ranges' totals.
    """
    if n <= RANGE_ROWS:
        whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({k: F.coalesce(F.sum(c).over(whole), F.lit(0)) for k, c in before.items()})
    dealt = rows.repartitionByRange(-(-n // RANGE_ROWS), *order).withColumn("_part", F.spark_partition_id())
    dealt = C.as_table(dealt, name)
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(*(F.sum(c).alias(f"_{k}") for k, c in before.items()))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for RANGE_ROWS sources
    parts = parts.select("_part", *(F.coalesce(F.sum(f"_{k}").over(ahead), F.lit(0)).alias(f"_{k}") for k in before))
    inner = dealt.withColumns({k: F.coalesce(F.sum(c).over(within), F.lit(0)) for k, c in before.items()})
    return inner.join(F.broadcast(parts), "_part").select(*rows.columns, *((F.col(k) + F.col(f"_{k}")).alias(k) for k in before))


def targets(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), most_repeats: int = 3) -> DataFrame:
    """source, n_docs, source_size and target of rows (source, size).

    Water filling in closed form: by rising ratio of cap to weight, the first source that the water left over by the
    capped ones before it doesn't fill sets the level for itself and all after it.
    """
    by_source = C.as_table(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").cast("long").alias("source_size")), "sources", words=F.sum("source_size"), n=F.count(F.lit(1)))
    words, n = by_source.measured["words"] or 0, by_source.measured["n"]
    ranked = _running(by_source, n, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long")}, "ranked")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    filled = ranked.withColumn("weight", weight).withColumn("cap", (most_repeats * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = C.as_table(_running(filled, n, [F.col("ratio"), F.col("rank")], {"caps": F.col("cap"), "weights": F.col("weight")}, "filled"), "filled", weights=F.sum("weight"))
    all_weights = filled.measured["weights"] or 0.0
    level = (F.lit(float(words)) - F.col("caps")) / (F.lit(all_weights) - F.col("weights"))
    # from the first source that isn't capped on, its level holds
    free = filled.withColumn("level", level).filter(F.col("level") * F.col("weight") < F.col("cap"))
    final = free.agg(F.min(F.struct("ratio", "rank", "level"))["level"]).first()[0]
    target = F.col("cap") if final is None else F.least(F.col("cap"), F.lit(final) * F.col("weight"))
    return filled.select("source", "n_docs", "source_size", target.alias("target"))


def fly(p: list[float], size: list[int], draw: random.Random) -> list[float]:
    """The flight: moves the probabilities p, keeping their sum and the sum of p times size, until two at most are fractional."""
    p = list(p)
    active: list[int] = []
    for i in range(len(p) + 1):
        while len(active) == 3:
            a, b, c = active
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if u == (0, 0, 0):
                u = (1, -1, 0)
            up = down = math.inf
            for k, d in zip(active, u, strict=True):
                if d > 0:
                    up, down = min(up, (1 - p[k]) / d), min(down, p[k] / d)
                elif d < 0:
                    up, down = min(up, p[k] / -d), min(down, (1 - p[k]) / -d)
            step = up if draw.random() * (up + down) < down else -down
            for k, d in zip(active, u, strict=True):
                p[k] += step * d
                if p[k] < 1e-9:
                    p[k] = 0.0
                elif p[k] > 1 - 1e-9:
                    p[k] = 1.0
            active = [k for k in active if 0 < p[k] < 1]
        if i < len(p) and 0 < p[i] < 1:
            active.append(i)
    return p


def land(p: list[float], size: list[int]) -> list[float]:
    """Settles the last documents: the choice whose words, then documents, come nearest to the fractional ones."""
    best = [()]
    for _ in p:
        best = [(*x, y) for x in best for y in (0.0, 1.0)]
    words, docs = sum(a * b for a, b in zip(p, size, strict=True)), sum(p)
    return list(min(best, key=lambda x: (abs(sum(a * b for a, b in zip(x, size, strict=True)) - words), abs(sum(x) - docs), x)))


def exchanges(size: Sequence[int], left_out: Sequence[int], taken: Sequence[int], words: float) -> list[int]:
    """Of settled documents counted by size, how many to take in (above 0) or leave out (below 0) so that their words come near to `words`.

    Each time those are exchanged that bring the words nearest, until none does. Then one more than that is exchanged, which may miss by
    more, if what others can make good after it ends nearer. Documents of size 0 change nothing.
    """

    def settle(free: list[dict[int, int]], miss: float) -> float:
        # free: by size, the documents that can be taken in, and those that can be left out
        order = [sorted(f) for f in free]
        while miss:
            way, far = int(miss < 0), abs(miss)
            at = bisect.bisect_right(order[way], far)
            near = order[way][max(at - 1, 0) : at + 1]
            s = min(near, key=lambda x: (abs(far - x), x), default=0)
            if not s or abs(far - s) >= far:
                break
            k = min(free[way][s], max(1, int(far // s)))
            move(free, order, way, s, k)
            miss -= -k * s if way else k * s
        return miss

    def move(free: list[dict[int, int]], order: list[list[int]], way: int, s: int, k: int) -> None:
        free[way][s] -= k
        if not free[way][s]:
            del free[way][s]
            del order[way][bisect.bisect_left(order[way], s)]
        if s not in free[1 - way]:
            bisect.insort(order[1 - way], s)
        free[1 - way][s] = free[1 - way].get(s, 0) + k

    free = [{s: n for s, n in zip(size, count, strict=True) if s > 0 and n > 0} for count in (left_out, taken)]
    miss = settle(free, words - sum(s * n for s, n in free[1].items()))
    while abs(miss) >= 1:
        way = int(miss < 0)
        s = min((x for x in free[way] if x >= abs(miss)), default=None)
        if s is None:
            break
        other = [dict(f) for f in free]
        move(other, [sorted(f) for f in other], way, s, 1)
        back = other[1 - way].pop(s)  # this one is not to be exchanged back
        after = settle(other, miss + s if way else miss - s)
        other[1 - way][s] = other[1 - way].get(s, 0) + back
        if abs(after) >= abs(miss):
            break
        free, miss = other, after
    return [free[1].get(s, 0) - n if s > 0 else 0 for s, n in zip(size, taken, strict=True)]


def exchange(p: list[float], size: list[int], words: float) -> list[float]:
    """Settled documents with those taken in or left out that `exchanges` names, the first of each size."""
    sizes = sorted(set(size))
    count = [[sum(a == s and b == x for a, b in zip(size, p, strict=True)) for s in sizes] for x in (0.0, 1.0)]
    todo = dict(zip(sizes, exchanges(sizes, *count, words), strict=True))
    p = list(p)
    for i, s in enumerate(size):
        if todo[s] > 0 and p[i] == 0.0 or todo[s] < 0 and p[i] == 1.0:
            todo[s] += 1 if p[i] else -1
            p[i] = 1.0 - p[i]
    return p


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), most_repeats: int = 3, seed: int = 0, row: str | None = None) -> DataFrame:
    """For each row of docs: key, row, source, size, source_size, target, copies and taken (copies times size).

    row: the column of C.with_row(), if docs has it.
    """
    spark = docs.sparkSession
    if row is None:
        row = C.fresh(docs, "_row")
        docs = C.with_row(docs, row)
    rows = C.as_table(docs.select(F.col(key).alias("key"), F.col(row).alias("row"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    aims = C.as_table(targets(rows, weights, most_repeats), "targets")
    stats = aims.agg(F.count(F.lit(1)), F.max("n_docs")).first()
    small = F.broadcast(aims) if stats[0] <= BROADCAST_SOURCES else aims
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    joined = rows.alias("r").join(small.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("key", "row", "r.source", "size", "source_size", "target", rate.alias("rate"), F.ceil(F.col("n_docs") / CHUNK).alias("chunks"))
    hashed = F.xxhash64(F.lit(seed), F.col("key").cast("string"))
    todo = joined.withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.floor("rate")).drop("rate")
    todo = _dealt(todo.withColumn("chunk", F.pmod(hashed, F.col("chunks"))).withColumn("hash", hashed).withColumn("tie", F.xxhash64("row")))
    todo = todo.withColumn("bucket", F.col("chunk"))
    schema = todo.schema
    C.ship(spark)

    def flight(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            # long documents first, so that those left for the landing are short
            pdf = pdf.sort_values(["size", "hash", "tie"], ascending=[False, True, True], kind="stable")
            first = pdf.iloc[0]
            p, size = pdf["p"].tolist(), pdf["size"].tolist()
            p = fly(p, size, random.Random(f"{seed} {first['source']!r} {first['chunk']} {level}"))
            if first["chunks"] <= 1:  # the last flight of this source
                left = [i for i, x in enumerate(p) if 0 < x < 1]
                for i, x in zip(left, land([p[i] for i in left], [size[i] for i in left]), strict=True):
                    p[i] = x
            return pdf.assign(p=p)[schema.names]

        return run

    done, level, most = [], 0, -(-(stats[1] or 0) // CHUNK)
    while True:
        flown = C.as_table(todo.groupBy("source", "chunk").applyInPandas(flight(level), schema), "flight")
        settled = (F.col("p") <= 0) | (F.col("p") >= 1)
        done.append(flown.filter(settled))
        if most <= 1:
            break
        level, most = level + 1, -(-most // GROUP)
        todo = flown.filter(~settled).withColumn("chunk", F.floor(F.col("chunk") / GROUP)).withColumn("chunks", F.ceil(F.col("chunks") / GROUP))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    out = _exchanged(out)
    copies = (F.col("whole") + F.col("p")).cast("long")
    return out.select(F.col("key").alias(key), "row", F.col("source").alias(source), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _dealt(todo: DataFrame) -> DataFrame:
    """todo with chunks of about CHUNK rows: rows of a key that repeats too often, or is null, are dealt out by their own place."""
    sizes = C.as_table(todo.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("here")).filter(F.col("here") > 4 * CHUNK), "crowded", n=F.count(F.lit(1)))
    if not sizes.measured["n"]:
        return todo
    joined = todo.alias("a").join(sizes.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.chunk") == F.col("b.chunk")), "left")
    chunk = F.when(F.col("b.here").isNotNull(), F.pmod("a.tie", "a.chunks")).otherwise(F.col("a.chunk"))
    return joined.select(*(chunk.alias(c) if c == "chunk" else f"a.{c}" for c in todo.columns))


def _exchanged(landed: DataFrame) -> DataFrame:
    """The settled documents of all flights, with those exchanged that make good what the landing missed.

    A task sees a source as counts by size; sizes that differ are at most about the square root of twice its words. Which
    documents of a size are exchanged goes by the hash of the key, ranked within first chunks and summed over them.
    """
    same = lambda a, b, *names: functools.reduce(operator.and_, (F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names))
    counts = landed.filter("size > 0").groupBy("source", "size").agg(
        F.sum(F.when(F.col("p") <= 0, 1).otherwise(0)).alias("left_out"), F.sum(F.when(F.col("p") >= 1, 1).otherwise(0)).alias("taken"), F.first(F.col("target") - F.col("whole") * F.col("source_size")).alias("words")
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        pdf["n"] = exchanges(pdf["size"].tolist(), pdf["left_out"].tolist(), pdf["taken"].tolist(), float(pdf["words"].iloc[0]))
        pdf = pdf[pdf["n"] != 0]
        return pdf.assign(p=(pdf["n"] < 0).astype(float), n=pdf["n"].abs())[["source", "size", "p", "n"]]

    schema = T.StructType([landed.schema["source"], *(T.StructField(n, t) for n, t in (("size", T.LongType()), ("p", T.DoubleType()), ("n", T.LongType())))])
    moves = C.as_table(counts.groupBy("source").applyInPandas(run, schema), "moves")
    many = moves.count()
    if not many:
        return landed
    small = F.broadcast(moves) if many <= BROADCAST_SOURCES else moves
    marked = landed.alias("a").join(small.alias("b"), same("a", "b", "source", "size", "p"), "left").select("a.*", "b.n")
    group = ["source", "size", "p"]
    some = marked.filter("n IS NOT NULL")
    before = F.coalesce(F.sum("here").over(Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = some.groupBy(*group, "bucket", "n").agg(F.count(F.lit(1)).alias("here")).withColumn("left", F.col("n") - before).filter("left > 0")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy(*group, "bucket").orderBy("hash", "tie", "row")))
    turned = ranked.alias("a").join(chosen.alias("b"), same("a", "b", *group, "bucket"), "left").select("a.*", "b.left")
    turned = turned.withColumn("p", F.when(F.col("rank") <= F.col("left"), 1 - F.col("p")).otherwise(F.col("p")))
    return marked.filter("n IS NULL").select(*landed.columns).unionByName(turned.select(*landed.columns))


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as the mix takes it; rows that it takes no time go."""
    names = docs.columns
    row, copy = C.fresh(docs, "_row"), C.fresh(docs, "_copy")
    docs = C.with_row(docs, row)
    copies = mix(docs, row=row, **how).filter("copies > 0").select(F.col("row").alias(row), F.sequence(F.lit(1), F.col("copies").cast("int")).alias(copy))
    return docs.join(copies, row).withColumn(copy, F.explode(copy)).select(*names)
