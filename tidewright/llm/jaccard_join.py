"""N-gram Jaccard join by a token-group matrix: bound a query against a group's token union, open only groups that qualify.

A document's set is its distinct 5-word shingles, with fewer words the whole sequence as one. Words are hashed by mixing their bytes
eight at a time, very long ones by XXH3, and shingles by mixing the words' hashes one after the other, to 64 bits each: for two sets of 100,000 shingles the chance that one shingle passes
for another is about 1 in 10^9.

1. Equal sets become one node, by a 128-bit sum over the set.
2. A sketch counts the shingles of all documents; its cells follow the table's size up to a bound. Shingles are ordered by its
   counts, rare ones first; any order that all share keeps prefix filtering exact, so the sketch's errors cost time, never a link.
3. Each node sends its prefix: two sets that link share a shingle of the larger one's probing and the smaller one's
   indexing prefix. Shingles that one node alone sends are dropped at once.
4. Partition: a node joins the group of the node with which it shares most prefix shingles, as leader; groups are cut
   into chunks of bounded members and shingles. Members are compared with their leader; those that link to it share its component.
5. Token-group matrix: (shingle, group) over the unions of the members' prefixes. Pairs of groups that share entries, fit in
   size and are not known to be one component are bounded: the entries that they share, and the most that can lie beyond
   the prefixes, against the overlap that a link of their sizes asks for. A shingle of very many groups is dealt out in
   blocks of groups, and pairs two groups only where it lies in an indexing prefix; elsewhere it is counted as shared.
6. Only qualifying pairs are opened. In them, each set is bounded once more against the union of the whole sets of the
   other group, and only sets of different components are compared, exactly.

A large group of near copies meets in its leaders, so its pairs are never enumerated; chunks bound what a task holds, and
frequent shingles are salted. Links within and between components are complete as far as components go: every two sets that
link get the same component_id. Texts are read again where sets are compared; a filter of the wanted rows lets only
those through to the shuffle.

Defined results: null and empty texts, and texts without words, have the empty set, which links with nothing; a repeated row
shares its copy's component; component_id is the smallest key, null keys last; an empty table gives no row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm import _common as C
from tidewright.llm.components import components

SHINGLE = 5
#: Cells of the sketch, least and most as powers of two, and bytes of the table's files for each cell; cells of a block of it.
LEAST_SKETCH_BITS, MOST_SKETCH_BITS, BYTES_A_CELL, BLOCK_BITS = 22, 25, 64, 16
#: Members and shingles of a group's chunk; prefix rows of a partition.
CHUNK, CHUNK_TOKENS, PARTITION_ROWS = 64, 200_000, 1_000_000
#: Occurrences of a shingle beyond which its list is salted, and rows of a salted list.
HOT, SALTED = 4000, 1000
#: Groups of a shingle that meet in one task; it is dealt out in blocks beyond.
BLOCK_GROUPS = 512
#: Sums that name several sets and are sent to all tasks; of 10^12 documents some 27,000 are expected.
MOST_CLASHES = 1_000_000

_K = np.uint64(0xA0761D6478BD642F | 1)
_LOWER = C.ascii_lower_table()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LANE = np.uint64(0xE7037ED1A0B428DB)
#: Masks of the first 0 to 8 bytes, and the bytes of a word beyond which it is hashed as a whole.
_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
LONG_WORD = 256


def _word_hashes(buf: np.ndarray, ink: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each word in lower case: eight bytes at a time are mixed in; very long words are hashed by XXH3."""
    letters = np.zeros(int(lengths.sum()) + 8, np.uint8)
    letters[:-8] = _LOWER[buf[ink]]
    at = np.cumsum(lengths) - lengths
    lanes = np.ndarray(len(letters) - 7, "<u8", letters, strides=(1,))  # the eight bytes from each place on
    h = C.mix64((lanes[at] & _BYTES[np.minimum(lengths, 8)]) ^ (lengths.astype(np.uint64) * _LANE))
    done, left = 8, np.flatnonzero(lengths > 8)
    while len(left) and done < LONG_WORD:
        n = lengths[left] - done
        h[left] = C.mix64((h[left] * _K) ^ (lanes[at[left] + done] & _BYTES[np.minimum(n, 8)]))
        done += 8
        left = left[n > 8]
    if len(left):
        import xxhash

        for i in left.tolist():
            h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(letters[at[i] : at[i] + lengths[i]]))
    return h


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): hashes[bounds[i]:bounds[i + 1]] are document i's distinct shingles, sorted."""
    n_docs, n = len(offsets) - 1, len(buf)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    ink = ~_SPACE[buf]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    starts, ends = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0] - 1
    first[starts] |= ink[starts]
    last[ends] |= ink[ends]
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    word = _word_hashes(buf, ink, end - begin + 1)
    doc = np.searchsorted(offsets, begin, "right") - 1
    words = np.bincount(doc, minlength=n_docs)
    ahead = np.cumsum(words) - words
    h = C.mix64(word)
    for k in range(1, min(shingle, len(word))):
        h[: len(h) - k] = C.mix64(h[: len(h) - k] * _K + word[k:])
    whole = np.arange(len(word)) - ahead[doc] <= words[doc] - shingle
    few = np.flatnonzero((words > 0) & (words < shingle))  # the whole sequence as one
    if len(few):
        x = C.mix64(words[few].astype(np.uint64) * _LANE)
        for k in range(shingle - 1):
            on = words[few] > k
            x[on] = C.mix64(x[on] * _K + word[ahead[few[on]] + k])
        h[ahead[few]] = x
        whole[ahead[few]] = True
    h, doc = h[whole], doc[whole]
    count = np.bincount(doc, minlength=n_docs)
    bounds = np.concatenate([[0], np.cumsum(count)])
    for i in np.flatnonzero(count > 1):
        h[bounds[i] : bounds[i + 1]].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[fresh], np.concatenate([[0], np.cumsum(np.bincount(doc[fresh], minlength=n_docs))])


def _lanes(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set; 0 for an empty one."""
    out = []
    for salt in (np.uint64(0), _LANE):
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix64(tokens ^ salt))])
        out.append(s[bounds[1:]] - s[bounds[:-1]])
    return out[0], out[1]


def _renamed(a: np.ndarray, b: np.ndarray, again: int) -> np.ndarray:
    return C.mix64(a ^ (b * _K) ^ np.uint64(again))


def _ids(tokens: np.ndarray, bounds: np.ndarray, clashing: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A node id for each set, and its second sum. clashing: ids that name several sets, for each time of naming anew. bits: of the first sum."""
    a, b = _lanes(tokens, bounds)
    a = a >> np.uint64(64 - bits)
    for again, some in enumerate(clashing):
        a = np.where(np.isin(a, some), _renamed(a, b, again), a)
    return a, b


def need(a, b, percent: int):
    """The least overlap with which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def _read(batch, text: str):
    buf, offsets = C.utf8(batch.column(text))
    for i, j in C.chunks(offsets):
        yield i, j, *shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def sketch_bits(docs: DataFrame) -> int:
    """Cells of the sketch as a power of two, from the bytes that Spark expects to read."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_SKETCH_BITS, max(LEAST_SKETCH_BITS, (size // BYTES_A_CELL).bit_length()))


class Sketch:
    """Counts of a task's shingles by their first bits. It is handed on whenever a counter might run over, so no count is cut off."""

    def __init__(self, bits: int):
        self.bits, self.counts, self.most = bits, np.zeros(1 << bits, np.uint16), 0

    def add(self, tokens: np.ndarray):
        """Blocks to hand on, if there are any before these shingles can be counted."""
        at, times = np.unique(tokens >> np.uint64(64 - self.bits), return_counts=True)
        most = int(times.max(initial=0))
        if self.most + most > 65_535:
            yield from self.blocks()
        while most > 65_535:  # as many as fit, again and again
            self.counts[at] = np.minimum(times, 65_535)
            times = times - self.counts[at]
            most = int(times.max())
            self.most = 65_535
            yield from self.blocks()
        self.counts[at] += times.astype(np.uint16)
        self.most += most

    def blocks(self):
        if self.most:
            for i, x in enumerate(self.counts.reshape(-1, 1 << BLOCK_BITS)):
                if x.any():
                    yield i, zlib.compress(x.tobytes(), 1)
            self.counts[:] = 0
            self.most = 0


def _pieces(docs: DataFrame, key: str, text: str, bits: int, cells: int) -> tuple[DataFrame, DataFrame, dict]:
    """(rows: row, key, n, node, lane of every document; sketch: block, part, counts; how many shingles and blocks)."""
    source = docs.select(F.col("_row").alias("row"), F.col(key).alias("key"), text)
    schema = T.StructType([T.StructField("row", source.schema["row"].dataType), T.StructField("key", source.schema["key"].dataType), *(T.StructField(c, T.LongType()) for c in ("n", "node", "lane")), T.StructField("block", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("counts", T.BinaryType())])

    def run(batches):
        from pyspark import TaskContext

        sketch, part, kinds = Sketch(cells), TaskContext.get().partitionId(), None

        def handed_on(blocks):
            for i, x in blocks:
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, kind) for kind in kinds), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([x], pa.binary())], names=schema.names)

        for b in batches:
            n, node, lane = [], [], []
            kinds = (b.column("row").type, b.column("key").type)
            for _, _, tokens, bounds in _read(b, text):
                x, y = _ids(tokens, bounds, [], bits)
                n.append(np.diff(bounds))
                node.append(x.view(np.int64))
                lane.append(y.view(np.int64))
                yield from handed_on(sketch.add(tokens))
            k = b.num_rows
            cols = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (n, node, lane)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("key"), *cols, pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=schema.names)
        yield from handed_on(sketch.blocks())

    table = C.as_table(C.map_arrow(source, run, schema), "sets", total=F.coalesce(F.sum("n"), F.lit(0)), blocks=F.count("block"))
    return table.filter("block is null").drop("block", "part", "counts"), table.filter("block is not null").select("block", "part", "counts"), table.measured


def _levels(sketch: DataFrame, cells: int, blocks: int) -> np.ndarray:
    """The sketch's sums, as 4 log2(1 + count) in a byte for each cell: 32 MB at most."""

    def add(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(1 << BLOCK_BITS, np.int64)
            for x in pdf["counts"]:
                x = zlib.decompress(x)
                total += np.frombuffer(x, np.uint16 if len(x) == 2 << BLOCK_BITS else np.int64)
            data = np.minimum(255, np.floor(4 * np.log2(1.0 + total))).astype(np.uint8) if last else total
            return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": [int(pdf["part"].iloc[0])], "counts": [zlib.compress(data.tobytes(), 1)]})

        return run

    schema = "block int, part int, counts binary"
    each = blocks >> (cells - BLOCK_BITS)
    if each > 1000:  # in two steps, so that no task gathers the blocks of all others
        sketch = sketch.withColumn("part", F.pmod("part", F.lit(int(each**0.5)))).groupBy("block", "part").applyInPandas(add(False), schema)
    out = np.zeros((1 << (cells - BLOCK_BITS), 1 << BLOCK_BITS), np.uint8)
    for block, _, counts in sketch.groupBy("block").applyInPandas(add(True), schema).collect():
        out[block] = np.frombuffer(zlib.decompress(counts), np.uint8)
    return out.ravel()


def _prefixes(docs: DataFrame, text: str, levels: np.ndarray, clashing: list[np.ndarray], percent: int, hot_level: int, bits: int) -> DataFrame:
    """(token, salt, node, info): the probing prefix of each set; info is 2 n, plus 1 in the indexing prefix."""
    source = docs.select(text)
    shared = docs.sparkSession.sparkContext.broadcast((levels, clashing))  # bounded by MOST_SKETCH_BITS and MOST_CLASHES
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("token", "salt", "node", "info")])

    def run(batches):
        levels, clashing = shared.value
        cells = np.uint64(len(levels).bit_length() - 1)
        seen: set[int] = set()
        for b in batches:
            for _, _, tokens, bounds in _read(b, text):
                node, _ = _ids(tokens, bounds, clashing, bits)
                level = levels[tokens >> (np.uint64(64) - cells)]
                order = (level.astype(np.uint64) << np.uint64(56)) | (tokens >> np.uint64(8))
                out = [[], [], [], []]
                for i, x in enumerate(node.tolist()):
                    n = int(bounds[i + 1] - bounds[i])
                    if n == 0 or x in seen:
                        continue
                    seen.add(x)
                    probe, index = n - need_probe(n, percent) + 1, n - need(n, n, percent) + 1
                    part = slice(bounds[i], bounds[i + 1])
                    at = np.argsort(order[part], kind="stable")[:probe]
                    info = np.full(probe, 2 * n, np.int64)
                    info[:index] += 1
                    lv = level[part][at]
                    salts = np.where(lv > hot_level, np.exp2(lv / 4.0) // SALTED + 1, 0).astype(np.int64)
                    salt = np.where(salts > 0, 1 + (x >> 7) % np.maximum(salts, 1), 0)  # 0: not salted
                    for o, v in zip(out, (tokens[part][at].view(np.int64), salt, np.full(probe, x, np.uint64).view(np.int64), info), strict=True):
                        o.append(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=schema.names)

    return C.map_arrow(source, run, schema)


def need_probe(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _shared(prefixes: DataFrame, partitions: int, percent: int) -> DataFrame:
    """(token, node, n, indexed, leader, leader_n, hot) of the entries whose token another node sends too.

    leader: the first node of the same token and band of sizes, null for itself. Lists of salted tokens are kept whole.
    """
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("token", "node", "n", "leader", "leader_n")] + [T.StructField("indexed", T.BooleanType()), T.StructField("hot", T.BooleanType())])
    ratio = np.log(100 / percent) if percent < 100 else 1.0

    def run(batches):
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        token, salt, node, info = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((node, info >> 1, salt, token))
        token, salt, node, info = token[order], salt[order], node[order], info[order]
        # a node whose copies lie in several tasks comes more than once
        same = np.concatenate([[False], (token[1:] == token[:-1]) & (node[1:] == node[:-1])])
        token, salt, node, info = token[~same], salt[~same], node[~same], info[~same]
        n, indexed = info >> 1, (info & 1).astype(bool)
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        keep = (size > 1)[group]
        # salted tokens keep even lone entries: their other entries lie elsewhere
        multi = salt > 0
        keep |= multi
        band = np.floor(np.log(n) / ratio).astype(np.int64)
        start = new | np.concatenate([[True], band[1:] != band[:-1]])
        head = np.maximum.accumulate(np.where(start, np.arange(len(token)), 0))
        leader = node[head]
        alone = leader == node
        for i in range(0, len(token), 100_000):
            s = slice(i, i + 100_000)
            k = keep[s]
            if k.any():
                yield pa.RecordBatch.from_arrays([pa.array(token[s][k]), pa.array(node[s][k]), pa.array(n[s][k]), pa.array(leader[s][k], mask=alone[s][k]), pa.array(n[head[s]][k], mask=alone[s][k]), pa.array(indexed[s][k]), pa.array(multi[s][k])], names=schema.names)

    return C.map_arrow(prefixes.repartition(partitions, "token", "salt"), run, schema)


def _compare_with_leaders(members: DataFrame, percent: int) -> DataFrame:
    """members (chunk, node, leads, toks): edges (u, v) between a chunk's leader and the members that link to it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lead = pdf[pdf["leads"]]
        if not len(lead):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        base, first = np.asarray(lead["toks"].iloc[0]), lead["node"].iloc[0]
        rest = pdf[~pdf["leads"]]
        linked = [np.intersect1d(base, t, assume_unique=True).size >= need(len(base), len(t), percent) for t in rest["toks"]]
        return pd.DataFrame({"u": rest["node"][linked].astype("int64"), "v": np.int64(first)})

    return members.groupBy("chunk").applyInPandas(run, "u long, v long")


def open_groups(pdf: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Edges that join different components of a pair of groups. pdf: side, node, component, toks."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sides = [[(int(r.node), int(r.component), np.asarray(r.toks)) for r in pdf[pdf["side"] == s].itertuples()] for s in (0, 1)]
    own = not sides[1]
    group, queries = sides[0], sides[0] if own else sides[1]
    if not group:
        return []
    union = np.unique(np.concatenate([t for *_, t in group]))
    sizes = np.array([len(t) for *_, t in group])
    edges = []
    for i, (q, qc, tokens) in enumerate(queries):
        fits = (100 * np.minimum(sizes, len(tokens)) >= percent * np.maximum(sizes, len(tokens)))
        if own:
            fits[: i + 1] = False
        if not fits.any():
            continue
        bound = len(tokens) if own else np.intersect1d(tokens, union, assume_unique=True).size
        if bound < need(len(tokens), sizes[fits].min(), percent):
            continue
        for k in np.flatnonzero(fits):
            s, sc, other = group[k]
            if find(sc) != find(qc) and bound >= need(len(tokens), len(other), percent) and np.intersect1d(tokens, other, assume_unique=True).size >= need(len(tokens), len(other), percent):
                parent[find(sc)] = find(qc)
                edges.append((q, s))
    return edges


def join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 80, row: str | None = None, bits: int = 64) -> DataFrame:
    """For each row: row (of C.with_row()), key, n_shingles, component_id, and first: whether it stands for its component.

    row: the column of C.with_row(), if docs has it. bits: of the sums that name sets; sums that clash are named anew, so
    fewer give the same result.
    """
    spark = docs.sparkSession
    C.ship(spark)
    if row is None:
        row = C.fresh(docs, "_row")
        docs = C.with_row(docs, row)
    docs = docs.select(F.col(row).alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    own, key, text = key, "_key", "_text"
    cells = sketch_bits(docs)
    rows, sketch, measured = _pieces(docs, key, text, bits, cells)
    rows, nodes, clashing = _named(rows)
    labels = None
    if measured["total"]:
        levels = _levels(sketch, cells, measured["blocks"])
        labels = _components(spark, docs, text, nodes, levels, clashing, measured["total"], percent, bits)
    if labels is None:
        labels = spark.createDataFrame([], "node long, component long")
    # the smallest key of each component; rows with an empty set stand alone
    lead = nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "best")
    lead = C.as_table(lead, "leads")
    tops = lead.groupBy("component").agg(F.min("best").alias("top"))
    named = lead.join(tops, "component").select("node", "top")
    full = rows.filter("n > 0").join(named, "node").select("row", "key", "n", F.col("top.key").alias("component_id"), (F.col("row") == F.col("top.row")).alias("first"))
    out = full.unionByName(rows.filter("n = 0").select("row", "key", "n", F.col("key").alias("component_id"), F.lit(True).alias("first")))
    return out.select("row", F.col("key").alias(own), F.col("n").alias("n_shingles"), "component_id", "first")


def _named(rows: DataFrame) -> tuple[DataFrame, DataFrame, list[np.ndarray]]:
    """rows and nodes (node, n, best) with one id for each set; and the ids that named several, for each time of naming anew."""
    best = F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("row"))
    clashing: list[np.ndarray] = []
    for again in range(20):
        nodes = rows.filter("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.min(best).alias("best"), F.min("lane").alias("l0"), F.max("lane").alias("l1"))
        nodes = C.as_table(nodes, "nodes", clashes=F.count_if(F.col("l0") != F.col("l1")))
        n = nodes.measured["clashes"]
        if not n:
            return rows, nodes.select("node", "n", "best"), clashing
        if n > MOST_CLASHES:
            raise RuntimeError(f"{n} sums name several sets")
        # two sets with one sum: both get another id, from both sums
        several = nodes.filter("l0 != l1").select("node", F.lit(True).alias("several"))
        clashing.append(np.array([r[0] for r in several.select("node").collect()], np.int64).view(np.uint64))
        udf = F.pandas_udf(lambda a, b, again=again: pd.Series(_renamed(a.to_numpy().view(np.uint64), b.to_numpy().view(np.uint64), again).view(np.int64)), "long")
        rows = rows.join(several, "node", "left").withColumn("node", F.when(F.col("several"), udf("node", "lane")).otherwise(F.col("node"))).drop("several")
        rows = C.as_table(rows, "sets")
    raise RuntimeError("sums that name sets clash again and again")


def _components(spark, docs, text, nodes, levels, clashing, total, percent, bits) -> DataFrame | None:
    """(node, component) of the nodes that share a prefix token with another one; None if there are none."""
    hot_level = int(4 * np.log2(1 + max(HOT, 16 * total / len(levels))))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * (100 - percent) / 100) // PARTITION_ROWS + 1)
    shared = C.as_table(_shared(_prefixes(docs, text, levels, clashing, percent, hot_level, bits), partitions, percent), "shared", n=F.count(F.lit(1)), hot=F.count_if("hot"))
    if not shared.measured["n"]:
        return None

    # groups: the leader with which a node shares most prefix tokens
    follows = shared.groupBy("node", "leader").agg(F.max("n").alias("n"), F.max("leader_n").alias("leader_n"), F.count(F.lit(1)).alias("times"))
    if shared.measured["hot"]:  # salted lists of one token have a leader each; they follow the first of these
        across = shared.filter("hot").select("token", F.coalesce("leader", "node").alias("node"), F.coalesce("leader_n", "n").alias("n")).distinct()
        top = across.groupBy("token").agg(F.min(F.struct(F.col("node").alias("leader"), F.col("n").alias("leader_n"))).alias("top"))
        across = across.join(top, "token").filter(F.col("node") != F.col("top.leader")).groupBy("node", "n", "top.leader", "top.leader_n").agg(F.count(F.lit(1)).alias("times"))
        follows = follows.unionByName(across)
    chosen = F.when(F.col("leader").isNotNull(), F.struct("times", "leader", "leader_n"))
    every = follows.groupBy("node").agg(F.max("n").alias("n"), F.max(chosen).alias("best"))
    every = C.as_table(every.select("node", "n", F.coalesce("best.leader", "node").alias("leader"), F.coalesce("best.leader_n", "n").alias("leader_n"), "best.times"), "follows")
    sizes = every.groupBy("leader").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("n") / CHUNK_TOKENS)).alias("parts"))
    chunked = every.join(sizes, "leader").withColumn("chunk", F.xxhash64("leader", F.pmod(F.xxhash64("node"), "parts"))).drop("parts")
    chunked = C.as_table(chunked, "chunks")

    # members against their leaders, where the shared prefix tokens allow a link; the matrix sees to all other pairs
    member = chunked.filter("node != leader").filter(F.col("times") >= least_shared(F.col("n"), F.col("n"), F.col("leader_n"), F.col("leader_n"), percent))
    roles = member.select("node", "chunk", F.lit(False).alias("leads")).unionByName(member.select(F.col("leader").alias("node"), "chunk", F.lit(True).alias("leads")).distinct())
    edges = C.as_table(_compare_with_leaders(_with_sets(docs, text, nodes, roles), percent), "edges")
    first = C.as_table(components(edges), "components")

    # the matrix: (token, group) with what is needed to rule pairs out
    linked = edges.select(F.col("u").alias("node"), F.lit(True).alias("linked"))
    grouped = chunked.join(first, "node", "left").join(linked, "node", "left")
    grouped = grouped.select("node", "n", F.coalesce("component", "node").alias("component"), F.xxhash64("chunk", F.coalesce("linked", F.col("node") == F.col("leader"))).alias("group"))
    grouped = C.as_table(grouped, "groups")
    entry = shared.select("token", "node", "indexed").join(grouped, "node")
    matrix = entry.groupBy("token", "group").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.max("indexed").alias("indexed"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    matrix = C.as_table(matrix, "matrix")
    several = matrix.groupBy("token").agg(F.min("c0").alias("t0"), F.max("c1").alias("t1"), F.ceil(F.count(F.lit(1)) / BLOCK_GROUPS).alias("blocks")).filter("t0 < t1").select("token", "blocks")
    mixed = C.as_table(matrix.join(several, "token"), "mixed", most=F.max("blocks"))
    C.drop_table(matrix)

    pairs = C.as_table(_bounded(mixed, mixed.measured["most"] or 0, percent), "pairs")

    # opening of what qualifies
    sides = pairs.select("g", "h", F.col("g").alias("group"), F.lit(0).alias("side")).unionByName(pairs.filter("g != h").select("g", "h", F.col("h").alias("group"), F.lit(1).alias("side")))
    opened = sides.join(grouped.select("group", "node", "component"), "group").select("node", "g", "h", "side", "component")
    candidates = _with_sets(docs, text, nodes, opened)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        of = dict(zip(pdf["node"], pdf["component"], strict=True))
        return pd.DataFrame([(of[u], of[v]) for u, v in open_groups(pdf, percent)], columns=["u", "v"], dtype="int64")

    more = components(candidates.groupBy("g", "h").applyInPandas(run, "u long, v long"))
    for t in (shared, mixed):
        C.drop_table(t)
    merged = more.select(F.col("node").alias("component"), F.col("component").alias("least"))
    return grouped.join(merged, "component", "left").select("node", F.coalesce("least", "component").alias("component"))


def _bounded(mixed: DataFrame, most_blocks: int, percent: int) -> DataFrame:
    """(g, h), g <= h: the pairs of groups that may hold a link, from what they share of their prefixes and the most that can lie beyond.

    The groups of a token meet block by block, so no task holds more than two blocks of them. A token of several blocks makes a row of
    two groups only if it lies in an indexing prefix of one; all others of such tokens are taken as shared.
    """
    dealt = mixed.withColumn("block", F.pmod(F.xxhash64("group"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))) if most_blocks > 1 else dealt.withColumn("other", F.lit(0).cast("long"))
    dealt = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    a, b = dealt.filter("block = lo").alias("a"), dealt.filter("block = hi").alias("b")
    fits = (100 * F.col("a.n1") >= percent * F.col("b.n0")) & (100 * F.col("b.n1") >= percent * F.col("a.n0"))
    apart = ~((F.col("a.c0") == F.col("a.c1")) & (F.col("b.c0") == F.col("b.c1")) & (F.col("a.c0") == F.col("b.c0")))
    told = (F.col("a.blocks") == 1) | F.col("a.indexed") | F.col("b.indexed")
    once = (F.col("a.lo") < F.col("a.hi")) | (F.col("a.group") <= F.col("b.group"))
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi")) & once & fits & apart & told)
    turned = F.col("a.group") > F.col("b.group")
    side = lambda x, y: F.when(turned, F.col(x)).otherwise(F.col(y))
    bounds = [F.min(side("b.n0", "a.n0")).alias("g0"), F.max(side("b.n1", "a.n1")).alias("g1"), F.min(side("a.n0", "b.n0")).alias("h0"), F.max(side("a.n1", "b.n1")).alias("h1")]
    pairs = met.groupBy(F.least("a.group", "b.group").alias("g"), F.greatest("a.group", "b.group").alias("h")).agg(F.count(F.lit(1)).alias("met"), F.max(F.col("a.indexed") | F.col("b.indexed")).alias("indexed"), *bounds)
    pairs = pairs.filter("indexed")
    if most_blocks > 1:
        untold = mixed.filter("blocks > 1 AND NOT indexed").groupBy("group").agg(F.count(F.lit(1)).alias("untold"))
        for end in ("g", "h"):
            pairs = pairs.join(untold.select(F.col("group").alias(end), F.col("untold").alias(f"{end}_untold")), end, "left")
        pairs = pairs.withColumn("met", F.col("met") + F.least(F.coalesce("g_untold", F.lit(0)), F.coalesce("h_untold", F.lit(0))))
    return pairs.filter(F.col("met") >= least_shared(F.col("g0"), F.col("g1"), F.col("h0"), F.col("h1"), percent)).select("g", "h")


def least_shared(a0: Column, a1: Column, b0: Column, b1: Column, percent: int) -> Column:
    """How many prefix tokens two sets of sizes in [a0, a1] and [b0, b1] share at least if they link.

    Of two sets, take the one whose prefix ends first in the order. Its prefix shares with the other set only what lies in
    that one's prefix too, and beyond its prefix lie ceil(percent / 100 * size) - 1 tokens; the overlap is at most the sum.
    """
    return F.ceil(percent * (a0 + b0) / (100 + percent)) - F.ceil(percent * F.greatest(a1, b1) / 100) + 1


def _with_sets(docs: DataFrame, text: str, nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """roles (node, ...) with toks, the node's set, from the text of the document that stands for it."""
    placed = C.as_table(roles.join(nodes.select("node", F.col("best.row").alias("_row")), "node"), "roles", n=F.count(F.lit(1)))
    hashes, maybe = C.row_filter(placed, "_row", placed.measured["n"])
    source = docs.select("_row", text, *(h.alias(f"_h{i}") for i, h in enumerate(hashes("_row"))))
    schema = T.StructType([source.schema["_row"], T.StructField("toks", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(maybe(*(b.column(f"_h{i}").to_numpy() for i in range(2)))))
            for i, j, tokens, bounds in _read(b, text):
                sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("_row").slice(i, j - i), sets], names=schema.names)

    return C.map_arrow(source, run, schema).join(placed, "_row").drop("_row")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """docs with one row of each component, the one of the smallest key; rows with an empty set all stay."""
    row = C.fresh(docs, "_row")
    docs = C.with_row(docs, row)
    gone = C.as_table(join(docs, key=key, text=text, percent=percent, row=row).filter(~F.col("first")).select(F.col("row").alias(row)), "gone", n=F.count(F.lit(1)))
    return C.without_rows(docs, gone, row, gone.measured["n"]).drop(row)
