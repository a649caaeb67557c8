"""Exact dedup: static binary-fuse filters for each immutable snapshot screen incoming digests.

A snapshot is a table of groups of equal texts, one row for each digest, dealt into buckets, with one static
binary-fuse filter of 8-bit fingerprints for each bucket. Incoming rows are grouped among themselves first, which
leaves one row for each digest however large a group is; those digests are screened bucket by bucket. A negative is
new for certain. A positive is looked up in the snapshot's exact bucket. Rows of one group are then compared byte by
byte with the row that stays; rows that differ under one digest are grouped by their whole text instead. Of all texts,
a filter of the wanted rows lets only those of such groups through to the shuffle.

Texts are equal when identical after deleting every character of `[\\x20\\x09-\\x0D]`. The row with the most code points
in its original text stays, then the one with the smallest key, a null key last; of rows that repeat a key, one stays.
Null texts count as empty. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm import _common as C

#: Fewest buckets, and digests of a bucket beyond which there are more.
BUCKETS, BUCKET_ROWS = 256, 50_000


# ---- binary-fuse filter -------------------------------------------------------------------------------------------


@dataclass
class FuseFilter:
    """A static 3-wise binary-fuse filter: about 9 bits a key, false positives near 1 in 256, no false negatives."""

    seed: int
    segment: int
    span: int
    prints: np.ndarray

    def slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _slots(keys, self.seed, self.segment, self.span)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.prints):
            return np.zeros(len(keys), bool)
        at, prints = self.slots(keys)
        return (self.prints[at[0]] ^ self.prints[at[1]] ^ self.prints[at[2]]) == prints


def _slots(keys: np.ndarray, seed: int, segment: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key, in consecutive segments, and its fingerprint."""
    h = C.mix64(keys + np.uint64(seed))
    first = ((h >> np.uint64(32)) * np.uint64(span)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64), (C.mix64(h) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> FuseFilter:
    """keys: distinct 64-bit integers. Keys are peeled in rounds, all slots with one key left at once."""
    n = len(keys)
    if n == 0:
        return FuseFilter(0, 4, 4, np.zeros(0, np.uint8))
    segment = min(1 << 18, 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    room = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 8
    span = max(1, -(-room // segment) - 2) * segment
    for seed in range(1, 1000):
        at, prints = _slots(keys, seed * 0x9E3779B97F4A7C15 & ((1 << 64) - 1), segment, span)
        size = span + 2 * segment
        count = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(n))
        rounds, left = [], n
        ready = np.flatnonzero(count == 1)
        while len(ready):
            who, first = np.unique(owner[ready], return_index=True)
            rounds.append((who, ready[first]))
            left -= len(who)
            touched = at[:, who].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(owner, touched, np.tile(who, 3))
            touched = np.unique(touched)
            ready = touched[count[touched] == 1]
        if not left:
            out = np.zeros(size, np.uint8)
            for who, slot in reversed(rounds):
                a = at[:, who]
                out[slot] = 0
                out[slot] = prints[who] ^ out[a[0]] ^ out[a[1]] ^ out[a[2]]
            return FuseFilter(seed * 0x9E3779B97F4A7C15 & ((1 << 64) - 1), segment, span, out)
        if seed % 8 == 0:
            span += segment
    raise ValueError("keys are not distinct")


# ---- snapshots and screening --------------------------------------------------------------------------------------


@dataclass
class Snapshot:
    """groups: digest, bucket, size, best; filters: bucket and the filter of its digests. Neither ever changes."""

    groups: DataFrame
    filters: DataFrame
    buckets: int


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), "digest"), F.lit(n)).cast("int")


def build_snapshot(groups: DataFrame, buckets: int | None = None) -> Snapshot:
    """Writes groups (digest, size, best) as an immutable snapshot with a filter for each bucket."""
    n = buckets or max(BUCKETS, -(-groups.count() // BUCKET_ROWS))
    table = C.as_table(groups.withColumn("bucket", _bucket(n)), "snapshot")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = build_filter(np.unique(pdf["key"].to_numpy().view(np.uint64)))
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "seed": [np.array(f.seed, np.uint64).astype(np.int64)], "segment": [f.segment], "span": [f.span], "prints": [f.prints.tobytes()]})

    C.ship(groups.sparkSession)
    filters = table.select("bucket", F.xxhash64("digest").alias("key")).groupBy("bucket").applyInPandas(build, "bucket int, seed long, segment long, span long, prints binary")
    return Snapshot(table, C.as_table(filters, "filters"), n)


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """groups with `maybe`: false if the snapshot's filter rules the digest out."""
    incoming = groups.withColumn("bucket", _bucket(snapshot.buckets)).withColumn("hash", F.xxhash64("digest"))
    schema = T.StructType([*groups.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("maybe", T.BooleanType())])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left.drop(columns=["hash"])
        keys = left["hash"].to_numpy(np.int64).view(np.uint64)
        if len(right):
            r = right.iloc[0]
            f = FuseFilter(int(np.int64(r["seed"]).astype(np.uint64)), int(r["segment"]), int(r["span"]), np.frombuffer(r["prints"], np.uint8))
            out["maybe"] = f.holds(keys)
        else:
            out["maybe"] = False
        return out[schema.names]

    C.ship(groups.sparkSession)
    return incoming.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInPandas(run, schema)


# ---- the operator -------------------------------------------------------------------------------------------------


def normalised(text: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), C.SPACES, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _groups(rows: DataFrame, *by: str) -> DataFrame:
    best = F.struct((-F.col("n_chars")).alias("less"), F.col("key").isNull().alias("none"), F.col("key"), F.col("rid"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("size"), F.min(best).alias("best"))


def _merged(new: DataFrame, snapshot: Snapshot) -> DataFrame:
    """All groups after the batch: digest, size, best."""
    screened = C.as_table(screen(new, snapshot), "screened")
    positive = screened.filter("maybe").select("bucket", "digest", F.col("size").alias("size2"), F.col("best").alias("best2"))
    both = snapshot.groups.join(positive, ["bucket", "digest"], "full")
    both = both.select(
        "digest",
        (F.coalesce("size", F.lit(0)) + F.coalesce("size2", F.lit(0))).cast("long").alias("size"),
        F.least("best", "best2").alias("best"),
    )
    return both.unionByName(screened.filter(~F.col("maybe")).select("digest", "size", "best"))


def dedup(docs: DataFrame, in_snapshot: Column | None = None, *, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, row: str | None = None) -> DataFrame:
    """For each row: key, keep_id, group_size, kept, digest, and `row`, which tells repeated rows apart.

    in_snapshot: which rows are the snapshot that the others, the new batch, are held against; none by default.
    row: the column of C.with_row(), if docs has it.
    digest: of the normalised text. Any function is right; a weak one only makes more texts be compared.
    """
    spark = docs.sparkSession
    in_snapshot = F.lit(False) if in_snapshot is None else in_snapshot
    if row is None:
        row = C.fresh(docs, "_row")
        docs = C.with_row(docs, row)
    texts = docs.select(F.col(row).alias("rid"), F.col(key).alias("key"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_chars"), in_snapshot.alias("old"), normalised(text).alias("norm"))
    rows = texts.select("key", "n_chars", "old", "rid", F.unhex(digest(F.col("norm"))).alias("digest"))
    rows = C.as_table(rows, "digests", n=F.count(F.lit(1)))
    # as many buckets as the larger of snapshot and batch may need
    snapshot = build_snapshot(_groups(rows.filter("old"), "digest"), max(BUCKETS, -(-rows.measured["n"] // BUCKET_ROWS)))
    groups = C.as_table(_merged(_groups(rows.filter(~F.col("old")), "digest"), snapshot), "groups")

    # The byte check: only texts of groups with several rows move, and only those are hashed again.
    several = groups.filter("size > 1").select("digest", F.col("best.rid").alias("best_rid"))
    members = C.as_table(rows.join(several, "digest").select("rid"), "members", n=F.count(F.lit(1)))
    hashed = texts.withColumn("digest", F.unhex(digest(F.col("norm"))))
    wanted = texts.filter(C.passes(members, "rid", members.measured["n"], "rid")).withColumn("digest", F.unhex(digest(F.col("norm"))))
    moved = C.as_table(wanted.join(several, "digest").select("digest", "norm", (F.col("rid") == F.col("best_rid")).alias("is_best")), "texts")
    leaders = moved.filter("is_best").select("digest", F.col("norm").alias("leader"))  # one row of each digest
    # written before they are made distinct, so that Spark can split the join of a very large group
    clash = C.as_table(moved.join(C.as_table(leaders, "leaders"), "digest").filter(F.col("norm") != F.col("leader")).select("digest"), "clash")
    joined = rows.join(groups, "digest")
    if clash.isEmpty():
        out = joined
    else:  # one digest, different texts: these rows are grouped by their whole texts
        clash = clash.distinct()
        apart = hashed.join(clash, "digest").select("digest", "norm", "key", "n_chars", "rid")
        apart = C.as_table(apart, "apart")
        regrouped = apart.join(_groups(apart, "digest", "norm"), ["digest", "norm"])
        names = ["digest", "key", "n_chars", "rid", "size", "best"]
        out = joined.join(clash, "digest", "left_anti").select(*names).unionByName(regrouped.select(*names))
    C.drop_table(snapshot.filters)
    return out.select(F.col("key").alias(key), F.col("best.key").alias("keep_id"), F.col("size").alias("group_size"), (F.col("rid") == F.col("best.rid")).alias("kept"), F.lower(F.hex("digest")).alias("digest"), F.col("rid").alias("row"))


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; the texts are compared as in dedup()."""
    row = C.fresh(docs, "_row")
    docs = C.with_row(docs, row)
    gone = dedup(docs, half(key), key=key, text=text, row=row).filter(~F.col("kept")).select(F.col("row").alias(row))
    gone = C.as_table(gone, "gone", n=F.count(F.lit(1)))
    return C.without_rows(docs, gone, row, gone.measured["n"]).drop(row)


def half(key: str) -> Column:
    """The rows that make up the snapshot when one table is deduplicated: about half of the keys."""
    return F.pmod(F.xxhash64(F.lit("snapshot"), F.col(key).cast("string")), F.lit(2)) == 0
