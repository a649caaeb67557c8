"""What the training-data operators share: scratch tables, byte views of Arrow text, hashing."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import types
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewright.session import ship

#: The white space of the contracts, `[\x20\x09-\x0D]`.
SPACES = " \t\n\x0b\f\r"

#: Bytes of text that a Python worker hashes at once; a single longer document is taken alone.
CHUNK_BYTES = 1 << 19
#: Rows of an Arrow batch at most, as a row is a whole document.
BATCH_ROWS = 2000


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with this package at hand on the executors, in batches that suit whole documents. Workers are used again, so each task
    gives back the memory that it no longer needs."""
    spark = df.sparkSession
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Returns freed memory of this process to the system, as far as its C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder the cluster shares (spark.checkpoint.dir).

    Where that setting is empty, as in tests on one machine, a temporary folder is used; on a cluster that is an error, as
    each node would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        made = spark.sparkContext.getCheckpointDir()
        if made is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            made = "file://" + tempfile.mkdtemp(prefix="tidewright-")
            spark.sparkContext.setCheckpointDir(made)
        base = made
    return f"{base.rstrip('/')}/tidewright/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application; for when its results have been written elsewhere."""
    top = scratch_path(spark, "all").rpartition("/")[0]
    p = spark._jvm.org.apache.hadoop.fs.Path(top)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def as_table(df: DataFrame, name: str, **measured: Column) -> DataFrame:
    """Writes df to the shared folder and reads it again, which cuts its lineage and survives lost executors.

    measured: counts and sums that the same job computes on the way; they are in the result's `measured`, 0 for no rows.
    """
    path = scratch_path(df.sparkSession, name)
    seen = Observation() if measured else None
    (df.observe(seen, *(c.alias(n) for n, c in measured.items())) if measured else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    found = seen.get if measured else {}
    out.measured = {n: found.get(n) or 0 for n in measured}
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes a table of as_table() that no later plan reads."""
    path = getattr(df, "_scratch", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df lacks."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row(docs: DataFrame, name: str = "_row") -> DataFrame:
    """docs with a column that tells every row from all others, the same each time the table is read.

    It is the place of the row in its Parquet file; a DataFrame that isn't a plain scan of files is written first.
    """
    try:
        at = docs.metadataColumn("_metadata")
        out = docs.withColumn(name, F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("at")))
        out.schema  # resolves the hidden column
        return out
    except AnalysisException:
        return with_row(as_table(docs, "rows"), name)


#: Bits of a row filter: at least so many for each row, and at most in all (32 MB); beyond that more rows pass by chance.
FILTER_BITS_A_ROW, MOST_FILTER_BITS = 12, 1 << 28


def row_filter(rows: DataFrame, row: str, count: int):
    """Whether a row may be among `rows`, never false for one of them: (hashes, maybe), a Bloom filter of four bits a row.

    hashes(column) gives two columns, and maybe(a, b) tells from their NumPy arrays. It spares texts that no join wants the shuffle. Its
    size is bounded, so it is sent to all executors; what passes is joined exactly.
    """
    bits = min(MOST_FILTER_BITS, 1 << max(16, int(FILTER_BITS_A_ROW * max(count, 1) - 1).bit_length()))
    hashes = lambda column: [F.xxhash64(F.lit(seed), column) for seed in (11, 12)]
    block = min(bits, 1 << 19)  # bits of a piece

    def places(a: np.ndarray, b: np.ndarray):
        for h in (a.view(np.uint64), b.view(np.uint64)):
            for x in (h, h >> np.uint64(32)):
                yield x & np.uint64(bits - 1)

    def gather(batches):
        """The pieces of a task's rows that have a bit set, once for each task."""
        words = np.zeros(bits >> 6, np.uint64)
        for batch in batches:
            for x in places(*(batch.column(i).to_numpy() for i in range(2))):
                np.bitwise_or.at(words, (x >> np.uint64(6)).astype(np.int64), np.uint64(1) << (x & np.uint64(63)))
        for i, piece in enumerate(words.reshape(-1, block >> 6)):
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())], names=["piece", "bits"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(block >> 6, np.uint64)
        for x in pdf["bits"]:
            total |= np.frombuffer(zlib.decompress(x), np.uint64)
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "bits": [zlib.compress(total.tobytes(), 1)]})

    spark, schema = rows.sparkSession, "piece int, bits binary"
    parts = map_arrow(rows.select(*(h.alias(f"_h{i}") for i, h in enumerate(hashes(F.col(row))))), gather, schema)
    data = np.zeros((bits // block, block >> 6), np.uint64)
    for i, x in parts.groupBy("piece").applyInPandas(merge, schema).collect():  # 512 pieces of 64 KB at most
        data[i] = np.frombuffer(zlib.decompress(x), np.uint64)
    shared = spark.sparkContext.broadcast(data.ravel())

    def maybe(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        words, out = shared.value, np.ones(len(a), bool)
        for x in places(a, b):
            out &= (words[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) == 1
        return out

    return hashes, maybe


def passes(rows: DataFrame, row: str, count: int, column: str) -> Column:
    """row_filter() as a condition on a column."""
    hashes, maybe = row_filter(rows, row, count)
    test = F.pandas_udf(lambda a, b: pd.Series(maybe(a.to_numpy(np.int64), b.to_numpy(np.int64))), "boolean")
    return test(*hashes(column))


def without_rows(docs: DataFrame, gone: DataFrame, row: str, count: int) -> DataFrame:
    """docs without the rows of `gone` (count rows). Only texts that may be among those are shuffled."""
    if not count:
        return docs
    flag = fresh(docs, "_maybe")
    marked = docs.withColumn(flag, passes(gone, row, count, row))
    unsure = marked.filter(F.col(flag)).join(gone.select(row), row, "left_anti")
    return marked.filter(~F.col(flag)).unionByName(unsure.select(*marked.columns)).drop(flag)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, for parsed vocabularies and the like."""
    return sys.modules.setdefault("_tidewright_worker", types.ModuleType("_tidewright_worker")).__dict__


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow text column without making Python strings; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges (i, j) of whole documents with about `most` bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def random_u64(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, modulo 5, is 0; a null id is held out."""
    return F.coalesce(F.expr(f"crc32(cast(cast({doc_id} as string) as binary)) % 5 = 0"), F.lit(True))


def ascii_lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t
