"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.grid import keep_one
from tidewright.sources import store


def resample_stream(events: DataFrame, rule: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Means by tumbling windows; a window is final once the watermark passes its end."""
    out = events.withWatermark("ts", late).groupBy("series_id", F.window("ts", rule)).agg(F.avg("y").alias("y"))
    return out.select("series_id", F.col("window.start").alias("ts"), "y")


def rolling_mean_stream(events: DataFrame, size: str = "24 hours", slide: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Means over sliding windows, named by their ends."""
    out = events.withWatermark("ts", late).groupBy("series_id", F.window("ts", size, slide)).agg(F.avg("y").alias("roll_mean"))
    return out.select("series_id", F.col("window.end").alias("ts"), "roll_mean")


def sessions_stream(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of sessions that a gap ends."""
    out = events.withWatermark("ts", late).groupBy("series_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"))
    return out.select("series_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def naive_stream(hourly: DataFrame, offset: int = 24, late: str | None = None) -> DataFrame:
    """A forecast for each row that arrives: the value `offset` rows ago in its series. State: the last `offset` values.

    late: how late rows may come; then rows wait until the watermark has passed them, and are taken in the order of their times, whatever
    batch brought them. Without it, each batch is taken in order as it comes.
    """
    schema = T.StructType([T.StructField("series_id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("y", T.DoubleType()), T.StructField("pred", T.DoubleType())])

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        window, times, values = state.get if state.exists else ((), (), ())
        window, waiting = list(window), list(zip(times, values, strict=True))
        if not state.hasTimedOut:
            for rows in batches:
                waiting += zip((rows["ts"].astype("datetime64[us]").astype("int64")).tolist(), rows["y"].astype(float).tolist(), strict=True)
        edge = state.getCurrentWatermarkMs() * 1000 if late else None
        ready = sorted(r for r in waiting if edge is None or r[0] < edge)
        waiting = [r for r in waiting if edge is not None and r[0] >= edge]
        preds = []
        for _, y in ready:
            preds.append(window[0] if len(window) == offset else None)
            window = [*window, y][-offset:]
        state.update((window, [t for t, _ in waiting], [y for _, y in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(min(t for t, _ in waiting) // 1000, edge // 1000) + 1)
        yield pd.DataFrame({"series_id": key[0], "ts": pd.to_datetime([t for t, _ in ready], unit="us"), "y": [y for _, y in ready], "pred": pd.array(preds, "Float64").to_numpy(float, na_value=float("nan"))})

    rows = hourly.withWatermark("ts", late) if late else hourly
    return rows.groupBy("series_id").applyInPandasWithState(run, schema, "window array<double>, times array<bigint>, waiting array<double>", "append", "EventTimeTimeout" if late else "NoTimeout")


def merge_late(spark: SparkSession, target: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the last row of each key: every batch is written with its number, and current() reads
    the last version of each key. Writing a batch again replaces it, so a repeated one is harmless. compact() merges them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/batch={number:012d}")

    return write


def _parts(spark: SparkSession, target: str) -> tuple[str | None, list[str]]:
    """The newest complete base, and the batches that came after it."""
    found = store.names(spark, target)
    bases = [n for n in found if n.startswith("base=") and "_SUCCESS" in store.names(spark, f"{target}/{n}")]
    base = bases[-1] if bases else None
    after = int(base.removeprefix("base=")) if base else -1
    return base, [n for n in found if n.startswith("batch=") and int(n.removeprefix("batch=")) > after]


def current(spark: SparkSession, target: str, keys: list[str], order: str = "ts") -> DataFrame:
    base, batches = _parts(spark, target)
    rows = spark.read.parquet(*(f"{target}/{n}" for n in ([base] if base else []) + batches))
    return keep_one(rows, keys, [F.col("_batch"), F.col(order)]).drop("_batch")


def compact(spark: SparkSession, target: str, keys: list[str], order: str = "ts") -> None:
    """Merges all batches so far into one base, and deletes what it replaces once the base is complete."""
    base, batches = _parts(spark, target)
    if not batches:
        return
    rows = spark.read.parquet(*(f"{target}/{n}" for n in ([base] if base else []) + batches))
    new = f"base={batches[-1].removeprefix('batch=')}"
    keep_one(rows, keys, [F.col("_batch"), F.col(order)]).write.mode("overwrite").parquet(f"{target}/{new}")
    for n in store.names(spark, target):
        if n in batches or (n.startswith("base=") and n < new):
            store.delete(spark, f"{target}/{n}")
