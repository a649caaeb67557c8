"""Session settings, and the one place where source tables become time series.

The canonical form is long: series_id STRING, ts TIMESTAMP (UTC), y DOUBLE, with NULL for what is missing. Positional
rules use an explicit pos BIGINT.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that grouped pandas functions find it there."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parent
        out = Path(tempfile.mkdtemp(prefix="tidewright-")) / f"{top.name}.zip"
        with zipfile.ZipFile(out, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(out))
        _shipped.add(app)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder the cluster shares (spark.checkpoint.dir), or on one machine, where that is unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewright-")
    return f"{base.rstrip('/')}/tidewright/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: it takes no executor's memory, and a lost executor loses none of it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> SparkSession:
    """All time arithmetic is in UTC."""
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def clean(y: str | Column) -> Column:
    """NaN counts as missing."""
    y = F.col(y) if isinstance(y, str) else y
    return F.when(~F.isnan(y.cast("double")), y.cast("double"))


def as_series(df: DataFrame, series_id: str | Column, ts: str | Column, y: str | Column) -> DataFrame:
    """The canonical long form of a table; timestamps without a zone are taken as UTC."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(col(series_id).cast("string").alias("series_id"), col(ts).cast("timestamp").alias("ts"), clean(y).alias("y"))


def from_wide(df: DataFrame, ts: str, columns: list[str] | None = None) -> DataFrame:
    """Long form of a wide table, one row for each time and column, missing values included."""
    columns = columns or [c for c in df.columns if c != ts]
    wide = df.select(F.col(ts).cast("timestamp").alias("ts"), *(clean(c).alias(c) for c in columns))
    return wide.unpivot("ts", columns, "series_id", "y").select("series_id", "ts", "y")


def to_wide(long: DataFrame, columns: list[str], value: str = "y", index: str = "ts") -> DataFrame:
    """One column for each named series; naming them spares Spark a pass to find them."""
    return long.groupBy(index).pivot("series_id", columns).agg(F.first(value))


def over_series(*extra: str) -> Window:
    """The window of a series in time order. Equal windows share one shuffle and sort."""
    return Window.partitionBy("series_id", *extra).orderBy("ts")


def with_pos(df: DataFrame) -> DataFrame:
    """pos: the place of a row in its series, from 0."""
    return df.withColumn("pos", (F.row_number().over(over_series()) - 1).cast("long"))


def seconds_of(rule: str) -> int:
    """Seconds of a frequency such as `h`, `3h`, `30min`, `D`, `1 hour`."""
    import re

    units = {"s": 1, "sec": 1, "second": 1, "min": 60, "t": 60, "minute": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400, "w": 604800, "week": 604800}
    m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+?)s?\s*", rule)
    unit = m and units.get(m[2].lower() or "s", units.get(m[2]))
    if not unit and rule.strip().lower() in units:
        m, unit = None, units[rule.strip().lower()]
        return unit
    if not unit:
        raise ValueError(f"{rule!r} is no fixed frequency")
    return int(m[1] or 1) * unit
