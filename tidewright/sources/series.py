"""Sources of time series: CSV files, frames, raw downloads, and the folders they lie in."""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators import curate, grid
from tidewright.session import clean, prepare

log = logging.getLogger(__name__)


def home(kind: str = "data") -> Path:
    """The data or cache folder: TIDEWRIGHT_DATA or TIDEWRIGHT_CACHE, or one in the user's home. It is made if missing."""
    if kind not in ("data", "cache"):
        raise ValueError("kind must be 'data' or 'cache'")
    path = Path(os.environ.get(f"TIDEWRIGHT_{kind.upper()}", Path.home() / f".tidewright/{kind}"))
    path.mkdir(parents=True, exist_ok=True)
    return path


def package_data() -> Path:
    return Path(__file__).resolve().parent.parent / "data"


@dataclass
class Wide:
    """A wide table: ts and one DOUBLE column for each target."""

    df: DataFrame
    columns: list[str]

    def long(self) -> DataFrame:
        return self.df.unpivot("ts", self.columns, "series_id", "y").select("series_id", "ts", "y")


def to_utc(ts, zone: str | None):
    """Local times of a zone as UTC; without a zone an error."""
    if not zone:
        raise ValueError("times without a zone need one")
    return F.to_utc_timestamp(ts, zone)


def from_csv(spark: SparkSession, path: str, zone: str = "UTC", columns: Sequence[str] | None = None, index: str | None = None, form: str | None = None, null: str = "") -> Wide:
    """Reads only the named columns, as DOUBLE; the header is read alone to learn the others' places."""
    prepare(spark)
    header = spark.read.option("header", True).csv(path).columns
    index = index or header[0]
    if columns is not None and not columns:
        raise ValueError("columns must not be empty")
    chosen = list(columns) if columns else [c for c in header if c != index]
    missing = set(chosen) - set(header)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    schema = T.StructType([T.StructField(c, T.StringType() if c == index else T.DoubleType() if c in chosen else T.StringType()) for c in header])
    df = spark.read.schema(schema).option("header", True).option("nullValue", null).csv(path)
    ts = F.to_timestamp(index, form) if form else F.to_timestamp(index)
    return Wide(df.select(to_utc(ts, zone).alias("ts"), *(clean(c).alias(c) for c in chosen)), chosen)


def from_frame(df: DataFrame, index: str, zone: str = "UTC", columns: Sequence[str] | None = None) -> Wide:
    if columns is not None and not columns:
        raise ValueError("columns must not be empty")
    chosen = list(columns) if columns else [c for c in df.columns if c != index]
    ts = F.col(index).cast("timestamp")
    return Wide(df.select((ts if zone == "UTC" else to_utc(ts, zone)).alias("ts"), *(clean(c).alias(c) for c in chosen)), chosen)


def fetch(spark: SparkSession, path: str | None = None, frame: DataFrame | None = None, index: str | None = None, zone: str = "UTC", columns: Sequence[str] | None = None) -> Wide:
    """From a CSV file or a frame, one of them."""
    if (path is None) == (frame is None):
        raise ValueError("name a file or a frame, and only one of them")
    if path is not None:
        return from_csv(spark, path, zone, columns, index)
    return from_frame(frame, index or frame.columns[0], zone, columns)


def load_series(spark: SparkSession, path: str, column: str, index: str = "Time (UTC)") -> DataFrame:
    """One column of a CSV file on a complete hourly grid, filled forward, then backward."""
    return grid.fill(grid.as_frequency(from_csv(spark, path, columns=[column], index=index).long(), "h"))


def load_load(spark: SparkSession, folder: str | None = None) -> DataFrame:
    return load_series(spark, f"{folder or home()}/interim/energy_load.csv", "Actual Load")


def load_load_forecast(spark: SparkSession, folder: str | None = None) -> DataFrame:
    return load_series(spark, f"{folder or home()}/interim/energy_load.csv", "Forecasted Load")


def load_actual_combined(spark: SparkSession, path: str, columns: Sequence[str], horizon: int, weights) -> DataFrame:
    """The weighted sum of the first `horizon` rows of a file of true values."""
    wide = from_csv(spark, path, columns=columns)
    first = wide.df.orderBy("ts").limit(horizon)
    return curate.combine(first, weights)


def merge_raw(spark: SparkSession, pattern: str, columns: Sequence[str], index: str = "Time (UTC)", now: str | None = None) -> DataFrame:
    """The union of raw CSV files: of each time the row of the last file by name, times in the future left out, in time order."""
    prepare(spark)
    schema = T.StructType([T.StructField(index, T.StringType()), *(T.StructField(c, T.DoubleType()) for c in columns)])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("nullValue", "-").csv(pattern)
    rows = raw.select(F.to_timestamp(index).alias("ts"), *columns, F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    limit = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return grid.keep_one(rows.filter(F.col("ts").isNotNull() & (F.col("ts") <= limit)), ["ts"], [F.col("_file"), F.col("_at")]).select("ts", *columns).orderBy("ts")


def download(query: Callable[[str, str], str], raw: Path, last: str | None, start: str | None = None, end: str | None = None, force: bool = False, cooldown_h: float = 24, tries: int = 5, wait_s: float = 5, now: float | None = None) -> Path | None:
    """Fetches what follows the last known time and writes it to the raw folder; None if it is too soon.

    query(start, end) gives CSV text. last: the last time that is known, from which it resumes; without it, a week back.
    """
    import datetime as dt

    now = now or time.time()
    raw.mkdir(parents=True, exist_ok=True)
    newest = max((p.stat().st_mtime for p in raw.glob("*.csv")), default=0)
    if not force and now - newest < cooldown_h * 3600:
        return None
    at = dt.datetime.fromtimestamp(now, dt.UTC).replace(tzinfo=None)
    begin = start or ((dt.datetime.fromisoformat(last) + dt.timedelta(hours=1)) if last else at - dt.timedelta(days=7)).isoformat()
    end = end or at.isoformat()
    for k in range(tries):
        try:
            text = query(str(begin), str(end))
            break
        except Exception as e:
            log.warning("download failed (%s of %s): %s", k + 1, tries, e)
            if k == tries - 1:
                raise
            time.sleep(wait_s)
    out = raw / f"load_{int(now)}.csv"
    out.write_text(text)
    return out
