"""Hourly weather: JSON of a public forecast API as rows, a Parquet cache, and what to do when the network fails."""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators import grid
from tidewright.session import prepare
from tidewright.sources import store

# Hourly parameters and the addresses of the archive and of the forecast.
PARAMETERS = ["temperature_2m", "relative_humidity_2m", "precipitation", "rain", "snowfall", "weather_code", "pressure_msl", "surface_pressure", "cloud_cover", "cloud_cover_low", "cloud_cover_mid", "cloud_cover_high", "wind_speed_10m", "wind_direction_10m", "wind_gusts_10m"]
ARCHIVE = "https://archive-api.open-meteo.com/v1/archive"
FORECAST = "https://api.open-meteo.com/v1/forecast"


def get(url: str, params: dict, tries: int = 3, timeout: float = 30) -> str:
    """GET with retries on busy and failing servers."""
    address = f"{url}?{urllib.parse.urlencode(params)}"
    for k in range(tries):
        try:
            with urllib.request.urlopen(address, timeout=timeout) as r:
                return r.read().decode()
        except urllib.error.HTTPError as e:
            if e.code not in (429, 500, 502, 503, 504) or k == tries - 1:
                raise
        except urllib.error.URLError:
            if k == tries - 1:
                raise
        time.sleep(2**k)
    raise RuntimeError("unreachable")


def rows_of_json(texts: DataFrame, column: str = "value", parameters: Sequence[str] = PARAMETERS) -> DataFrame:
    """(ts, parameters) of JSON answers: {"hourly": {"time": [...], parameter: [...]}}."""
    inner = T.StructType([T.StructField("time", T.ArrayType(T.StringType())), *(T.StructField(p, T.ArrayType(T.DoubleType())) for p in parameters)])
    parsed = texts.select(F.from_json(column, T.StructType([T.StructField("hourly", inner)])).alias("j"))
    zipped = F.arrays_zip(*(F.col(f"j.hourly.{c}").alias(c) for c in ["time", *parameters]))
    return parsed.select(F.inline(zipped)).select(F.to_timestamp("time").alias("ts"), *parameters)


@dataclass
class WeatherService:
    """fetch(url, params) gives JSON text; it is a parameter so that tests and other services can stand in."""

    spark: SparkSession
    latitude: float
    longitude: float
    cache: str | None = None
    fetch: Callable[[str, dict], str] = get
    parameters: Sequence[str] = tuple(PARAMETERS)
    now: dt.datetime | None = None

    def _json(self, url: str, start: dt.date, end: dt.date) -> DataFrame:
        params = {"latitude": self.latitude, "longitude": self.longitude, "start_date": start.isoformat(), "end_date": end.isoformat(), "hourly": ",".join(self.parameters), "timezone": "UTC"}
        text = self.fetch(url, params)
        if "hourly" not in json.loads(text):
            raise ValueError("the answer has no hourly values")
        return rows_of_json(self.spark.createDataFrame([(text,)], "value string"), parameters=self.parameters)

    def _hybrid(self, start: dt.datetime, end: dt.datetime) -> DataFrame:
        """Archive up to five days ago, forecast from there to sixteen days ahead; of both, the archive's row."""
        now = self.now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
        edge = now - dt.timedelta(days=5)
        parts = []
        if start < edge:
            parts.append(self._json(ARCHIVE, start.date(), min(end, edge).date()).withColumn("_rank", F.lit(0)))
        if end >= edge:
            parts.append(self._json(FORECAST, max(start, edge).date(), min(end, now + dt.timedelta(days=16)).date()).withColumn("_rank", F.lit(1)))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return grid.keep_one(out, ["ts"], [F.col("_rank")], last=False).drop("_rank")

    def _cached(self) -> DataFrame | None:
        if not self.cache or not store.names(self.spark, self.cache):
            return None
        try:
            latest = store.names(self.spark, self.cache)[-1]
            return self.spark.read.parquet(f"{self.cache}/{latest}")
        except Exception:  # a damaged cache counts as none
            return None

    def _save(self, new: DataFrame, old: DataFrame | None) -> None:
        """Each version is a new folder, so that a reader of the last one is never disturbed; new rows win."""
        both = new.withColumn("_rank", F.lit(1))
        if old is not None:
            both = both.unionByName(old.withColumn("_rank", F.lit(0)))
        merged = grid.keep_one(both, ["ts"], [F.col("_rank")]).drop("_rank")
        merged.write.parquet(f"{self.cache}/v{time.time_ns():020d}")

    def _fallback(self, cached: DataFrame, start: str, end: str) -> DataFrame:
        """The last 24 known hours, again and again."""
        back = F.row_number().over(Window.orderBy(F.col("ts").desc()))
        last = cached.orderBy(F.col("ts").desc()).limit(24).withColumn("_k", 24 - back).drop("ts")
        bounds = self.spark.range(1).select(F.lit(start).cast("timestamp").alias("start"), F.lit(end).cast("timestamp").alias("end"))
        at = grid.spine(bounds, "h").withColumn("_k", F.pmod((F.unix_timestamp("ts") - F.unix_timestamp(F.lit(start).cast("timestamp"))) / 3600, F.lit(24)).cast("int"))
        return at.join(F.broadcast(last), "_k").drop("_k")

    def between(self, start: str, end: str, rule: str = "h", fallback: bool = True) -> DataFrame:
        """(ts, parameters) on a complete grid from start to end."""
        prepare(self.spark)
        cached = self._cached()
        a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
        if cached is not None:
            range_ = cached.agg(F.min("ts") <= a, F.max("ts") >= b).first()
            if range_[0] and range_[1]:
                return self._finish(cached.filter(F.col("ts").between(a, b)), start, end, rule)
        try:
            new = self._hybrid(dt.datetime.fromisoformat(start), dt.datetime.fromisoformat(end))
            if self.cache:
                self._save(new, cached)
                new = self._cached()
        except Exception:
            if not fallback or cached is None:
                raise
            new = self._fallback(cached, start, end)
        return self._finish(new.filter(F.col("ts").between(a, b)), start, end, rule)

    def _finish(self, rows: DataFrame, start: str, end: str, rule: str) -> DataFrame:
        bounds = self.spark.range(1).select(F.lit(start).cast("timestamp").alias("start"), F.lit(end).cast("timestamp").alias("end"))
        w = Window.partitionBy(F.lit(0)).orderBy("ts")
        out = grid.spine(bounds, rule).join(rows, "ts", "left")
        before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
        return out.withColumns({p: F.coalesce(F.last(p, ignorenulls=True).over(before), F.first(p, ignorenulls=True).over(after)) for p in self.parameters})
