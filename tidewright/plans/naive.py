"""The seasonal-naive forecaster: the value one or several offsets ago.

Forecasts are a join of future times with the history; there is no model to fit. An offset is a number of steps of the
grid, or a calendar interval such as '1 day' or '1 month', for which months are clamped to their ends.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.curate import QuantileBinner
from tidewright.operators.grid import future
from tidewright.session import seconds_of

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
}
#: Residuals that are kept in all, and for each bin the share of them.
RESIDUALS = 10_000


def _of_array(a: Column, agg: str | Callable[[Column], Column]) -> Column:
    """An aggregate of an array without NULLs."""
    if callable(agg):
        return agg(a)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    n = F.size(a)
    if agg == "median":
        s = F.array_sort(a)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return {"mean": total / F.nullif(n, F.lit(0)), "sum": total, "max": F.array_max(a), "min": F.array_min(a)}[agg]


def _of_rows(agg: str | Callable[[Column], Column], value: str, k: str = "k") -> Column:
    """The same of a group's rows, ordered by k."""
    if not callable(agg):
        return AGGREGATES[agg](value)
    known = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(k).alias("k"), F.col(value).alias("v")))))
    return agg(F.transform(known, lambda x: x["v"]))


def capped(residuals: DataFrame, n_bins: int, seed: int = 123, total: int = RESIDUALS) -> DataFrame:
    """At most total // n_bins residuals of each bin and `total` of each series, picked by a seeded hash.

    This bounds what a forecaster stores, as bootstraps draw from it; quantiles for intervals use all residuals.
    """
    draw = F.xxhash64(F.lit(seed), *[F.col(c) for c in residuals.columns])
    per_bin = F.row_number().over(Window.partitionBy("series_id", "bin").orderBy(draw, "residual"))
    overall = F.row_number().over(Window.partitionBy("series_id").orderBy(draw, "residual"))
    out = residuals.withColumn("_rn", per_bin).filter(F.col("_rn") <= total // n_bins)
    return out.withColumn("_rn", overall).filter(F.col("_rn") <= total).drop("_rn")


def correction(residuals: DataFrame, coverage: float) -> tuple[DataFrame, DataFrame]:
    """Half-widths of conformal intervals: (series_id, bin, width) and, for bins without residuals, (series_id, width)."""
    q = F.percentile(F.abs("residual"), F.lit(coverage)).alias("width")
    return residuals.groupBy("series_id", "bin").agg(q), residuals.groupBy("series_id").agg(q)


def with_interval(forecast: DataFrame, residuals: DataFrame, binner: QuantileBinner | None, coverage: float, unknown: bool = False) -> DataFrame:
    """forecast with lower_bound and upper_bound; a binner makes the width depend on the forecast's bin.

    unknown: a series without residuals takes the width of all series' residuals (to a ten-thousandth of their ranks).
    """
    by_bin, pooled = correction(residuals, coverage)
    out = forecast.join(pooled.withColumnRenamed("width", "_pooled"), "series_id", "left")
    width = F.col("_pooled")
    if unknown:
        everything = residuals.agg(F.percentile_approx(F.abs("residual"), F.lit(coverage), F.lit(10_000)).alias("_all"))
        out = out.crossJoin(F.broadcast(everything))  # one row
        width = F.coalesce("_pooled", "_all")
    if binner is not None:
        out = binner.transform(out, "pred", how="left" if unknown else "inner").join(by_bin, ["series_id", "bin"], "left")
        width = F.coalesce(F.col("width"), width)
    return out.withColumns({"lower_bound": F.col("pred") - width, "upper_bound": F.col("pred") + width}).drop("_pooled", "_all", "width", "bin")


def check_interval(interval) -> float:
    """The nominal coverage of an interval: a number in (0, 1), or symmetric percentiles such as [5, 95]."""
    if isinstance(interval, (int, float)) and not isinstance(interval, bool):
        if not 0 < interval < 1:
            raise ValueError("coverage must lie in (0, 1)")
        return float(interval)
    lo, hi = interval
    if not (0 <= lo < hi <= 100):
        raise ValueError("percentiles must rise within [0, 100]")
    if lo + hi != 100:
        raise ValueError("conformal intervals must be symmetric")
    return (hi - lo) / 100


@dataclass
class SeasonalNaive:
    """offset: steps of the grid, or an interval such as '1 day' or '1 month'. agg: of the values n_offsets offsets ago: a name, or a
    function from an array column (of the known ones, latest first) to a column."""

    offset: int | str = "1 day"
    n_offsets: int = 1
    agg: str | Callable[[Column], Column] = "mean"
    rule: str = "h"
    n_bins: int = 10

    def __post_init__(self):
        if isinstance(self.offset, int) and self.offset < 1 or self.n_offsets < 1:
            raise ValueError("offset and n_offsets must be positive")
        if not callable(self.agg) and self.agg not in AGGREGATES:
            raise ValueError(f"agg must be one of {sorted(AGGREGATES)}, or a function of an array column")

    def fit(self, series: DataFrame, store_residuals: bool = False, seed: int = 123) -> SeasonalNaive:
        """Keeps the history; residuals and bins are computed only on demand."""
        self.history, self.residuals, self.binner, self.out_residuals = series, None, None, None
        if store_residuals:
            self.history = series = series.persist()  # read for forecasts, bins and residuals; release() lets it go
            self.residuals, self.binner = self._in_sample(series, seed)
        return self

    def release(self) -> None:
        self.history.unpersist()

    def tags(self) -> dict:
        """What this kind of forecaster can do."""
        return {"name": "SeasonalNaive", "multiple_series": True, "exog": False, "recursive": False, "prediction_types": ["point", "interval"], "handles_missing_values": True, "needs_fit_data": True, "interval_methods": ["conformal"]}

    def summary(self) -> dict:
        last = getattr(self, "history", None)
        ends = last.agg(F.min("ts"), F.max("ts"), F.count_distinct("series_id")).first() if last is not None else (None, None, 0)
        name = self.agg if isinstance(self.agg, str) else getattr(self.agg, "__name__", "function")
        return {"offset": self.offset, "n_offsets": self.n_offsets, "agg": name, "rule": self.rule, "n_bins": self.n_bins, "fitted": last is not None, "training_range": (ends[0], ends[1]), "n_series": ends[2], "residuals": getattr(self, "residuals", None) is not None}

    # ---- forecasts

    def predict(self, steps: int, history: DataFrame | None = None) -> DataFrame:
        """(series_id, ts, step, pred) of the next steps. Raises when run if no offset of a time has a value in the history."""
        history = history if history is not None else self.history
        n = self._offset_steps()
        return self._by_steps(history, n, steps) if n else self._by_calendar(future(history, steps, self.rule), history)

    def _offset_steps(self) -> int | None:
        """The offset in steps of the grid, if it is a fixed number of them."""
        if isinstance(self.offset, int):
            return self.offset
        unit = str(self.offset).split()[1].rstrip("s").lower()
        if unit in ("month", "year"):
            return None
        seconds, step = seconds_of(self.offset), seconds_of(self.rule)
        return seconds // step if seconds % step == 0 else None

    def _by_steps(self, history: DataFrame, n: int, steps: int) -> DataFrame:
        """Each series' last n * n_offsets steps as an array, from which every forecast is read: one pass, no join."""
        step = seconds_of(self.rule)
        series = Window.partitionBy("series_id")
        back = (F.unix_timestamp("_last") - F.unix_timestamp("ts")) / step
        near = history.withColumn("_last", F.max("ts").over(series)).withColumn("_b", back)
        near = near.filter((F.col("_b") < n * self.n_offsets) & (F.col("_b") == F.floor("_b")) & F.col("y").isNotNull())
        state = near.groupBy("series_id").agg(F.max("_last").alias("_last"), F.map_from_entries(F.collect_list(F.struct(F.col("_b").cast("int"), "y"))).alias("_m"))
        ahead = state.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
        first = n - 1 - F.pmod(F.col("step") - 1, F.lit(n))
        found = F.filter(F.transform(F.sequence(F.lit(0), F.lit(self.n_offsets - 1)), lambda k: F.try_element_at("_m", (first + k * n).cast("int"))), lambda x: x.isNotNull())
        none = F.raise_error(F.lit("no value of the history lies an offset before this time"))
        pred = F.when(F.size(found) == 0, none).otherwise(_of_array(found, self.agg))
        return ahead.select("series_id", (F.col("_last") + F.make_dt_interval(secs=F.col("step") * step)).alias("ts"), F.col("step").cast("long"), pred.alias("pred"))

    def _by_calendar(self, ahead: DataFrame, history: DataFrame) -> DataFrame:
        unit = self._interval()
        last = history.groupBy("series_id").agg(F.max("ts").alias("_last"))
        at = ahead.join(last, "series_id")
        # the first multiple of the offset that lands in the history: few are needed, as steps are few
        tries = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("step") * self._rule_share()).cast("int") + 1))
        first = F.array_min(F.filter(tries, lambda m: F.col("ts") - m * unit <= F.col("_last")))
        at = at.withColumn("_m", first).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(self.n_offsets - 1))))
        at = at.withColumn("_src", F.col("ts") - (F.col("_m") + F.col("k")).cast("int") * unit)
        joined = at.join(history.select("series_id", F.col("ts").alias("_src"), "y"), ["series_id", "_src"], "left")
        out = joined.groupBy("series_id", "ts", "step").agg(_of_rows(self.agg, "y").alias("pred"), F.count("y").alias("_n"))
        none = F.raise_error(F.lit("no value of the history lies an offset before this time"))
        return out.withColumn("pred", F.when(F.col("_n") == 0, none).otherwise(F.col("pred"))).drop("_n")

    def _interval(self) -> Column:
        number, unit = str(self.offset).split()
        unit = unit.rstrip("s").lower()
        if unit in ("month", "year"):
            return F.expr(f"INTERVAL '{int(number) * (12 if unit == 'year' else 1)}' MONTH")
        days = {"day": 1, "week": 7}
        return F.expr(f"INTERVAL '{int(number) * days[unit]}' DAY") if unit in days else F.expr(f"INTERVAL '{int(number)}' {unit.upper()}")

    def _rule_share(self) -> float:
        """Steps of the grid in an offset, from below, as a share."""
        number, unit = str(self.offset).split()
        seconds = {"month": 28 * 86400, "year": 365 * 86400}.get(unit.rstrip("s").lower()) or seconds_of(unit)
        return seconds_of(self.rule) / (int(number) * seconds)

    # ---- residuals and intervals

    def fitted(self, series: DataFrame) -> DataFrame:
        """(series_id, ts, y, pred): what the rule would have given at each time of the history."""
        if isinstance(self.offset, int):
            w = Window.partitionBy("series_id").orderBy("ts")
            past = F.array(*(F.lag("y", self.offset * k).over(w) for k in range(1, self.n_offsets + 1)))
            rows = series.withColumn("_past", past)
            whole = F.forall("_past", lambda x: x.isNotNull())
            return rows.withColumn("pred", F.when(whole, _of_array(F.col("_past"), self.agg))).drop("_past")
        unit = self._interval()
        at = series.select("series_id", "ts", "y", F.explode(F.sequence(F.lit(1), F.lit(self.n_offsets))).alias("k"))
        src = series.select("series_id", F.col("ts").alias("_src"), F.col("y").alias("_v"))
        joined = at.withColumn("_src", F.col("ts") - F.col("k").cast("int") * unit).join(src, ["series_id", "_src"], "left")
        return joined.groupBy("series_id", "ts").agg(F.first("y").alias("y"), F.when(F.count("_v") == self.n_offsets, _of_rows(self.agg, "_v")).alias("pred"))

    def _in_sample(self, series: DataFrame, seed: int) -> tuple[DataFrame, QuantileBinner]:
        rows = self.fitted(series).filter("y is not null and pred is not null").withColumn("residual", F.col("y") - F.col("pred"))
        binner = QuantileBinner(self.n_bins).fit(rows, "pred")
        return binner.transform(rows, "pred").select("series_id", "ts", "bin", "residual"), binner

    def set_in_sample_residuals(self, series: DataFrame, seed: int = 123) -> None:
        ends = lambda s: s.groupBy("series_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
        if not ends(series).exceptAll(ends(self.history)).isEmpty():
            raise ValueError("the series must cover the range of the training series")
        self.residuals, self.binner = self._in_sample(series, seed)

    def set_out_sample_residuals(self, rows: DataFrame, append: bool = False) -> None:
        """rows: (series_id, ts, y, pred) of times that were not in the history."""
        if self.binner is None:
            raise ValueError("fit with store_residuals first")
        new = self.binner.transform(rows.dropna(subset=["y", "pred"]).withColumn("residual", F.col("y") - F.col("pred")), "pred").select("series_id", "ts", "bin", "residual")
        self.out_residuals = self.out_residuals.unionByName(new) if append and self.out_residuals is not None else new

    def predict_interval(self, steps: int, interval=(5, 95), in_sample: bool = True, binned: bool = True, method: str = "conformal") -> DataFrame:
        if method != "conformal":
            raise ValueError("only conformal intervals are defined for this forecaster")
        coverage = check_interval(interval)
        residuals = self.residuals if in_sample else self.out_residuals
        if residuals is None:
            raise ValueError("there are no residuals of this kind")
        return with_interval(self.predict(steps), residuals, self.binner if binned else None, coverage)
