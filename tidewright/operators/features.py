"""Lag, rolling, difference and exogenous features as window expressions over (series_id, ts, y).

All features of a table share one partitioning and order, so that Spark shuffles and sorts once for all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.session import over_series


def normalise_lags(lags: int | Iterable[int] | None) -> list[int]:
    """n stands for 1 to n; otherwise sorted distinct positive integers."""
    if lags is None:
        return []
    if isinstance(lags, bool) or (isinstance(lags, int) and lags < 1):
        raise ValueError("lags must be positive integers")
    if isinstance(lags, int):
        return list(range(1, lags + 1))
    found = list(lags)
    if any(isinstance(x, bool) or int(x) != x for x in found):
        raise TypeError("lags must be integers")
    if any(x < 1 for x in found):
        raise ValueError("lags must be positive integers")
    return sorted({int(x) for x in found})


def lags_grid(lags: Iterable | dict | None) -> dict[str, list[int]]:
    """Named lag sets, for comparing several."""
    if lags is None:
        return {"None": []}
    if isinstance(lags, dict):
        return {str(k): normalise_lags(v) for k, v in lags.items()}
    return {str(x): normalise_lags(x) for x in lags}


def lag_columns(lags: Sequence[int], y: str = "y") -> dict[str, Column]:
    return {f"lag_{i}": F.lag(y, i).over(over_series()) for i in lags}


def _ewm(frame, y: str, alpha: float) -> Column:
    v = F.collect_list(y).over(frame)
    k = F.transform(v, lambda _, i: F.pow(F.lit(1 - alpha), F.size(v) - 1 - i))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return total(F.zip_with(v, k, lambda x, w: x * w)) / total(k)


#: Statistics of a window: (frame, column) -> expression.
STATISTICS: dict[str, Callable[[Window, str], Column]] = {
    "mean": lambda f, y: F.avg(y).over(f),
    "std": lambda f, y: F.when(F.count(y).over(f) > 0, F.coalesce(F.stddev_samp(y).over(f), F.lit(0.0))),
    "std_pop": lambda f, y: F.stddev_pop(y).over(f),
    "min": lambda f, y: F.min(y).over(f),
    "max": lambda f, y: F.max(y).over(f),
    "sum": lambda f, y: F.sum(y).over(f),
    "median": lambda f, y: F.percentile(y, F.lit(0.5)).over(f),
    "ratio_min_max": lambda f, y: F.try_divide(F.min(y).over(f), F.max(y).over(f)),
    "coef_variation": lambda f, y: F.when(F.count(y).over(f) <= 1, F.lit(0.0)).otherwise(F.try_divide(F.stddev_samp(y).over(f), F.avg(y).over(f))),
    "ewm": lambda f, y: _ewm(f, y, 0.3),
}


@dataclass
class RollingFeatures:
    """Statistics over the last rows of a series, named roll_{statistic}_{size}, sizes before statistics.

    closed: 'left' ends the window before the row itself, which is what a forecast can know; 'right' includes the row.
    A window with fewer than `size` values gives NULL. std divides by n - 1; std_pop by n.
    custom: name -> function of a pandas Series; these run in grouped pandas, the rest as window expressions.
    """

    stats: Sequence[str]
    window_sizes: int | Sequence[int]
    closed: str = "left"
    custom: dict[str, Callable[[pd.Series], float]] = field(default_factory=dict)

    def __post_init__(self):
        if isinstance(self.window_sizes, int):
            self.window_sizes = [self.window_sizes]
        if any(s < 1 for s in self.window_sizes):
            raise ValueError("window sizes must be positive")
        unknown = set(self.stats) - set(STATISTICS) - set(self.custom)
        if unknown:
            raise ValueError(f"unknown statistics: {sorted(unknown)}")
        if self.closed not in ("left", "right"):
            raise ValueError("closed must be 'left' or 'right'")
        if len(set(self.names)) != len(self.names):
            raise ValueError("feature names repeat")

    @property
    def names(self) -> list[str]:
        return [f"roll_{s}_{n}" for n in self.window_sizes for s in self.stats]

    @property
    def max_size(self) -> int:
        return max(self.window_sizes)

    def columns(self, y: str = "y") -> dict[str, Column]:
        shift = 0 if self.closed == "right" else 1
        out = {}
        for n in self.window_sizes:
            frame = over_series().rowsBetween(-(n - 1) - shift, -shift)
            for s in self.stats:
                if s in STATISTICS:
                    out[f"roll_{s}_{n}"] = F.when(F.count(y).over(frame) >= n, STATISTICS[s](frame, y))
        return out

    def transform(self, series: DataFrame, halo: str | None = None) -> DataFrame:
        """series with the features. halo: a unit of date_trunc; then blocks of a series are computed apart, each with the
        rows before it that its windows need, so that no task holds a whole series. Blocks must be longer than the windows."""
        if halo and not self.custom:
            return self._in_blocks(series, halo)
        out = series.withColumns(self.columns())
        return self._custom(out) if self.custom else out

    def _in_blocks(self, series: DataFrame, unit: str) -> DataFrame:
        need = self.max_size + (0 if self.closed == "right" else 1)
        block = series.withColumn("_block", F.date_trunc(unit, "ts")).withColumn("_own", F.lit(True))
        back = F.row_number().over(Window.partitionBy("series_id", "_block").orderBy(F.col("ts").desc()))
        following = block.select("series_id", "_block").distinct().withColumn("_next", F.lead("_block").over(Window.partitionBy("series_id").orderBy("_block")))
        tails = block.withColumn("_back", back).filter(F.col("_back") <= need).drop("_back").join(following, ["series_id", "_block"]).filter("_next is not null")
        tails = tails.withColumn("_block", F.col("_next")).withColumn("_own", F.lit(False)).drop("_next")
        renamed = block.unionByName(tails)
        shift = 0 if self.closed == "right" else 1
        w = Window.partitionBy("series_id", "_block").orderBy("ts")
        cols = {}
        for n in self.window_sizes:
            frame = w.rowsBetween(-(n - 1) - shift, -shift)
            for s in self.stats:
                cols[f"roll_{s}_{n}"] = F.when(F.count("y").over(frame) >= n, STATISTICS[s](frame, "y"))
        return renamed.withColumns(cols).filter("_own").drop("_block", "_own")

    def _custom(self, df: DataFrame) -> DataFrame:
        names = [f"roll_{s}_{n}" for n in self.window_sizes for s in self.stats if s in self.custom]
        schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
        custom, sizes, shift = self.custom, self.window_sizes, 0 if self.closed == "right" else 1

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("ts")
            for n in sizes:
                for s, f in custom.items():
                    pdf[f"roll_{s}_{n}"] = pdf["y"].rolling(n).apply(f, raw=False).shift(shift)
            return pdf[schema.names]

        return df.groupBy("series_id").applyInPandas(run, schema).select(*df.columns, *self.names)

    def kernel(self, state):
        """The features of the window that ends with the last value of a NumPy array (values x lanes), for recursive forecasts."""
        import numpy as np

        fs = {
            "mean": lambda x: x.mean(axis=0),
            "std": lambda x: x.std(axis=0, ddof=1) if len(x) > 1 else np.zeros(x.shape[1:]),
            "std_pop": lambda x: x.std(axis=0),
            "min": lambda x: x.min(axis=0),
            "max": lambda x: x.max(axis=0),
            "sum": lambda x: x.sum(axis=0),
            "median": lambda x: np.median(x, axis=0),
            "ratio_min_max": lambda x: x.min(axis=0) / x.max(axis=0),
            "coef_variation": lambda x: x.std(axis=0, ddof=1) / x.mean(axis=0) if len(x) > 1 else np.zeros(x.shape[1:]),
            "ewm": lambda x: np.tensordot(w := 0.7 ** np.arange(len(x) - 1, -1, -1), x, 1) / w.sum(),
        }
        return [fs[s](state[-n:]) if s in fs else np.apply_along_axis(lambda v, s=s: self.custom[s](pd.Series(v)), 0, state[-n:]) for n in self.window_sizes for s in self.stats]


def difference(series: DataFrame, order: int = 1, y: str = "y", out: str = "d") -> DataFrame:
    """The order-th difference of y in out; the first `order` rows are NULL."""
    if order < 1:
        raise ValueError("order must be at least 1")
    df = series.withColumn(out, F.col(y))
    for _ in range(order):
        df = df.withColumn(out, F.col(out) - F.lag(out, 1).over(over_series()))
    return df


def undifference(df: DataFrame, starts: DataFrame, order: int = 1, d: str = "d", out: str = "y", by: Sequence[str] = ("series_id",)) -> DataFrame:
    """Undoes difference() on rows that follow known ones.

    starts: for each series, `tails`, the last values of each lower order just before the rows: y, its first difference, and so on.
    Each cumulative sum runs within a series and path.
    """
    w = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = df.join(starts.select("series_id", "tails"), "series_id").withColumn(out, F.col(d))
    for k in range(order - 1, -1, -1):
        df = df.withColumn(out, F.sum(out).over(w) + F.col("tails")[k])
    return df.drop("tails")


def difference_tails(series: DataFrame, order: int = 1) -> DataFrame:
    """(series_id, tails) at the end of each series, for undifference()."""
    df = series
    for k in range(1, order):
        df = difference(df, k, out=f"_d{k}")
    return df.groupBy("series_id").agg(F.array(*(F.max_by(c, "ts") for c in ["y", *(f"_d{k}" for k in range(1, order))])).alias("tails"))


def exog_inner_merge(series: DataFrame, exog: DataFrame, on: Sequence[str] = ("ts",)) -> DataFrame:
    return series.join(exog, list(on), "inner")


def exog_future(exog: DataFrame, end: str, cov_end: str) -> DataFrame:
    """The rows of exog after end, up to and including cov_end."""
    return exog.filter((F.col("ts") > F.lit(end).cast("timestamp")) & (F.col("ts") <= F.lit(cov_end).cast("timestamp")))


def exog_direct(exog: DataFrame, columns: Sequence[str], steps: int) -> DataFrame:
    """{column}_step_{i}: the value i - 1 rows ahead; steps before columns; rows without all of them go."""
    w = over_series() if "series_id" in exog.columns else Window.orderBy("ts")
    names = {f"{c}_step_{i}": F.lead(c, i - 1).over(w) for i in range(1, steps + 1) for c in columns}
    return exog.withColumns(names).dropna(subset=list(names)).drop(*columns)


def outer_concat(frames: Sequence[DataFrame], on: str = "ts") -> DataFrame:
    """Full outer join of all frames; raises when run if a value is missing."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, on, "full_outer")
    missing = F.lit(False)
    for c in out.columns:
        missing = missing | F.col(c).isNull()
    return out.filter(F.when(missing, F.raise_error(F.lit("covariates have missing values")).cast("boolean")).otherwise(F.lit(True)))


def left_default(left: DataFrame, right: DataFrame, on: str = "ts", default=0) -> DataFrame:
    values = [c for c in right.columns if c != on]
    return left.join(right, on, "left").withColumns({c: F.coalesce(c, F.lit(default)) for c in values})


def same_index(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("ts",)) -> None:
    """Raises ValueError unless both have the same keys."""
    keys = list(keys)
    a, b = left.select(*keys), right.select(*keys)
    if not a.join(b, keys, "left_anti").isEmpty() or not b.join(a, keys, "left_anti").isEmpty():
        raise ValueError("the indexes differ")


def asof(left: DataFrame, right: DataFrame, columns: Sequence[str], by: Sequence[str] = (), backfill: bool = False, block: str | None = None) -> DataFrame:
    """left (ts, ...) with, for each of columns, the last value of right at or before ts.

    Both sides are stacked and filled forward in one window; of one time, right rows come first. by: keys within which to look.
    backfill: rows before right's first get its first value. block: a unit of date_trunc; then blocks of time are filled apart,
    and only each block's last values are carried on, so that no task holds all rows of a key. Without keys the blocks are months.
    """
    by = list(by)
    block = block if block or by else "month"
    value = F.struct(*(F.col(c) for c in columns))
    rest = [c for c in left.columns if c not in (*by, "ts")]
    kind = right.select(value.alias("v")).schema["v"].dataType
    a = left.select(*by, "ts", F.lit(1).alias("_side"), F.struct(F.lit(0).alias("_"), *rest).alias("_row"), F.lit(None).cast(kind).alias("_v"))
    b = right.select(*by, "ts", F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), value.alias("_v"))
    both = a.unionByName(b)
    keys = by or [F.lit(0)]
    if block is None:
        w = Window.partitionBy(*keys).orderBy("ts", "_side")
        filled = {c: F.last(F.col("_v")[c], ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in columns}
        if backfill:
            filled = {c: F.coalesce(x, F.first(F.col("_v")[c], ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))) for c, x in filled.items()}
        return both.withColumns(filled).filter("_side = 1").select(*by, "ts", *(F.col("_row")[c].alias(c) for c in rest), *columns)
    both = both.withColumn("_block", F.date_trunc(block, "ts"))
    known = {c: F.when(F.col("_v")[c].isNotNull(), F.col("ts")) for c in columns}
    ends = both.groupBy(*by, "_block").agg(*(F.max_by(F.col("_v")[c], known[c]).alias(f"_z_{c}") for c in columns), *(F.min_by(F.col("_v")[c], known[c]).alias(f"_a_{c}") for c in columns))
    e = Window.partitionBy(*keys).orderBy("_block")
    carry = {f"_c_{c}": F.last(f"_z_{c}", ignorenulls=True).over(e.rowsBetween(Window.unboundedPreceding, -1)) for c in columns}
    if backfill:
        carry |= {f"_f_{c}": F.first(f"_a_{c}", ignorenulls=True).over(e.rowsBetween(0, Window.unboundedFollowing)) for c in columns}
    ends = ends.withColumns(carry).select(*by, "_block", *carry)
    w = Window.partitionBy(*by, "_block").orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumns({f"_i_{c}": F.last(F.col("_v")[c], ignorenulls=True).over(w) for c in columns}).filter("_side = 1")
    out = inside.join(ends, [*by, "_block"])
    return out.select(*by, "ts", *(F.col("_row")[c].alias(c) for c in rest), *(F.coalesce(f"_i_{c}", f"_c_{c}", *([f"_f_{c}"] if backfill else [])).alias(c) for c in columns))


def time_windows(df: DataFrame, columns: Sequence[str], windows: Sequence[str] = ("1D", "7D"), functions: Sequence[str] = ("mean", "max", "min"), step: int = 3600, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """{column}_window_{window}_{function} over the time before a row, one step back, in seconds rather than rows."""
    from tidewright.session import seconds_of

    aggs = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "std": F.stddev_samp}
    out = {}
    for name in windows:
        frame = Window.partitionBy(*by).orderBy(F.unix_timestamp("ts")).rangeBetween(-(seconds_of(name) + step) + 1, -step)
        for c in columns:
            for f in functions:
                out[f"{c}_window_{name}_{f}"] = aggs[f](c).over(frame)
    return df.withColumns(out)


def interactions(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    """poly_{a}__{b}...: products of distinct columns, up to `degree` at a time."""
    from itertools import combinations

    out = {}
    for k in range(2, degree + 1):
        for some in combinations(columns, k):
            product = F.col(some[0]).cast("double")
            for c in some[1:]:
                product = product * F.col(c)
            out["poly_" + "__".join(some)] = product
    return df.withColumns(out)


def select_features(columns: Sequence[str], weather: Sequence[str] = (), windows: bool = False, holidays: bool = False, poly: bool = False) -> list[str]:
    """Names of exogenous features in order: cyclical ones and raw weather always, the other kinds when asked for."""
    import re

    found = [c for c in columns if re.search(r"_sin$|_cos$", c)]
    if windows:
        found += [c for c in columns if "_window_" in c]
    found += [c for c in columns if c in weather]
    if holidays:
        found += [c for c in columns if c.startswith(("holiday", "is_holiday"))]
    if poly:
        found += [c for c in columns if c.startswith("poly_")]
    return list(dict.fromkeys(found))


def trim(series: DataFrame) -> DataFrame:
    """Without leading and trailing NULLs of each series; series without a value go."""
    known = F.when(F.col("y").isNotNull(), F.col("ts"))
    w = Window.partitionBy("series_id")
    out = series.withColumn("_a", F.min(known).over(w)).withColumn("_b", F.max(known).over(w))
    return out.filter(F.col("ts").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def trim_with_exog(series: DataFrame, exog: DataFrame, on: Sequence[str] = ("series_id", "ts")) -> DataFrame:
    """Trimmed series with exog where there is any."""
    return trim(series).join(exog, list(on), "left")


def ordinal_encode(df: DataFrame, column: str = "series_id", out: str = "code", known: DataFrame | None = None) -> DataFrame:
    """Codes 0, 1, ... of the sorted values of known (df by default); NULL for values that known lacks."""
    values = (known or df).select(column).distinct()
    codes = values.withColumn(out, (F.row_number().over(Window.orderBy(column)) - 1).cast("long"))
    return df.join(codes, column, "left")


def onehot_encode(df: DataFrame, values: Sequence[str], column: str = "series_id") -> DataFrame:
    """A 0/1 column for each value; all 0 for others."""
    return df.withColumns({f"{column}_{v}": F.when(F.col(column) == v, 1.0).otherwise(0.0) for v in sorted(values)})


@dataclass(frozen=True)
class Affine:
    """A scaling of each series by two aggregates: (y - shift) / spread; a spread of 0 counts as 1."""

    shift: Callable[[Column], Column]
    spread: Callable[[Column], Column]


#: Scalings by name. Any other pair of aggregates is an Affine of its own.
SCALINGS = {
    "standard": Affine(F.avg, F.stddev_pop),
    "minmax": Affine(F.min, lambda c: F.max(c) - F.min(c)),
    "maxabs": Affine(lambda c: F.max(c) * 0, lambda c: F.max(F.abs(c))),
    "robust": Affine(lambda c: F.percentile(c, F.lit(0.5)), lambda c: F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))),
}


def scaling(how: str | bool | Affine) -> Affine:
    if isinstance(how, Affine):
        return how
    name = "standard" if how is True else how
    if name not in SCALINGS:
        raise ValueError(f"scaling must be one of {sorted(SCALINGS)} or an Affine")
    return SCALINGS[name]


def scale(series: DataFrame, y: str = "y", out: str = "z", how: str | bool | Affine = "standard") -> tuple[DataFrame, DataFrame]:
    """(series with scaled values, parameters of each series: mean and sd, or what stands for them)."""
    kind = scaling(how)
    c = F.col(y)
    p = series.groupBy("series_id").agg(kind.shift(c).alias("mean"), F.coalesce(F.nullif(kind.spread(c), F.lit(0.0)), F.lit(1.0)).alias("sd"))
    return rescale(series, p, y, out), p


def rescale(series: DataFrame, parameters: DataFrame, y: str = "y", out: str = "z") -> DataFrame:
    """series scaled by parameters that are known."""
    return series.join(parameters, "series_id").withColumn(out, (F.col(y) - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def unscale(df: DataFrame, parameters: DataFrame, z: str = "z", out: str = "y") -> DataFrame:
    return df.join(parameters, "series_id").withColumn(out, F.col(z) * F.col("sd") + F.col("mean")).drop("mean", "sd")
