"""Curation: outliers, missing-value weights, splits, N-to-1 aggregation and quantile bins."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.grid import fill
from tidewright.session import over_series, stored, with_pos

# ---- outliers ---------------------------------------------------------------------------------------------------------


def outside(lower: float | None, upper: float | None, y: str = "y") -> Column:
    """Strictly beyond a limit; a missing limit or value is no outlier."""
    out = F.lit(False)
    if lower is not None:
        out = out | (F.col(y) < lower)
    if upper is not None:
        out = out | (F.col(y) > upper)
    return F.coalesce(out, F.lit(False))


def mask_outside(series: DataFrame, lower: float | None = None, upper: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(series with values beyond the limits set to NULL, (series_id, n_outliers))."""
    hit = outside(lower, upper)
    return series.withColumn("y", F.when(~hit, F.col("y"))), series.groupBy("series_id").agg(F.count_if(hit).alias("n_outliers"))


class IsolationForest:
    """An isolation forest for one column: random splits isolate rare values in few steps.

    Trees are built on samples, so fitting costs the same for any length of series.
    """

    def __init__(self, trees: int = 100, sample: int = 256, seed: int = 1234):
        self.trees, self.sample, self.seed = trees, sample, seed

    @staticmethod
    def _depth(n: float) -> float:
        """The mean depth of an unsuccessful search in a binary tree of n values."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def fit(self, x: np.ndarray) -> IsolationForest:
        r = np.random.default_rng(self.seed)
        x = np.asarray(x, float)
        self.steps = []
        n = min(self.sample, len(x))
        deepest = int(np.ceil(np.log2(max(n, 2))))
        for _ in range(self.trees):
            # in one dimension a tree is a step function: cuts, and the depth between them
            cuts, depths = [], []

            def grow(v, lo, depth, cuts=cuts, depths=depths):
                if depth == deepest or len(v) <= 1 or v.min() == v.max():
                    depths.append((lo, depth + self._depth(len(v))))
                    return
                at = r.uniform(v.min(), v.max())
                cuts.append(at)
                grow(v[v < at], lo, depth + 1)
                grow(v[v >= at], at, depth + 1)

            grow(r.choice(x, n, replace=False), -np.inf, 0)
            self.steps.append((np.array([lo for lo, _ in depths]), np.array([d for _, d in depths])))
        self.norm = self._depth(n) or 1.0
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Near 1 for isolated values, below 0.5 for common ones."""
        total = np.zeros(len(x))
        for los, depths in self.steps:
            total += depths[np.searchsorted(los, x, "right") - 1]
        return 2 ** -(total / len(self.steps) / self.norm)


#: Values of a series that a task counts at once.
PART_ROWS = 100_000


def weighted_quantile(values: np.ndarray, counts: np.ndarray, q: float) -> float:
    """np.quantile of values that come so many times each."""
    order = np.argsort(values)
    v, ends = values[order], np.cumsum(counts[order])
    at = q * (ends[-1] - 1)
    low, high = (v[np.searchsorted(ends, k, "right")] for k in (np.floor(at), np.ceil(at)))
    return float(low + (high - low) * (at - np.floor(at)))


def flag_outliers(series: DataFrame, contamination: float = 0.1, seed: int = 1234, sample: int = 20_000) -> DataFrame:
    """series with is_outlier: the share `contamination` of each series' known values that an isolation forest finds rarest.

    Trees are grown on samples, from at most `sample` values of a series, by hash. In one dimension their score is a step function, so
    the threshold comes from counts of all values between its cuts, part by part, and every value is flagged by the few places where
    scores pass it; no series is gathered.
    """
    if not 0 < contamination <= 0.5:
        raise ValueError("contamination must lie in (0, 0.5]")
    known = series.filter("y is not null")
    n = known.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n"))
    some = known.join(n, "series_id").filter(F.pmod(F.xxhash64(F.lit(seed), "ts", "y"), F.lit(1_000_003)) < F.lit(1_000_003.0) * sample / F.col("_n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        f = IsolationForest(seed=seed).fit(np.sort(pdf["y"].to_numpy(float)))
        edges = np.unique(np.concatenate([lo for lo, _ in f.steps]))
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[:1], "edges": [edges.tolist()], "scores": [f.score(edges).tolist()]})

    steps = stored(some.select("series_id", "y").groupBy("series_id").applyInPandas(fit, "series_id string, edges array<double>, scores array<double>"), "steps")
    parts = n.select("series_id", F.ceil(F.col("_n") / PART_ROWS).alias("_parts"))
    rows = known.join(parts, "series_id").select("series_id", "y", F.pmod(F.xxhash64("ts"), "_parts").alias("part"))
    cuts = steps.join(parts, "series_id").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))

    def count(pdf: pd.DataFrame, cut: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(cut):
            return pd.DataFrame({"series_id": [], "n": []})
        edges = np.asarray(cut["edges"].iloc[0], float)
        at = np.maximum(np.searchsorted(edges, pdf["y"].to_numpy(float), "right") - 1, 0)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[:1], "n": [np.bincount(at, minlength=len(edges)).tolist()]})

    counts = rows.groupBy("series_id", "part").cogroup(cuts.groupBy("series_id", "part")).applyInPandas(count, "series_id string, n array<long>")

    def decide(pdf: pd.DataFrame, cut: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(cut):
            return pd.DataFrame({"series_id": [], "edges": [], "rare": []})
        edges, scores = (np.asarray(cut[c].iloc[0], float) for c in ("edges", "scores"))
        rare = scores > weighted_quantile(scores, np.sum(pdf["n"].tolist(), axis=0), 1 - contamination)
        turns = np.flatnonzero(np.concatenate([[True], rare[1:] != rare[:-1]]))
        return pd.DataFrame({"series_id": cut["series_id"].iloc[:1], "edges": [np.maximum(edges[turns], -1.7e308).tolist()], "rare": [rare[turns].tolist()]})

    decided = counts.groupBy("series_id").cogroup(steps.groupBy("series_id")).applyInPandas(decide, "series_id string, edges array<double>, rare array<boolean>")
    joined = series.join(decided, "series_id", "left")
    at = F.size(F.filter("edges", lambda e: e <= F.col("y")))
    hit = F.when((at > 0) & F.col("y").isNotNull(), F.try_element_at("rare", F.greatest(at, F.lit(1))))
    return joined.withColumn("is_outlier", F.coalesce(hit, F.lit(False))).drop("edges", "rare")


def mark_outliers(series: DataFrame, contamination: float = 0.1, seed: int = 1234) -> DataFrame:
    """series with outliers set to NULL, and is_outlier for every series."""
    out = flag_outliers(series, contamination, seed)
    return out.withColumn("y", F.when(~F.col("is_outlier"), F.col("y")))


def get_outliers(series: DataFrame, contamination: float = 0.01, seed: int = 1234, original: DataFrame | None = None) -> DataFrame:
    """The outliers themselves: (series_id, ts, y). original: (series_id, ts, y) with the values to report, such as those before a fill."""
    if series.isEmpty():
        raise ValueError("the table is empty")
    found = flag_outliers(series, contamination, seed).filter("is_outlier").drop("is_outlier")
    if original is None:
        return found
    return found.drop("y").join(original.select("series_id", "ts", "y"), ["series_id", "ts"])


# ---- weights ----------------------------------------------------------------------------------------------------------


def missing_weights(series: DataFrame, window_size: int = 72, mode: str = "documented") -> DataFrame:
    """series filled, with weight.

    documented: weight 0 for rows with a missing value among themselves and the window_size rows before, else 1.
    flags_off: weight 1 everywhere, for results of pipelines that never saw a flag.
    """
    if window_size <= 0:
        raise ValueError("window_size must be positive")
    if mode == "flags_off":
        return fill(series).withColumn("weight", F.lit(1.0))
    if mode != "documented":
        raise ValueError("mode must be 'documented' or 'flags_off'")
    w = over_series().rowsBetween(-window_size, 0)
    return fill(series.withColumn("weight", 1.0 - F.max(F.col("y").isNull().cast("double")).over(w)))


def check_window(series: DataFrame, window_size: int) -> DataFrame:
    """series; raises ValueError if empty or if a series has no more rows than the window."""
    sizes = series.groupBy("series_id").count()
    if sizes.isEmpty():
        raise ValueError("the table is empty")
    if not sizes.filter(F.col("count") <= window_size).isEmpty():
        raise ValueError("window_size must be less than the rows of every series")
    return series


def look_up_weights(index: DataFrame, weights: DataFrame, on: Sequence[str] = ("ts",)) -> DataFrame:
    """index with weight; raises when run if a key has none."""
    out = index.join(weights, list(on), "left")
    return out.withColumn("weight", F.when(F.col("weight").isNull(), F.raise_error(F.lit("an index value has no weight"))).otherwise(F.col("weight")))


def check_weights(weights: DataFrame) -> None:
    bad = weights.agg(F.count_if(F.col("weight").isNull() | F.isnan("weight")), F.count_if(F.col("weight") < 0), F.sum("weight")).first()
    if bad[0]:
        raise ValueError("weights have missing values")
    if bad[1]:
        raise ValueError("weights are negative")
    if not bad[2]:
        raise ValueError("weights sum to 0")


def missing_share(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id").agg(F.count_if(F.col("y").isNull()).alias("n_missing"), (100 * F.avg(F.col("y").isNull().cast("double"))).alias("pct_missing"))


# ---- splits -----------------------------------------------------------------------------------------------------------


def split_absolute(series: DataFrame, end_train: str, end_validation: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test by time; both ends are included, so a boundary row is in two parts."""
    a, b = F.lit(end_train).cast("timestamp"), F.lit(end_validation).cast("timestamp")
    return series.filter(F.col("ts") <= a), series.filter((F.col("ts") >= a) & (F.col("ts") <= b)), series.filter(F.col("ts") >= b)


def split_label(series: DataFrame, share_train: float, share_validation: float) -> DataFrame:
    """series with pos and part: train, validation or test by position, sizes rounded half to even."""
    if not (0 <= share_train <= 1 and 0 <= share_validation <= 1):
        raise ValueError("shares must lie in [0, 1]")
    if round(share_train + share_validation, 10) > 1:
        raise ValueError("shares add up to more than 1")
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    train = F.least(F.bround(n * F.lit(float(share_train))), n)
    validation = F.least(F.bround(n * F.lit(float(share_validation))), n - train)
    part = F.when(F.col("pos") < train, "train").when(F.col("pos") < train + validation, "validation").otherwise("test")
    return with_pos(series).withColumn("part", part)


def split_relative(series: DataFrame, share_train: float, share_validation: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    if series.isEmpty():
        raise ValueError("the table is empty")
    labelled = split_label(series, share_train, share_validation)
    return tuple(labelled.filter(F.col("part") == p).drop("pos", "part") for p in ("train", "validation", "test"))


def slice_time(df: DataFrame, start: str, end: str) -> DataFrame:
    """Both ends included."""
    return df.filter(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def slice_pos(df: DataFrame, start: int, end: int) -> DataFrame:
    """Half open."""
    return df.filter((F.col("pos") >= start) & (F.col("pos") < end))


# ---- N to 1 -----------------------------------------------------------------------------------------------------------


def weighted_sum(predictions: DataFrame, weights: DataFrame, value: str = "pred") -> DataFrame:
    """(ts, combined): the sum over series of value times weight; a missing value makes the time's sum missing. Series without a weight do not count."""
    joined = predictions.join(weights.select("series_id", "w"), "series_id")
    total = F.sum(F.col(value) * F.col("w"))
    return joined.groupBy("ts").agg(F.when(F.count(F.lit(1)) == F.count(value), total).alias("combined"))


def combine(wide: DataFrame, weights: dict[str, float] | Sequence[float] | None = None, index: str = "ts") -> DataFrame:
    """The same for one column a series, as one projection. weights: by name, or by position, or 1 for each."""
    columns = [c for c in wide.columns if c != index]
    if weights is None:
        weights = dict.fromkeys(columns, 1.0)
    elif not isinstance(weights, dict):
        if len(weights) != len(columns):
            raise ValueError("there must be a weight for each column")
        weights = dict(zip(columns, weights, strict=True))
    missing = set(weights) - set(columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.col(c) * F.lit(float(w))
    return wide.select(index, total.alias("combined"))


# ---- quantile bins ----------------------------------------------------------------------------------------------------


#: alpha and beta of the quantile definitions that interpolate between order statistics; the others are steps.
_PLACES = {"interpolated_inverted_cdf": (0, 1), "hazen": (1 / 2, 1 / 2), "weibull": (0, 0), "linear": (1, 1), "median_unbiased": (1 / 3, 1 / 3), "normal_unbiased": (3 / 8, 3 / 8)}
METHODS = (*_PLACES, "inverted_cdf", "averaged_inverted_cdf", "closest_observation")


def quantile_edges(df: DataFrame, value: str, marks: Sequence[float], by: Sequence[str], method: str = "linear") -> DataFrame:
    """(by, edges): the quantiles at marks by one of nine definitions, from the order statistics that each needs."""
    if method == "linear":
        return df.groupBy(*by).agg(F.percentile(value, F.array(*(F.lit(float(q)) for q in marks))).alias("edges"))
    w = Window.partitionBy(*(by or [F.lit(0)]))
    ranked = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), F.row_number().over(w.orderBy(value)).alias("_r"), F.count(F.lit(1)).over(w).alias("_n"))
    n, edges = F.max("_n"), []
    for q in marks:
        if method in _PLACES:
            a, b = _PLACES[method]
            h = n * q + a + q * (1 - a - b)  # from 1
            low, part = F.floor(h), h - F.floor(h)
        else:
            h = n * q - (0.5 if method == "closest_observation" else 0)
            low, part = F.floor(h), h - F.floor(h)
            whole = part == 0
            if method == "averaged_inverted_cdf":
                part = F.when(whole, F.lit(0.5)).otherwise(F.lit(1.0))
            elif method == "closest_observation":
                part = F.when(whole & (low % 2 == 0), F.lit(0.0)).otherwise(F.lit(1.0))
            else:
                part = F.when(whole, F.lit(0.0)).otherwise(F.lit(1.0))
        edges.append((low, part))
    at = ranked.groupBy(*by).agg(n.alias("_n"), *(x.cast("double").alias(f"_{k}{i}") for i, e in enumerate(edges) for k, x in zip(("low", "part"), e, strict=True)))
    joined = ranked.drop("_n").join(at, list(by)) if by else ranked.drop("_n").crossJoin(F.broadcast(at))  # one row
    clip = lambda x: F.greatest(F.lit(1), F.least(F.col("_n"), x))
    pick = lambda x: F.max(F.when(F.col("_r") == clip(x), F.col("_v")))
    parts = [(pick(F.col(f"_low{i}")), pick(F.col(f"_low{i}") + 1), F.max(f"_part{i}")) for i in range(len(edges))]
    return joined.groupBy(*by).agg(F.array(*(lo + (hi - lo) * p for lo, hi, p in parts)).alias("edges"))


@dataclass
class QuantileBinner:
    """Bins between quantiles, for each series and pooled. method: one of METHODS; subsample: rows of a group, by hash, from which the
    quantiles come (all by default).

    Edges that coincide are merged, with a warning; values beyond the outer edges go to the outer bins. `edges` is a table
    with a short array for each series, joined by broadcast when values are binned.
    """

    n_bins: int = 10
    by: Sequence[str] = ("series_id",)
    method: str = "linear"
    subsample: int | None = None
    seed: int = 123

    def __post_init__(self):
        if self.n_bins < 2:
            raise ValueError("n_bins must be at least 2")
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {sorted(METHODS)}")
        if self.subsample is not None and self.subsample < 1:
            raise ValueError("subsample must be positive")

    def fit(self, df: DataFrame, value: str) -> QuantileBinner:
        if self.subsample is not None:
            order = F.row_number().over(Window.partitionBy(*(self.by or [F.lit(0)])).orderBy(F.xxhash64(F.lit(self.seed), *df.columns)))
            df = df.withColumn("_place", order).filter(F.col("_place") <= self.subsample).drop("_place")
        marks = [i / self.n_bins for i in range(self.n_bins + 1)]
        edges = quantile_edges(df, value, marks, list(self.by), self.method)
        self.edges = edges.withColumn("edges", F.array_distinct("edges"))
        return self

    def check(self) -> QuantileBinner:
        if not self.edges.filter(F.size("edges") <= self.n_bins).isEmpty():
            warnings.warn("some quantiles coincide; there are fewer bins", stacklevel=2)
        return self

    def intervals(self) -> DataFrame:
        return self.edges.select(*self.by, F.posexplode(F.transform(F.slice("edges", 1, F.greatest(F.size("edges") - 1, F.lit(1))), lambda lo, i: F.struct(lo.alias("lo"), F.coalesce(F.get("edges", i + 1), lo).alias("hi")))).alias("bin", "x")).select(*self.by, "bin", "x.lo", "x.hi")

    def transform(self, df: DataFrame, value: str, out: str = "bin", how: str = "inner") -> DataFrame:
        """df with the bin of value. how='left': rows of groups without edges stay, without a bin."""
        joined = df.join(self.edges, list(self.by), how) if self.by else df.crossJoin(F.broadcast(self.edges))
        inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
        return joined.withColumn(out, F.size(F.filter(inner, lambda e: e <= F.col(value))).cast("int")).drop("edges")
