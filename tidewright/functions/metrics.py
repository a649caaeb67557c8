"""Accuracy and calibration metrics, all as aggregates over rows of (y, pred) and the like.

Each function gives a Column to use in agg(), so that many metrics of many groups are one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _both(y: str, p: str, value: Column) -> Column:
    """Rows where either is missing do not count."""
    return F.when(F.col(y).isNotNull() & F.col(p).isNotNull(), value)


def mse(y: str = "y", p: str = "pred") -> Column:
    return F.avg(F.pow(F.col(y) - F.col(p), 2))


def rmse(y: str = "y", p: str = "pred") -> Column:
    return F.sqrt(mse(y, p))


def mae(y: str = "y", p: str = "pred") -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def mape(y: str = "y", p: str = "pred") -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)) / F.greatest(F.abs(F.col(y)), F.lit(2.220446049250313e-16)))


def smape(y: str = "y", p: str = "pred") -> Column:
    scale = (F.abs(F.col(y)) + F.abs(F.col(p))) / 2
    return 100 * F.avg(_both(y, p, F.when(scale == 0, 0.0).otherwise(F.abs(F.col(y) - F.col(p)) / F.nullif(scale, F.lit(0.0)))))


def _log1p(c: str) -> Column:
    """NaN below -1 and -infinity at -1, where Spark gives NULL, which a mean would skip."""
    return F.when(F.col(c) < -1, float("nan")).when(F.col(c) == -1, float("-inf")).otherwise(F.log1p(c))


def msle(y: str = "y", p: str = "pred") -> Column:
    return F.avg(F.pow(_log1p(y) - _log1p(p), 2))


def medae(y: str = "y", p: str = "pred") -> Column:
    return F.percentile(F.abs(F.col(y) - F.col(p)), F.lit(0.5))


def coverage(y: str = "y", low: str = "lower_bound", high: str = "upper_bound") -> Column:
    """Share of all rows; one with a missing value or bound is not covered."""
    return F.avg(F.coalesce(F.col(y).between(F.col(low), F.col(high)), F.lit(False)).cast("double"))


def pinball(alpha: float, y: str = "y", p: str = "pred") -> Column:
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in [0, 1]")
    d = F.col(y) - F.col(p)
    return F.avg(F.greatest(alpha * d, (alpha - 1) * d))


def _counts(y: str, p: str) -> tuple[Column, Column, Column, Column]:
    a, b = F.col(y).cast("boolean"), F.col(p).cast("boolean")
    return F.count_if(a & b), F.count_if(~a & b), F.count_if(a & ~b), F.count_if(~a & ~b)


def accuracy(y: str = "y", p: str = "pred") -> Column:
    return F.avg((F.col(y) == F.col(p)).cast("double"))


def precision(y: str = "y", p: str = "pred") -> Column:
    tp, fp, *_ = _counts(y, p)
    return F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))


def recall(y: str = "y", p: str = "pred") -> Column:
    tp, _, fn, _ = _counts(y, p)
    return F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))


def f1(y: str = "y", p: str = "pred") -> Column:
    tp, fp, fn, _ = _counts(y, p)
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def balanced_accuracy(y: str = "y", p: str = "pred") -> Column:
    tp, fp, fn, tn = _counts(y, p)
    return (F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)) + F.coalesce(F.try_divide(tn, tn + fp), F.lit(0.0))) / 2


#: The metrics that need nothing but actual and predicted values.
REGISTRY = {
    "mean_squared_error": mse,
    "root_mean_squared_error": rmse,
    "mean_absolute_error": mae,
    "mean_absolute_percentage_error": mape,
    "symmetric_mean_absolute_percentage_error": smape,
    "mean_squared_log_error": msle,
    "median_absolute_error": medae,
    "accuracy_score": accuracy,
    "balanced_accuracy_score": balanced_accuracy,
    "f1_score": f1,
    "precision_score": precision,
    "recall_score": recall,
}
#: Those that are scaled by the training series.
SCALED = ("mean_absolute_scaled_error", "root_mean_squared_scaled_error")


def metric(name):
    """A metric by name, or a function of (y, pred) column names that gives an aggregate."""
    if callable(name):
        return name
    if name not in REGISTRY:
        raise ValueError(f"unknown metric {name!r}; known: {sorted([*REGISTRY, *SCALED])}")
    return REGISTRY[name]


def naive_scale(train: DataFrame, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """(by, mae_scale, rmse_scale) of the one-step naive forecast in the training rows."""
    d = F.col("y") - F.lag("y").over(Window.partitionBy("series_id", *(c for c in by if c != "series_id")).orderBy("ts"))
    return train.withColumn("_d", d).groupBy(*by).agg(F.avg(F.abs("_d")).alias("mae_scale"), F.sqrt(F.avg(F.pow("_d", 2))).alias("rmse_scale"))


def score(rows: DataFrame, metrics: Sequence, by: Sequence[str] = (), train: DataFrame | None = None) -> DataFrame:
    """One row for each group with a column for each metric. train: rows of (by, series_id, ts, y) for scaled metrics."""
    by = list(by)
    named = [m.__name__ if callable(m) else m for m in metrics]
    plain = [m for m in metrics if m not in SCALED]
    aggs = [metric(m)().alias(m.__name__ if callable(m) else m) for m in plain]
    if len(plain) < len(metrics):
        if train is None:
            raise ValueError("scaled metrics need training rows")
        aggs += [mae().alias("_mae"), rmse().alias("_rmse")]
    out = rows.groupBy(*by).agg(*aggs)
    if len(plain) < len(metrics):
        scale = naive_scale(train, by or ["series_id"]) if by else naive_scale(train).agg(F.avg("mae_scale").alias("mae_scale"), F.avg("rmse_scale").alias("rmse_scale"))
        out = out.join(scale, by) if by else out.crossJoin(F.broadcast(scale))  # one row each
        out = out.withColumns({"mean_absolute_scaled_error": F.try_divide("_mae", "mae_scale"), "root_mean_squared_scaled_error": F.try_divide("_rmse", "rmse_scale")})
    return out.select(*by, *named)


def crps_ensemble(members: DataFrame, keys: Sequence[str], y: str = "y", value: str = "pred") -> DataFrame:
    """(keys, crps): the integral of the squared distance of the members' step function from the observation's.

    members: a row for each member, with the observation repeated. By the identity mean|x - y| - mean|x - x'| / 2, where the
    second term comes from ranks, so one sort of each group's members is all it takes.
    """
    w = Window.partitionBy(*keys).orderBy(value)
    ranked = members.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    spread = F.sum((2 * F.col("_r") - F.col("_n") - 1) * F.col(value)) / F.pow(F.max("_n"), 2)
    return ranked.groupBy(*keys).agg((F.avg(F.abs(F.col(value) - F.col(y))) - spread).alias("crps"))


def crps_quantiles(df: DataFrame, quantiles: Sequence[str], levels: Sequence[float], y: str = "y", points: int = 1000) -> DataFrame:
    """df with crps of the distribution function that is linear between quantiles, by trapezoids.

    The range runs over all quantiles and the observation, widened by a tenth of its length, so it holds for any sign.
    """
    q = F.array(*(F.col(c) for c in quantiles))
    lo, hi = F.least(F.array_min(q), F.col(y)), F.greatest(F.array_max(q), F.col(y))
    margin = F.greatest((hi - lo) * 0.1, F.lit(1e-9))
    step = (hi - lo + 2 * margin) / (points - 1)
    pairs = [(F.col(a), F.col(b), p, r) for a, b, p, r in zip(quantiles, quantiles[1:], levels, levels[1:], strict=False)]

    def cdf(x: Column) -> Column:
        out = F.when(x < F.col(quantiles[0]), F.lit(0.0))
        for a, b, p, r in pairs:
            out = out.when(x < b, p + (r - p) * F.coalesce(F.try_divide(x - a, b - a), F.lit(1.0)))
        return out.otherwise(F.lit(1.0))

    def gap(i: Column) -> Column:
        x = lo - margin + i * step
        return F.pow(cdf(x) - F.when(x >= F.col(y), 1.0).otherwise(0.0), 2)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), gap), F.lit(0.0), lambda s, v: s + v)
    ends = (gap(F.lit(0)) + gap(F.lit(points - 1))) / 2
    return df.withColumn("crps", (total - ends) * step)


def compare(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """MAE and MSE of predictions (ts, pred) against actuals (ts, y) at the times that both have, missing values skipped."""
    both = actual.join(predicted, [c for c in ("series_id", "ts") if c in actual.columns and c in predicted.columns])
    return both.agg(mae().alias("MAE"), mse().alias("MSE"))
