"""Checks of inputs. Each raises rather than repairs; those that must look at data cost one aggregation."""

from __future__ import annotations

import functools
import warnings
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.session import as_series, from_wide


#: Frames of a collection beyond which it warns.
MANY_FRAMES = 20


class MissingValuesWarning(UserWarning):
    """Rows with missing values were left out."""


class DataTypeWarning(UserWarning):
    """An exogenous column has a type that models may not take."""


class IgnoredArgumentWarning(UserWarning):
    """An argument has no effect here."""


class UnknownLevelWarning(UserWarning):
    """A series to forecast was not among those of the training."""


class LongTrainingWarning(UserWarning):
    """Many fits are ahead."""


class ResidualsUsageWarning(UserWarning):
    """Fewer residuals than asked for, or pooled ones in their place."""


class MissingExogWarning(MissingValuesWarning):
    """Exogenous columns have missing values."""


class FeatureOutOfRangeWarning(UserWarning):
    """A value lies beyond those of the training."""


class TransformedSpaceWarning(UserWarning):
    """Values are in the scale that is regressed, not the original one."""


class InputTypeWarning(UserWarning):
    """The input has a form that is slower than another."""


class OneStepAheadWarning(UserWarning):
    """Every step is forecast from true past values, so errors are smaller than those of a recursion."""


class ExogInterpretationWarning(UserWarning):
    """Coefficients of exogenous columns mean something else than they seem to."""


class SavedModelWarning(UserWarning):
    """A model was saved or read with a loss."""


class VersionWarning(SavedModelWarning):
    """A model was saved by another version."""


def deprecated(use: str, removed_in: str):
    """Marks a function: calling it warns what to use instead."""

    def mark(f):
        @functools.wraps(f)
        def call(*args, **kwargs):
            warnings.warn(f"{f.__name__} goes with version {removed_in}; use {use}", DeprecationWarning, stacklevel=2)
            return f(*args, **kwargs)

        return call

    return mark


def check_exog_range(exog: DataFrame, ranges: dict[str, tuple[float, float]]) -> list[str]:
    """Columns with values beyond the given ranges; warns if there are any. One aggregation."""
    if not ranges:
        return []
    found = exog.agg(*(F.count_if((F.col(c).cast("double") < lo) | (F.col(c).cast("double") > hi)).alias(c) for c, (lo, hi) in ranges.items())).first()
    beyond = [c for c in ranges if found[c]]
    if beyond:
        warnings.warn(f"columns beyond the range of the training: {beyond}", FeatureOutOfRangeWarning, stacklevel=2)
    return beyond


def exog_ranges(exog: DataFrame) -> dict[str, tuple[float, float]]:
    """Least and greatest value of each exogenous column. One aggregation."""
    names = [c for c in exog.columns if c not in ("series_id", "ts")]
    found = exog.agg(*(f(F.col(c).cast("double")).alias(f"{k}_{c}") for c in names for k, f in (("a", F.min), ("b", F.max)))).first()
    return {c: (found[f"a_{c}"], found[f"b_{c}"]) for c in names if found[f"a_{c}"] is not None}


def check_y(series: DataFrame) -> None:
    """(series_id, ts, y) with a number in every row."""
    missing = {"series_id", "ts", "y"} - set(series.columns)
    if missing:
        raise TypeError(f"missing columns: {sorted(missing)}")
    if not isinstance(series.schema["y"].dataType, T.NumericType):
        raise TypeError("y must be numeric")
    if series.filter(F.col("y").isNull() | F.isnan(F.col("y").cast("double"))).limit(1).count():
        raise ValueError("y has missing values")


def check_exog(exog: DataFrame, allow_missing: bool = True) -> None:
    if "ts" not in exog.columns:
        raise TypeError("exog must have ts")
    columns = [c for c in exog.columns if c not in ("series_id", "ts")]
    if not columns:
        raise ValueError("exog has no column of its own")
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    if exog.filter(missing).limit(1).count():
        if not allow_missing:
            raise ValueError("exog has missing values")
        warnings.warn("exog has missing values", MissingExogWarning, stacklevel=2)


def check_exog_types(exog: DataFrame) -> dict[str, str]:
    """Types by name; anything but numbers and booleans warns."""
    kinds = {f.name: f.dataType for f in exog.schema if f.name not in ("series_id", "ts")}
    odd = [n for n, k in kinds.items() if not isinstance(k, (T.NumericType, T.BooleanType))]
    if odd:
        warnings.warn(f"columns that are not numeric: {odd}", DataTypeWarning, stacklevel=2)
    return {n: k.simpleString() for n, k in kinds.items()}


def check_interval(interval: Sequence[float]) -> None:
    if len(interval) != 2:
        raise ValueError("an interval has two percentiles")
    lo, hi = interval
    if not (0 <= lo < 100 and 0 < hi <= 100 and lo < hi):
        raise ValueError("percentiles must rise within [0, 100]")


def check_quantile(q: float | Iterable[float]) -> None:
    if any(not 0 <= x <= 1 for x in ([q] if isinstance(q, (int, float)) else q)):
        raise ValueError("quantiles must lie in [0, 1]")


def check_predict_input(forecaster, steps: int, exog: DataFrame | None = None, last_window: DataFrame | None = None) -> None:
    """Fitted, a positive number of steps, the exogenous columns of the training, and a full last window without gaps."""
    forecaster._check()
    if isinstance(steps, bool) or not isinstance(steps, int) or steps < 1:
        raise ValueError("steps must be a positive integer")
    if forecaster.exog_names:
        if exog is None:
            raise ValueError("the forecaster was fitted with exogenous columns")
        missing = set(forecaster.exog_names) - set(exog.columns)
        if missing:
            raise ValueError(f"missing exogenous columns: {sorted(missing)}")
    elif exog is not None:
        warnings.warn("the forecaster was fitted without exogenous columns", IgnoredArgumentWarning, stacklevel=2)
    if last_window is not None:
        check_y(last_window)
        if last_window.groupBy("series_id").count().filter(F.col("count") < forecaster.window_size).limit(1).count():
            raise ValueError(f"the last window needs {forecaster.window_size} rows")
        known = set(forecaster.levels)
        unknown = [r[0] for r in last_window.select("series_id").distinct().collect() if r[0] not in known]
        if unknown:
            warnings.warn(f"series that the training lacks: {unknown[:5]}", UnknownLevelWarning, stacklevel=2)


def check_residuals(forecaster, in_sample: bool = True, binned: bool = True) -> None:
    kept = forecaster.residuals if in_sample else forecaster.out_residuals
    if kept is None:
        raise ValueError(f"there are no {'in' if in_sample else 'out of'}-sample residuals; store them first")
    if kept.filter(F.col("residual").isNull()).limit(1).count():
        raise ValueError("residuals have missing values")
    if binned and forecaster.binner is None:
        raise ValueError("there are no bins")


def collect_series(data, step_s: int | None = None) -> DataFrame:
    """The long form of a collection: a long frame (series_id, ts, y), a wide one with ts, or a dict of (ts, value) frames.

    A series without a value, and series of different or uneven steps, are errors.
    """
    if isinstance(data, dict):
        if not data:
            raise ValueError("there is no series")
        if len(data) > MANY_FRAMES:
            warnings.warn(f"{len(data)} frames make a plan with as many branches; one long frame is faster", InputTypeWarning, stacklevel=2)
        out = None
        for name, df in data.items():
            values = [c for c in df.columns if c != "ts"]
            if len(values) != 1:
                raise ValueError(f"{name!r} must have one column besides ts")
            one = as_series(df, F.lit(name), "ts", values[0])
            out = one if out is None else out.unionByName(one)
    elif "series_id" in data.columns:
        values = [c for c in data.columns if c not in ("series_id", "ts")]
        if len(values) > 1 and "y" not in values:
            warnings.warn(f"only {values[0]!r} is used", IgnoredArgumentWarning, stacklevel=2)
        out = as_series(data, "series_id", "ts", "y" if "y" in values else values[0])
    else:
        out = from_wide(data, "ts")
    n = F.count(F.lit(1))
    seconds = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))
    stats = out.groupBy("series_id").agg(F.count("y").alias("known"), n.alias("n"), (seconds / F.nullif(n - 1, F.lit(0))).alias("step"))
    found = stats.agg(F.min("known"), F.count_distinct("step"), F.min("step")).first()
    if found[0] is None:
        raise ValueError("there is no series")
    if found[0] == 0:
        raise ValueError("a series has no value")
    if found[1] > 1 or (step_s and found[2] and found[2] != step_s):
        raise ValueError("the series must share one step; put them on a grid first")
    return out
