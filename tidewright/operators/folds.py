"""Time-ordered folds as a small table of half-open position ranges, and one-step-ahead splits."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["fold", "train_start", "train_end", "last_window_start", "last_window_end", "test_start", "test_end", "test_start_with_gap", "test_end_with_gap", "fit_forecaster"]


@dataclass
class TimeSeriesFold:
    """refit: True, False, or n for every n-th fold. skip_folds: keep every n-th fold, or the numbers to leave out.

    initial_train_size None: the forecaster is fitted elsewhere and folds begin after its window.
    """

    steps: int
    initial_train_size: int | None
    window_size: int = 0
    fold_stride: int | None = None
    refit: bool | int = False
    fixed_train_size: bool = True
    gap: int = 0
    skip_folds: int | Sequence[int] | None = None
    allow_incomplete_fold: bool = True

    def __post_init__(self):
        for name in ("steps", "fold_stride", "initial_train_size"):
            v = getattr(self, name)
            if v is not None and (isinstance(v, bool) or not isinstance(v, int) or v < 1):
                raise ValueError(f"{name} must be a positive integer")
        if self.gap < 0 or self.window_size < 0:
            raise ValueError("gap and window_size must not be negative")
        if self.initial_train_size is None and self.refit:
            raise ValueError("refit needs initial_train_size")
        if self.initial_train_size is None and not self.window_size:
            raise ValueError("without initial_train_size a window_size is needed")

    def set_params(self, **params) -> TimeSeriesFold:
        known = {f.name for f in fields(self)}
        for k in set(params) - known:
            warnings.warn(f"{k} is no parameter and is ignored", stacklevel=2)
        for k, v in params.items():
            if k in known:
                setattr(self, k, v)
        self.__post_init__()
        return self

    def split(self, spark: SparkSession, n: int) -> DataFrame:
        """The folds of a series of n rows."""
        init = self.initial_train_size if self.initial_train_size is not None else self.window_size
        stride = self.fold_stride or self.steps
        if init + self.gap >= n:
            raise ValueError("there are no rows left to test")
        last = -(-(n - init - self.gap) // stride) - 1
        i = F.col("i")
        test_start = init + i * stride
        moving = self.refit is not False and self.initial_train_size is not None
        folds = spark.range(last + 1).select(F.col("id").alias("i"))
        folds = folds.select(
            i,
            (i * stride if moving and self.fixed_train_size else F.lit(0)).cast("long").alias("train_start"),
            (test_start if moving else F.lit(init)).cast("long").alias("train_end"),
            (test_start - self.window_size).cast("long").alias("last_window_start"),
            test_start.cast("long").alias("last_window_end"),
            test_start.cast("long").alias("test_start"),
            F.least(test_start + self.gap + self.steps, F.lit(n)).cast("long").alias("test_end"),
            (test_start + self.gap).cast("long").alias("test_start_with_gap"),
            F.least(test_start + self.gap + self.steps, F.lit(n)).cast("long").alias("test_end_with_gap"),
        )
        if not self.allow_incomplete_fold:
            folds = folds.filter(F.col("test_end") - F.col("test_start") - self.gap >= self.steps)
        every = 1 if self.refit is True else int(self.refit)
        fit = (i % every == 0) if every else ((i == 0) if self.initial_train_size is not None else F.lit(False))
        folds = folds.withColumn("fit_forecaster", fit)
        if isinstance(self.skip_folds, int) and not isinstance(self.skip_folds, bool):
            folds = folds.filter(i % self.skip_folds == 0)
        elif self.skip_folds:
            if 0 in self.skip_folds:
                warnings.warn("the first fold cannot be skipped", stacklevel=2)
            folds = folds.filter(~i.isin([s for s in self.skip_folds if s]))
        return folds.withColumnRenamed("i", "fold").select(*COLUMNS)


@dataclass
class OneStepAheadFold:
    initial_train_size: int

    def split(self, spark: SparkSession, n: int) -> DataFrame:
        if not 0 < self.initial_train_size < n:
            raise ValueError("initial_train_size must lie inside the series")
        return spark.range(1).select(F.lit(0).cast("long").alias("fold"), F.lit(0).cast("long").alias("train_start"), F.lit(self.initial_train_size).cast("long").alias("train_end"), F.lit(self.initial_train_size).cast("long").alias("test_start"), F.lit(n).cast("long").alias("test_end"), F.lit(True).alias("fit_forecaster"))


def rows_of(series: DataFrame, folds: DataFrame, start: str, end: str) -> DataFrame:
    """series (with pos) for each fold, between two of its positions."""
    f = F.broadcast(folds)  # a row for each fold of a backtest
    return series.join(f, (F.col("pos") >= F.col(start)) & (F.col("pos") < F.col(end)))
