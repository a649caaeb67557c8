"""Backtests over time-ordered folds.

A seasonal-naive backtest is one join of positions. In a recursive one with a model of each series, a fold is part of the name of a
series: one grouped fit and one forecast serve all folds, in one plan. Global models are fitted fold by fold. Series may differ in
length: folds lie on the table's time axis, and a series takes part in those that it has rows for.
"""

from __future__ import annotations

import copy
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import metrics as M
from tidewright.operators.folds import OneStepAheadFold, TimeSeriesFold, rows_of
from tidewright.operators.validate import LongTrainingWarning, OneStepAheadWarning
from tidewright.plans.naive import SeasonalNaive, _of_rows
from tidewright.plans.recursive import RecursiveForecaster
from tidewright.session import with_pos

#: Fits beyond which a backtest warns.
MANY_FITS = 50


def placed_on_axis(series: DataFrame) -> tuple[DataFrame, int]:
    """(series with pos, the place of its time among all times of the table, and the number of these)."""
    sizes = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    found = sizes.agg(F.min("n"), F.max("n"), F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
    if found[0] is None:
        raise ValueError("the table is empty")
    if found[0] == found[1] and found[2] == found[3] and found[4] == found[5]:
        return with_pos(series), found[0]
    # a row for each time of the table, however many series there are
    axis = series.select("ts").distinct().withColumn("pos", (F.row_number().over(Window.orderBy("ts")) - 1).cast("long"))
    return series.join(axis, "ts").select("series_id", "ts", "y", "pos"), axis.count()


def naive_rows(series: DataFrame, folds: DataFrame, offset: int, n_offsets: int = 1, agg="mean") -> DataFrame:
    """(series_id, ts, fold, pos, y, pred) of all test rows that have a row an offset before, pred being NULL where its value is missing; series has pos."""
    test = rows_of(series, folds, "test_start_with_gap", "test_end_with_gap")
    src = F.col("test_start") - offset + F.pmod(F.col("pos") - F.col("test_start"), F.lit(offset))
    at = test.select("series_id", "ts", "fold", "pos", "y", F.explode(F.sequence(F.lit(0), F.lit(n_offsets - 1))).alias("k"), src.alias("_src")).withColumn("_src", F.col("_src") - F.col("k") * offset)
    past = series.select("series_id", F.col("pos").alias("_src"), F.col("y").alias("_v"), F.lit(1).alias("_row"))
    joined = at.join(past, ["series_id", "_src"], "left")
    pred = _of_rows(agg, "_v").alias("pred")
    return joined.groupBy("series_id", "ts", "fold", "pos").agg(F.first("y").alias("y"), pred, F.count("_row").alias("_n")).filter("_n > 0").drop("_n")


def keep_last_fold(rows: DataFrame) -> DataFrame:
    """Of times that several folds forecast, the last fold's row."""
    w = Window.partitionBy("series_id", "ts").orderBy(F.col("fold").desc())
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def backtest(forecaster: SeasonalNaive | RecursiveForecaster, series: DataFrame, cv: TimeSeriesFold | OneStepAheadFold, metrics="mean_absolute_error", exog: DataFrame | None = None, by: Sequence[str] = ("series_id",), interval=None) -> tuple[DataFrame, DataFrame]:
    """(metrics, predictions). metrics: a name or function, or several, as in metrics.score(). Overlapping folds count once in metrics, by the last of them; gap rows do not count."""
    metrics = [metrics] if isinstance(metrics, str) or callable(metrics) else list(metrics)
    spark = series.sparkSession
    placed, n = placed_on_axis(series)
    placed = placed.persist()  # read for every fold, and for the metrics' scale
    if isinstance(cv, OneStepAheadFold):
        rows = _one_step(forecaster, placed, cv, exog)
        train = placed.filter(F.col("pos") < cv.initial_train_size)
    else:
        if isinstance(forecaster, RecursiveForecaster):
            cv = copy.copy(cv).set_params(window_size=forecaster.window_size)
        folds = cv.split(spark, n)
        if isinstance(forecaster, SeasonalNaive):
            if not isinstance(forecaster.offset, int):
                raise ValueError("a naive backtest needs an offset in steps")
            rows = naive_rows(placed, folds, forecaster.offset, forecaster.n_offsets, forecaster.agg)
        elif forecaster.per_series and cv.initial_train_size is not None:
            rows = _recursive_at_once(forecaster, placed, folds, cv, exog, interval)
        else:
            rows = _recursive(forecaster, placed, folds, cv, exog, interval)
        last = folds.agg(F.max("train_end")).first()[0]
        train = placed.filter(F.col("pos") < last)
    scored = M.score(keep_last_fold(rows), metrics, by, train)
    return scored, rows


def _recursive_at_once(forecaster, placed, folds, cv, exog, interval) -> DataFrame:
    """All folds in one fit and one forecast: `fold` and series together name a series of their own."""
    name = lambda fold: F.concat_ws("\x1f", F.lpad(F.col(fold).cast("string"), 12, "0"), "series_id")
    fold_rows = folds.orderBy("fold").collect()  # a row for each fold
    fits = sum(f["fit_forecaster"] for f in fold_rows)
    if fits > MANY_FITS:
        warnings.warn(f"the backtest fits {fits} times", LongTrainingWarning, stacklevel=3)
    plan, last = [], None  # each fold, and the fold whose model it uses
    for f in fold_rows:
        last = f["fold"] if f["fit_forecaster"] or last is None else last
        plan.append((f["fold"], last))
    spark = placed.sparkSession
    used = F.broadcast(spark.createDataFrame(plan, "fold long, _fit long"))  # a row for each fold
    train = rows_of(placed, folds.join(F.broadcast(spark.createDataFrame([(m,) for m in sorted({m for _, m in plan})], "fold long")), "fold"), "train_start", "train_end")
    named = lambda rows: rows.select(name("fold").alias("series_id"), "ts", "y")
    exog_of = lambda rows: exog if exog is None or "series_id" not in exog.columns else exog.join(rows.select("series_id", "fold").distinct(), "series_id").withColumn("series_id", name("fold")).drop("fold")
    fitted = copy.copy(forecaster).fit(named(train), exog_of(train), store_residuals=interval is not None)

    parts = F.split("series_id", "\x1f", 2)

    def for_each_fold(table: DataFrame) -> DataFrame:
        """A table of models or scales, named by the fold of the fit, with a row for each fold that uses it."""
        rows = table.withColumn("_fit", parts[0].cast("long")).withColumn("_id", parts[1]).join(used, "_fit")
        return rows.withColumn("series_id", F.concat_ws("\x1f", F.lpad(F.col("fold").cast("string"), 12, "0"), "_id")).drop("_fit", "_id", "fold")

    if len(plan) > fits:
        fitted.model_table = for_each_fold(fitted.model_table)
        if fitted.scaled:
            fitted._scale = for_each_fold(fitted._scale)
        if interval is not None:
            fitted.residuals = for_each_fold(fitted.residuals)
            fitted.binner = copy.copy(fitted.binner)
            fitted.binner.edges = for_each_fold(fitted.binner.edges)
    steps = max(f["test_end"] - f["test_start"] for f in fold_rows)
    window = rows_of(placed, folds.withColumn("_from", F.col("test_start") - fitted.window_size), "_from", "test_start")
    full = window.groupBy("series_id", "fold").agg(F.count(F.lit(1)).alias("_n"), F.max("pos").alias("_p"), F.max("test_start").alias("_s")).filter((F.col("_n") >= fitted.window_size) & (F.col("_p") == F.col("_s") - 1))
    window = window.join(full.select("series_id", "fold"), ["series_id", "fold"])  # a series that starts later, or has ended, has no forecast
    fitted.windows = fitted._last_windows(named(window))
    ahead = exog_of(window)
    if interval is None:
        p = fitted.predict(steps, ahead)
    else:
        p = fitted.predict_interval(steps, interval, exog=ahead)
    p = p.withColumn("fold", parts[0].cast("long")).withColumn("series_id", parts[1])
    bounds = F.broadcast(folds.select("fold", (F.col("test_start_with_gap") - F.col("test_start")).alias("_gap"), (F.col("test_end") - F.col("test_start")).alias("_size")))
    p = p.join(bounds, "fold").filter((F.col("step") > F.col("_gap")) & (F.col("step") <= F.col("_size"))).drop("_gap", "_size")
    return p.join(placed, ["series_id", "ts"])


def _recursive(forecaster, placed, folds, cv, exog, interval) -> DataFrame:
    plans, fitted = [], forecaster
    fold_rows = folds.orderBy("fold").collect()  # a row for each fold
    fits = sum(f["fit_forecaster"] for f in fold_rows)
    if fits > MANY_FITS:
        warnings.warn(f"the backtest fits {fits} times", LongTrainingWarning, stacklevel=3)
    for f in fold_rows:
        if f["fit_forecaster"]:
            fitted = copy.copy(forecaster)
            fitted.fit(placed.filter((F.col("pos") >= f["train_start"]) & (F.col("pos") < f["train_end"])).drop("pos"), exog, store_residuals=interval is not None)
        elif not fitted.is_fitted:
            raise ValueError("the first fold must fit, or the forecaster be fitted")
        steps = f["test_end"] - f["test_start"]
        window = placed.filter((F.col("pos") >= f["test_start"] - fitted.window_size) & (F.col("pos") < f["test_start"])).drop("pos")
        if interval is None:
            p = fitted.predict(steps, exog, last_window=window)
        else:
            moved = copy.copy(fitted)
            moved.windows = fitted._last_windows(window)
            p = moved.predict_interval(steps, interval, exog=exog)
        gap = f["test_start_with_gap"] - f["test_start"]
        plans.append(p.filter(F.col("step") > gap).withColumn("fold", F.lit(f["fold"])))
    out = plans[0]
    for p in plans[1:]:
        out = out.unionByName(p)
    return out.join(placed, ["series_id", "ts"])


def _one_step(forecaster, placed, cv, exog) -> DataFrame:
    """One fit; every test row from true past values."""
    if not isinstance(forecaster, RecursiveForecaster):
        raise ValueError("one-step backtests are for recursive forecasters")
    warnings.warn("one-step forecasts start from true values at every step", OneStepAheadWarning, stacklevel=3)
    fitted = copy.copy(forecaster)
    fitted.fit(placed.filter(F.col("pos") < cv.initial_train_size).drop("pos"), exog)
    rows = fitted.predict_one_step(placed.drop("pos"), exog).select("series_id", "ts", "pred")
    return rows.join(placed.filter(F.col("pos") >= cv.initial_train_size), ["series_id", "ts"]).withColumn("fold", F.lit(0))
