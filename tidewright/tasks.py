"""Command lines: `python -m tidewright.tasks combine ...` and `python -m tidewright.tasks compare ...`.

combine: forecasts of all columns of a CSV file with covariates, and their signed sum. compare: the errors of the
seasonal-naive, the linear and a tree model against a file of true values. The exit code is 0 if all went well, else 1.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewright.functions import metrics as M
from tidewright.functions.misc import logger, mask_coordinates, parse_bool
from tidewright.operators import curate
from tidewright.plans import pipelines
from tidewright.plans.config import CombinedConfig
from tidewright.plans.recursive import RecursiveForecaster
from tidewright.sources import series as S

log = logger()


def parser() -> argparse.ArgumentParser:
    d = CombinedConfig()
    p = argparse.ArgumentParser(prog="tidewright", description=__doc__)
    p.add_argument("task", choices=["combine", "compare"])
    p.add_argument("--data", required=True, help="a CSV file with a time column and a column for each series")
    p.add_argument("--truth", help="the same columns for the time after the data (compare)")
    p.add_argument("--columns", help="comma-separated; all by default")
    p.add_argument("--weights", help="comma-separated, one for each column")
    p.add_argument("--horizon", type=int, default=d.horizon)
    p.add_argument("--window-size", type=int, default=d.window_size)
    p.add_argument("--lags", type=int, default=d.lags)
    p.add_argument("--contamination", type=float, default=d.contamination)
    p.add_argument("--country", default=d.country)
    p.add_argument("--state", default=d.state)
    p.add_argument("--zone", default=d.zone)
    p.add_argument("--latitude", type=float, default=d.latitude)
    p.add_argument("--longitude", type=float, default=d.longitude)
    for flag in ("include-windows", "include-holidays", "include-poly", "force-train"):
        p.add_argument(f"--{flag}", type=parse_bool, default=flag == "force-train")
    p.add_argument("--model-dir")
    p.add_argument("--out", help="a folder for the combined forecast as CSV")
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    wide = S.fetch(spark, a.data, zone=a.zone, columns=a.columns.split(",") if a.columns else None)
    series = wide.long()
    log.info("forecast for %s", mask_coordinates(a.latitude, a.longitude))
    weights = dict(zip(wide.columns, map(float, a.weights.split(",")), strict=True)) if a.weights else dict(zip(wide.columns, pipelines.DEFAULT_WEIGHTS, strict=False))
    cov = pipelines.Covariates(a.country or None, a.state, a.zone, a.latitude, a.longitude, include_windows=a.include_windows, include_holidays=a.include_holidays, include_poly=a.include_poly)
    how = {"horizon": a.horizon, "covariates": cov, "window_size": a.window_size, "contamination": a.contamination or None}
    combined, _, meta = pipelines.forecast_n_to_1(series, weights, forecaster=RecursiveForecaster(lags=a.lags), model_dir=a.model_dir, force_train=a.force_train, **how)
    if a.out:
        combined.orderBy("ts").coalesce(1).write.mode("overwrite").option("header", True).csv(a.out)
    if a.task == "combine":
        return {"rows": combined.count(), **{k: meta[k] for k in ("targets", "n_outliers", "horizon")}}
    truth = S.load_actual_combined(spark, a.truth, wide.columns, a.horizon, weights).withColumnRenamed("combined", "y")
    table = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "series_id string, w double")
    models = {
        "naive": curate.weighted_sum(pipelines.forecast_many(series, a.horizon, contamination=how["contamination"]), table),
        "linear": combined,
        "trees": pipelines.forecast_n_to_1(series, weights, forecaster=RecursiveForecaster(lags=a.lags, estimator="gbt"), **how)[0],
    }
    return {name: M.compare(truth, p.select("ts", F.col("combined").alias("pred"))).first().asDict() for name, p in models.items()}


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.task == "compare" and not a.truth:
        parser().error("compare needs --truth")
    spark = SparkSession.builder.appName("tidewright").getOrCreate()
    try:
        print(json.dumps(run(spark, a)))
        return 0
    except Exception:
        log.exception("the task failed")
        return 1


if __name__ == "__main__":
    sys.exit(main())
