"""Where models are kept: a folder for each model, and one for each iteration, on any file system that Spark reaches."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, f"{path}/meta")
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def iteration_path(home: str, name: str, iteration: int) -> str:
    return f"{home.rstrip('/')}/{name}_forecaster_{iteration}"


def last_iteration(spark: SparkSession, home: str, name: str) -> int:
    """The highest number of a saved iteration; -1 if there is none."""
    found = [int(m[1]) for n in names(spark, home) if (m := re.fullmatch(rf"{re.escape(name)}_forecaster_(\d+)", n))]
    return max(found, default=-1)


def save_all(forecasters: dict, home: str) -> dict[str, str]:
    paths = {}
    for name, f in forecasters.items():
        paths[name] = f"{home.rstrip('/')}/{name}"
        f.save(paths[name])
    return paths


def load_all(spark: SparkSession, wanted: list[str], home: str) -> tuple[dict, list[str]]:
    """(loaded, missing)."""
    from tidewright.plans.recursive import RecursiveForecaster

    loaded, missing = {}, []
    for name in wanted:
        path = f"{home.rstrip('/')}/{name}"
        if exists(spark, path):
            loaded[name] = RecursiveForecaster.load(spark, path)
        else:
            missing.append(name)
    return loaded, missing
