import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from tidewright.session import prepare

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield prepare(s)
    s.stop()


@pytest.fixture
def series(spark):
    """Makes (series_id, ts, y) of lists of values, hourly or daily from a date."""

    def make(values, rule="h", start="2024-01-01", **more):
        import pandas as pd

        rows = []
        for name, ys in ({"y": values} | more).items():
            for t, y in zip(pd.date_range(start, periods=len(ys), freq=rule), ys, strict=True):
                rows.append((name, t.to_pydatetime(), None if y is None else float(y)))
        return spark.createDataFrame(rows, "series_id string, ts timestamp, y double")

    return make
