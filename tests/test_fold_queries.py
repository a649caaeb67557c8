"""Queries of folds and naive backtests on a small table of their own, against their SQL and values known beforehand."""

import datetime as dt

import pytest

from tests.test_catalogue import normal
from tidewright.plans import catalogue

HOURS = 340


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Two types over HOURS hours, with gaps, missing values and NaN; one begins late, one ends early."""
    import pandas as pd

    rows = [(h, "click", None if h % 50 == 7 else h % 24 + 1.0) for h in range(HOURS) if h % 9 != 4]
    rows += [(h, "view", float("nan") if h % 40 == 3 else h * 37 % 101 / 4 + 1) for h in range(12, HOURS - 20)]
    start = dt.datetime(2024, 1, 1, 0, 10)
    pdf = pd.DataFrame([(i, start + dt.timedelta(hours=h), t, y) for i, (h, t, y) in enumerate(rows)], columns=["event_id", "ts", "event_type", "value"])
    home = tmp_path_factory.mktemp("events")
    spark.createDataFrame(pdf, "event_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(f"{home}/events.parquet")
    return str(home)


def matched(spark, home, name):
    """The rows of a query, which are those of its SQL."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{home}/events.parquet/*.parquet'")
    a, b = normal(catalogue.QUERIES[name](spark, home).toPandas()), normal(con.sql(catalogue.ORACLE_SQL[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b) > 0
    for c in a:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c
    return a


def test_folds_expanding(spark, events):
    got = matched(spark, events, "folds_expanding").sort_values("fold")
    assert list(got.train_end) == [300, 324] and set(got.train_start) == {0}
    assert list(got.test_end) == [324, HOURS] and all(got.fit_forecaster)


def test_folds_rolling_gap(spark, events):
    got = matched(spark, events, "folds_rolling_gap")
    assert [tuple(r) for r in got[["fold", "train_start", "train_end", "test_start_with_gap", "test_end"]].itertuples(index=False)] == [(0, 0, 300, 306, 330)]


def test_folds_skipped(spark, events):
    got = matched(spark, events, "folds_skipped")
    assert [tuple(r) for r in got[["fold", "train_end", "test_start", "test_end", "fit_forecaster"]].itertuples(index=False)] == [(0, 300, 300, 324, True)]


def test_backtest_naive(spark, events):
    got = matched(spark, events, "backtest_naive")
    assert len(got) == 2 * (24 + 24 + 16 + 4)  # the last folds are cut at the table's end
    early = got[(got.series_id == "click") & (got.fold == 0) & (got.pos < 304)].sort_values("pos")
    assert list(early.pred) == [h % 24 + 1.0 for h in (276, 277, 278, 279)]


def test_metrics_all(spark, events):
    got = matched(spark, events, "metrics_all")
    rows = normal(catalogue.QUERIES["backtest_naive"](spark, events).toPandas()).sort_values("fold").drop_duplicates(["series_id", "ts"], keep="last")
    error = (rows.y - rows.pred).abs().groupby(rows.series_id).mean()
    assert dict(zip(got.series_id, got.mean_absolute_error, strict=True)) == pytest.approx(dict(error), abs=1e-6)


def test_coverage(spark, events):
    got = matched(spark, events, "coverage")
    rows = normal(catalogue.QUERIES["backtest_naive"](spark, events).toPandas()).sort_values("fold").drop_duplicates(["series_id", "ts"], keep="last")
    inside = ((rows.y - rows.pred).abs() <= 10).groupby(rows.series_id).mean()
    assert dict(zip(got.series_id, got.coverage, strict=True)) == pytest.approx(dict(inside), abs=1e-6)


def test_pinball(spark, events):
    got = matched(spark, events, "pinball")
    rows = normal(catalogue.QUERIES["backtest_naive"](spark, events).toPandas()).sort_values("fold").drop_duplicates(["series_id", "ts"], keep="last")
    error = (rows.y - rows.pred).abs().groupby(rows.series_id).mean()  # the losses of q and 1 - q add up to it
    assert dict(zip(got.series_id, got.pinball_90 + got.pinball_10, strict=True)) == pytest.approx(dict(error), abs=3e-6)


def test_compare_actual_predicted(spark, events):
    got = matched(spark, events, "compare_actual_predicted")
    rows = normal(catalogue.QUERIES["backtest_naive"](spark, events).toPandas()).sort_values("fold").drop_duplicates(["series_id", "ts"], keep="last")
    assert len(got) == 1 and got.MAE[0] == pytest.approx((rows.y - rows.pred).abs().mean(), abs=1e-6)


@pytest.fixture(scope="module")
def odd_events(spark, tmp_path_factory):
    """One type without any value, one with values down to -1, one with values below, over HOURS hours."""
    import pandas as pd

    rows = [(h, "empty", None if h % 2 else float("nan")) for h in range(HOURS)]
    rows += [(h, "edge", h % 5 - 1.0) for h in range(HOURS)] + [(h, "below", h * 37 % 101 / 4 - 10) for h in range(HOURS)]
    start = dt.datetime(2024, 1, 1, 0, 10)
    pdf = pd.DataFrame([(i, start + dt.timedelta(hours=h), t, y) for i, (h, t, y) in enumerate(rows)], columns=["event_id", "ts", "event_type", "value"])
    home = tmp_path_factory.mktemp("odd_events")
    spark.createDataFrame(pdf, "event_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(f"{home}/events.parquet")
    return str(home)


def test_metrics_all_of_missing_and_negative_values(spark, odd_events):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{odd_events}/events.parquet/*.parquet'")
    got = catalogue.QUERIES["metrics_all"](spark, odd_events).toPandas().set_index("series_id").sort_index()
    want = con.sql(catalogue.ORACLE_SQL["metrics_all"]).df().set_index("series_id").sort_index()
    assert list(got.index) == list(want.index) == ["below", "edge", "empty"]
    for c in want:  # percentage errors at 0 are of the size of 1e14; their last digits depend on the order of the sum
        assert list(got[c]) == pytest.approx(list(want[c]), rel=1e-12, abs=1e-9, nan_ok=True), c
    assert got.loc["empty"].isna().all()
    assert got.mean_squared_log_error.isna()["below"]  # no mean of the rows that have a logarithm


def test_coverage_of_missing_values(spark, odd_events):
    got = matched(spark, odd_events, "coverage").set_index("series_id").coverage
    assert sorted(got.index) == ["below", "edge", "empty"] and got["empty"] == 0 and got["edge"] == 1


@pytest.fixture(scope="module")
def short_events(spark, tmp_path_factory):
    """One type over 300 hours, which leave no row to test."""
    import pandas as pd

    start = dt.datetime(2024, 1, 1, 0, 10)
    pdf = pd.DataFrame([(h, start + dt.timedelta(hours=h), "click", h % 24 + 1.0) for h in range(300)], columns=["event_id", "ts", "event_type", "value"])
    home = tmp_path_factory.mktemp("short_events")
    spark.createDataFrame(pdf, "event_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(f"{home}/events.parquet")
    return str(home)


def test_pinball_of_missing_values_and_short_tables(spark, odd_events, short_events):
    import duckdb

    got = matched(spark, odd_events, "pinball").set_index("series_id")
    assert sorted(got.index) == ["below", "edge", "empty"] and got.loc["empty"].isna().all() and got.pinball_90["edge"] > 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{short_events}/events.parquet/*.parquet'")
    assert catalogue.QUERIES["pinball"](spark, short_events).collect() == con.sql(catalogue.ORACLE_SQL["pinball"]).fetchall() == []


def test_compare_actual_predicted_of_missing_values_and_short_tables(spark, odd_events, short_events):
    import duckdb

    assert matched(spark, odd_events, "compare_actual_predicted").MAE[0] > 0  # the type without values doesn't count
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{short_events}/events.parquet/*.parquet'")
    got = [tuple(r) for r in catalogue.QUERIES["compare_actual_predicted"](spark, short_events).collect()]
    assert got == con.sql(catalogue.ORACLE_SQL["compare_actual_predicted"]).fetchall() == [(None, None)]


def test_compare_actual_predicted_of_missing_times_and_empty_tables(spark, tmp_path):
    """Rows without a time are in no hour, whatever their type has beside them; without any row, the means are NULL."""
    import duckdb

    at = lambda h: dt.datetime(2024, 1, 1, 0, 10) + dt.timedelta(hours=h)
    kinds = "event_id long, ts timestamp_ntz, event_type string, value double"
    timeless = [(9001, None, "click", 3.0), (9002, None, "late", 3.0), (9003, None, "never", 4.0)]
    timed = [(h, at(h), "click", h * 37 % 101 / 4 + 1) for h in range(HOURS)] + [(h, at(h), "late", h % 7 + 1.0) for h in range(12, HOURS)]
    for name, rows in {"mixed": timed + timeless, "timeless": timeless, "empty": []}.items():
        home = tmp_path / name
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{home}/events.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{home}/events.parquet/*.parquet'")
        got = [tuple(r) for r in catalogue.QUERIES["compare_actual_predicted"](spark, str(home)).collect()]
        assert got == con.sql(catalogue.ORACLE_SQL["compare_actual_predicted"]).fetchall(), name
        assert (got == [(None, None)]) == (name != "mixed")
        text = lambda rows: sorted(map(str, rows))
        y = catalogue.QUERIES["resample_hourly_mean"](spark, str(home)).selectExpr("series_id", "unix_seconds(ts) AS ts", "y").collect()
        assert text(map(tuple, y)) == text(con.sql(f"SELECT series_id, CAST(epoch(ts) AS BIGINT), y FROM ({catalogue.ORACLE_SQL['resample_hourly_mean']})").fetchall()), name
