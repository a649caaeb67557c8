import pytest
from pyspark.sql import functions as F

from tidewright.operators import curate, grid
from tidewright.session import clean, from_wide, seconds_of, to_wide


def values(df, *by, col="y"):
    return [r[col] for r in df.orderBy(*(by or ("series_id", "ts"))).collect()]


def test_seconds():
    assert [seconds_of(x) for x in ("h", "3h", "30min", "D", "1 hour", "2 days")] == [3600, 10800, 1800, 86400, 3600, 172800]
    with pytest.raises(ValueError):
        seconds_of("month")


def test_resample_keeps_empty_bins(spark, series):
    s = series([1, 3, None, 5], "20min")
    gap = s.unionByName(series([7], start="2024-01-01 03:00"))
    assert values(grid.resample(gap, "h", by="mean")) == [2.0, 5.0, None, 7.0]
    assert values(grid.resample(gap, "h", by="sum")) == [4.0, 5.0, 0.0, 7.0]
    assert values(grid.resample(gap, "h", by="first")) == [1.0, 5.0, None, 7.0]
    assert values(grid.resample(gap, "h", by="last")) == [3.0, 5.0, None, 7.0]


def test_resample_right_edges(series):
    s = series([1, 2, 3])  # 0:00, 1:00, 2:00
    out = grid.resample(s, "2h", closed="right", label="right", by="sum").orderBy("ts").collect()
    assert [(r.ts.hour, r.y) for r in out] == [(0, 1.0), (2, 5.0)]


def test_resample_checks(series):
    with pytest.raises(ValueError):
        grid.resample(series([1]), by="mode")
    with pytest.raises(ValueError):
        grid.resample(series([1]), closed="both")


def test_fills(series):
    s = series([None, 1, None, None, 4, None])
    assert values(grid.forward_fill(s)) == [None, 1, 1, 1, 4, 4]
    assert values(grid.forward_fill(s, block="hour")) == [None, 1, 1, 1, 4, 4]
    assert values(grid.backward_fill(s)) == [1, 1, 4, 4, 4, None]
    assert values(grid.fill(s)) == [1, 1, 1, 1, 4, 4]
    assert values(grid.interpolate(s)) == [None, 1, 2, 3, 4, 4]


def test_completeness(series):
    s = series([1, 2, 3, 4])
    grid.check_complete(s)
    holed = s.filter(F.col("y") != 2)
    with pytest.raises(ValueError):
        grid.check_complete(holed)
    with pytest.raises(ValueError):
        grid.check_complete(s.unionByName(s))
    with pytest.raises(ValueError):
        grid.check_complete(s.filter("false"))
    assert grid.gaps(holed).count() == 1
    assert values(grid.as_frequency(holed)) == [1, None, 3, 4]


def test_tile_and_future(series):
    out = grid.tile(series([1, 2, 3]), 2, 5)
    assert values(out, "step") == [2, 3, 2, 3, 2]
    assert [r.ts.hour for r in grid.future(series([1, 2]), 2).orderBy("step").collect()] == [2, 3]


def test_steps_until(spark, series):
    s = series([1, 2, 3])
    assert grid.steps_until(s, "2024-01-01 05:00").first().steps == 3
    assert grid.steps_until(s, "2024-01-01 01:00", method="validation").first().steps == 2
    with pytest.raises(Exception, match="not after"):
        grid.steps_until(s, "2023-01-01").collect()


def test_wide_and_long(spark):
    wide = spark.createDataFrame([("2024-01-01", 1.0, float("nan")), ("2024-01-02", 2.0, 3.0)], "d string, a double, b double").selectExpr("cast(d as timestamp) ts", "a", "b")
    long = from_wide(wide, "ts")
    assert long.count() == 4 and long.filter("y is null").count() == 1
    assert to_wide(long, ["a", "b"]).filter("b is null").count() == 1
    assert spark.createDataFrame([(float("nan"),)], "x double").select(clean("x")).first()[0] is None


def test_splits(series):
    s = series(list(range(5)))
    sizes = lambda a, b: [p.count() for p in curate.split_relative(s, a, b)]
    assert sizes(0.5, 0.5) == [2, 2, 1]  # 2.5 rounds to even
    assert sizes(1.0, 0.0) == [5, 0, 0]
    assert sizes(0.0, 0.0) == [0, 0, 5]
    for bad in ((1.1, 0), (0.7, 0.5), (-0.1, 0.5)):
        with pytest.raises(ValueError):
            curate.split_relative(s, *bad)
    with pytest.raises(ValueError):
        curate.split_relative(s.filter("false"), 0.5, 0.5)
    assert [p.count() for p in curate.split_absolute(s, "2024-01-01 01:00", "2024-01-01 03:00")] == [2, 3, 2]


def test_keep_one(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert values(grid.keep_one(df, ["k"], [F.col("o")]), "k", col="v") == ["y", "z"]
    assert values(grid.keep_one(df, ["k"], [F.col("o")], last=False), "k", col="v") == ["x", "z"]
