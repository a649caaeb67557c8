import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import curate
from tidewright.operators import features as X


def col(df, name):
    return [r[name] for r in df.orderBy("series_id", "ts").collect()]


def test_lags():
    assert X.normalise_lags(3) == [1, 2, 3]
    assert X.normalise_lags((5, 1)) == [1, 5]
    for bad in (0, -1, [0], True):
        with pytest.raises(ValueError):
            X.normalise_lags(bad)
    with pytest.raises(TypeError):
        X.normalise_lags([1.5])
    assert X.lags_grid([2, [1, 3]]) == {"2": [1, 2], "[1, 3]": [1, 3]}


def test_rolling_matches_pandas(series):
    y = list(np.random.default_rng(0).normal(10, 3, 60).round(3))
    s = series(y)
    stats = ["mean", "std", "std_pop", "min", "max", "sum", "median", "ratio_min_max", "coef_variation"]
    w = X.RollingFeatures(stats, [4, 7], closed="right")
    out = w.transform(s).orderBy("ts").toPandas()
    p = pd.Series(y)
    for n in (4, 7):
        r = p.rolling(n)
        want = {"mean": r.mean(), "std": r.std(), "std_pop": r.std(ddof=0), "min": r.min(), "max": r.max(), "sum": r.sum(), "median": r.median(), "ratio_min_max": r.min() / r.max(), "coef_variation": r.std() / r.mean()}
        for k, v in want.items():
            np.testing.assert_allclose(out[f"roll_{k}_{n}"].astype(float), v, atol=1e-9)
    left = X.RollingFeatures(["mean"], 4).transform(s).orderBy("ts").toPandas()
    np.testing.assert_allclose(left["roll_mean_4"].astype(float), p.rolling(4).mean().shift(1), atol=1e-9)
    blocks = X.RollingFeatures(["mean", "max"], 4).transform(s, halo="day").orderBy("ts").toPandas()
    np.testing.assert_allclose(blocks["roll_mean_4"].astype(float), p.rolling(4).mean().shift(1), atol=1e-9)


def test_rolling_kernel_agrees_with_windows(series):
    y = list(np.random.default_rng(1).normal(10, 3, 20))
    w = X.RollingFeatures(["mean", "std", "median", "ewm", "coef_variation"], 6)
    row = w.transform(series([*y, 0.0])).orderBy(F.col("ts").desc()).first()
    np.testing.assert_allclose([row[n] for n in w.names], np.ravel(w.kernel(np.array(y)[:, None])), atol=1e-9)


def test_custom_statistic(series):
    w = X.RollingFeatures(["range"], 3, closed="right", custom={"range": lambda v: v.max() - v.min()})
    got = col(w.transform(series([1, 5, 2, 9])), "roll_range_3")
    assert [x for x in got if x is not None and x == x] == [4.0, 7.0]


def test_rolling_checks():
    for bad in ({"stats": ["mode"], "window_sizes": 3}, {"stats": ["mean"], "window_sizes": 0}, {"stats": ["mean", "mean"], "window_sizes": 3}):
        with pytest.raises(ValueError):
            X.RollingFeatures(**bad)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_difference_and_back(series, order):
    y = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3]
    s = series(y)
    d = X.difference(s, order)
    assert col(d, "d")[: order] == [None] * order
    cut = F.col("ts") >= F.lit("2024-01-01 06:00").cast("timestamp")
    back = X.undifference(d.filter(cut).drop("y"), X.difference_tails(s.filter(~cut), order), order)
    assert col(back, "y") == pytest.approx(y[6:])


def test_asof(spark, series):
    right = spark.createDataFrame([("2024-01-01 00:30", 1.0), ("2024-01-01 02:00", 2.0)], "t string, v double").select(F.to_timestamp("t").alias("ts"), "v")
    left = series([0, 0, 0, 0])
    assert col(X.asof(left, right, ["v"]), "v") == [None, 1.0, 2.0, 2.0]
    assert col(X.asof(left, right, ["v"], backfill=True), "v") == [1.0, 1.0, 2.0, 2.0]
    for unit in ("hour", "day", "month"):
        assert col(X.asof(left, right, ["v"], block=unit), "v") == [None, 1.0, 2.0, 2.0]
        assert col(X.asof(left, right, ["v"], backfill=True, block=unit), "v") == [1.0, 1.0, 2.0, 2.0]
    keyed = right.withColumn("series_id", F.lit("y")).unionByName(right.withColumn("series_id", F.lit("b")).withColumn("v", F.col("v") * 10))
    both = series([0, 0, 0], b=[0, 0, 0])
    for unit in (None, "hour"):
        assert col(X.asof(both, keyed, ["v"], by=["series_id"], block=unit), "v") == [None, 10.0, 20.0, None, 1.0, 2.0]


def test_joins(spark, series):
    a, b = series([1, 2, 3]).select("ts", F.col("y").alias("a")), series([5, 6]).select("ts", F.col("y").alias("b"))
    assert [r.b for r in X.left_default(a, b, default=0.0).orderBy("ts").collect()] == [5, 6, 0]
    with pytest.raises(Exception, match="missing values"):
        X.outer_concat([a, b]).collect()
    with pytest.raises(ValueError):
        X.same_index(a, b)
    X.same_index(a, a)
    assert X.exog_direct(series([1, 2, 3]), ["y"], 2).count() == 2
    assert X.exog_future(a, "2024-01-01 00:00", "2024-01-01 01:00").count() == 1


def test_weights_lookup(spark, series):
    s = series([1, 2])
    w = s.select("ts", F.lit(1.0).alias("weight"))
    assert X.difference(s).count() == curate.look_up_weights(s, w).count()
    with pytest.raises(Exception, match="no weight"):
        curate.look_up_weights(s, w.limit(1)).collect()
    for bad in (-1.0, 0.0, float("nan")):
        with pytest.raises(ValueError):
            curate.check_weights(w.withColumn("weight", F.lit(bad)))


def test_encoding(spark, series):
    s = series([1], b=[2])
    assert col(X.ordinal_encode(s), "code") == [0, 1]
    assert col(X.ordinal_encode(s, known=s.filter("series_id = 'y'")), "code") == [None, 0]
    hot = X.onehot_encode(s, ["y"])
    assert col(hot, "series_id_y") == [0.0, 1.0]
    z, p = X.scale(series([1, 2, 3]))
    assert col(X.unscale(z.drop("y"), p), "y") == pytest.approx([1, 2, 3])


def test_select_features():
    cols = ["hour_sin", "hour_cos", "temp", "temp_window_1D_mean", "is_holiday", "poly_a__b", "hour"]
    assert X.select_features(cols, ["temp"]) == ["hour_sin", "hour_cos", "temp"]
    assert X.select_features(cols, ["temp"], True, True, True) == ["hour_sin", "hour_cos", "temp_window_1D_mean", "temp", "is_holiday", "poly_a__b"]


def test_trim(series):
    assert col(X.trim(series([None, 1, None, 2, None])), "y") == [1, None, 2]
