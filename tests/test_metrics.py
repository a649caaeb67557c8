import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import metrics as M


def rows(spark, y, p):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p, strict=True)], "y double, pred double")


def test_against_numpy(spark):
    r = np.random.default_rng(0)
    y, p = r.uniform(1, 9, 50), r.uniform(1, 9, 50)
    got = rows(spark, y, p).agg(M.mse().alias("mse"), M.mae().alias("mae"), M.mape().alias("mape"), M.msle().alias("msle"), M.medae().alias("med"), M.smape().alias("smape"), M.pinball(0.8).alias("pin")).first()
    e = y - p
    assert got.mse == pytest.approx((e**2).mean()) and got.mae == pytest.approx(abs(e).mean())
    assert got.mape == pytest.approx((abs(e) / y).mean()) and got.msle == pytest.approx(((np.log1p(y) - np.log1p(p)) ** 2).mean())
    assert got.med == pytest.approx(np.median(abs(e))) and got.smape == pytest.approx(100 * (abs(e) / ((y + p) / 2)).mean())
    assert got.pin == pytest.approx(np.maximum(0.8 * e, -0.2 * e).mean())


def test_edges(spark):
    assert rows(spark, [0, 2], [0, 2]).agg(M.smape()).first()[0] == 0
    with pytest.raises(ValueError):
        M.pinball(1.5)
    with pytest.raises(ValueError):
        M.metric("nothing")
    with pytest.raises(ValueError):
        M.score(rows(spark, [1], [1]), ["mean_absolute_scaled_error"])
    got = rows(spark, [0, 0], [0, 1]).agg(M.precision(), M.recall(), M.f1(), M.accuracy(), M.balanced_accuracy()).first()
    assert tuple(got) == (0, 0, 0, 0.5, 0.25)


def test_coverage(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (3.0, 1.0, 2.0)], "y double, lower_bound double, upper_bound double")
    assert df.agg(M.coverage()).first()[0] == 0.5


def test_crps_ensemble(spark):
    r = np.random.default_rng(1)
    data, want = [], {}
    for k in range(5):
        x, y = r.normal(size=7), r.normal()
        want[k] = np.abs(x - y).mean() - np.abs(x[:, None] - x).mean() / 2
        data += [(k, float(y), float(v)) for v in x]
    got = M.crps_ensemble(spark.createDataFrame(data, "k int, y double, pred double"), ["k"]).collect()
    assert {r.k: pytest.approx(r.crps) for r in got} == want


def test_crps_quantiles(spark):
    levels = [0.0, 0.25, 0.5, 0.75, 1.0]
    df = spark.createDataFrame([(0.3, -1.0, -0.5, 0.0, 0.5, 1.0)], "y double, a double, b double, c double, d double, e double")
    got = M.crps_quantiles(df, ["a", "b", "c", "d", "e"], levels).first().crps
    x = np.linspace(-3, 3, 200001)
    cdf = np.clip((x + 1) / 2, 0, 1)
    assert got == pytest.approx(np.trapezoid((cdf - (x >= 0.3)) ** 2, x), abs=2e-3)


def test_scaled(spark, series):
    train = series([1, 3, 2, 4])
    pred = series([5, 6], start="2024-01-02").withColumn("pred", F.lit(5.0))
    got = M.score(pred, list(M.SCALED), ["series_id"], train).first()
    assert got.mean_absolute_scaled_error == pytest.approx(0.5 / (5 / 3))
    assert got.root_mean_squared_scaled_error == pytest.approx(np.sqrt(0.5) / np.sqrt(3))
    assert M.compare(pred.drop("pred"), pred.drop("y")).first().MAE == 0.5


def test_own_metric(spark, series):
    def worst(y="y", p="pred"):
        return F.max(F.abs(F.col(y) - F.col(p)))

    df = series([1, 5]).withColumn("pred", F.lit(2.0))
    assert M.score(df, [worst, "mean_absolute_error"], ["series_id"]).first().asDict() == {"series_id": "y", "worst": 3.0, "mean_absolute_error": 2.0}


def test_protocols():
    from tidewright.operators.features import RollingFeatures
    from tidewright.plans.base import Forecaster, WindowFeatures
    from tidewright.plans.naive import SeasonalNaive
    from tidewright.plans.recursive import RecursiveForecaster

    assert isinstance(SeasonalNaive(), Forecaster) and isinstance(RecursiveForecaster(), Forecaster) and isinstance(RollingFeatures(["mean"], 3), WindowFeatures)
