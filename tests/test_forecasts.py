import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidewright.operators import features as X
from tidewright.operators.folds import COLUMNS, OneStepAheadFold, TimeSeriesFold
from tidewright.plans import backtest as B
from tidewright.plans import estimators as E
from tidewright.plans.naive import SeasonalNaive, check_interval
from tidewright.plans.recursive import NotFitted, RecursiveForecaster, Trees, predict_multivariate
from tidewright.sources import store


def preds(df, col="pred"):
    return [r[col] for r in df.orderBy("series_id", "step").collect()]


def wave(n, seed=0, shift=0.0):
    t = np.arange(n)
    return list(10 + shift + 3 * np.sin(2 * np.pi * t / 24) + np.random.default_rng(seed).normal(0, 0.3, n))


# ---- seasonal naive


def test_naive_ramp(series):
    s = series(range(20), "D", "2020-01-01")
    assert preds(SeasonalNaive("7 days", rule="D").fit(s).predict(3)) == [13, 14, 15]
    assert preds(SeasonalNaive(7, rule="D").fit(s).predict(3)) == [13, 14, 15]
    assert preds(SeasonalNaive(3, rule="D").fit(s).predict(5)) == [17, 18, 19, 17, 18]
    assert preds(SeasonalNaive(7, n_offsets=2, rule="D").fit(s).predict(2)) == [9.5, 10.5]
    assert preds(SeasonalNaive("7 days", n_offsets=2, agg="max", rule="D").fit(s).predict(9)) == [13, 14, 15, 16, 17, 18, 19, 13, 14]


def test_naive_months_clamp(series):
    s = series(range(91), "D", "2024-01-01")  # to 31 March
    got = SeasonalNaive("1 month", rule="D").fit(s).predict(30).orderBy("step").collect()
    assert got[0].pred == 60  # 1 April takes 1 March
    assert got[29].pred == 89  # 30 April takes 30 March


def test_naive_without_history(series):
    with pytest.raises(Exception, match="history"):
        SeasonalNaive("30 days", rule="D").fit(series(range(5), "D")).predict(1).collect()
    for bad in ({"offset": 0}, {"n_offsets": 0}, {"agg": "mode"}):
        with pytest.raises(ValueError):
            SeasonalNaive(**bad)


def test_naive_intervals(series):
    f = SeasonalNaive(24, n_bins=3).fit(series(wave(240)), store_residuals=True)
    rows = f.predict_interval(24, 0.9).collect()
    wide = {r.step: r.upper_bound - r.lower_bound for r in rows}
    narrow = {r.step: r.upper_bound - r.lower_bound for r in f.predict_interval(24, 0.5).collect()}
    assert all(r.lower_bound <= r.pred <= r.upper_bound for r in rows) and all(wide[k] >= narrow[k] for k in wide)
    pooled = f.predict_interval(4, (5, 95), binned=False).collect()
    assert len({round(r.upper_bound - r.pred, 9) for r in pooled}) == 1
    f.set_out_sample_residuals(series(wave(48), start="2024-02-01").withColumn("pred", F.lit(10.0)))
    assert f.predict_interval(4, 0.9, in_sample=False).count() == 4
    with pytest.raises(ValueError):
        f.predict_interval(4, method="bootstrapping")
    with pytest.raises(ValueError):
        f.set_in_sample_residuals(series(wave(10)))


def test_intervals_are_checked():
    assert check_interval((5, 95)) == 0.9 and check_interval(0.8) == 0.8
    for bad in (1.2, (95, 5), (10, 95)):
        with pytest.raises(ValueError):
            check_interval(bad)


# ---- recursive


def test_matrix(series):
    m = RecursiveForecaster(lags=3).create_train_matrix(series(range(10))).orderBy("ts").collect()
    assert (m[0].lag_1, m[0].lag_2, m[0].lag_3, m[0].y) == (2, 1, 0, 3) and len(m) == 7


def by_hand(y, lags, steps):
    """Least squares and recursion in NumPy."""
    y = np.asarray(y, float)
    reach = max(lags)
    x = np.array([[1, *(y[t - i] for i in lags)] for t in range(reach, len(y))])
    b = np.linalg.lstsq(x, y[reach:], rcond=None)[0]
    state = list(y)
    for _ in range(steps):
        state.append(b[0] + sum(c * state[-i] for c, i in zip(b[1:], lags, strict=True)))
    return state[-steps:]


def test_linear_matches_numpy(series):
    a, b = wave(200), wave(200, 1, 5)
    f = RecursiveForecaster(lags=[1, 2, 24], estimator_params={"ridge": 0.0}).fit(series(a, b=b))
    got = preds(f.predict(10))
    np.testing.assert_allclose(got[:10], by_hand(b, [1, 2, 24], 10), atol=1e-6)
    np.testing.assert_allclose(got[10:], by_hand(a, [1, 2, 24], 10), atol=1e-6)


def test_lanes_agree_with_catalyst(series):
    f = RecursiveForecaster(lags=[1, 24]).fit(series(wave(150), b=wave(150, 2)))
    windows = f._exog_blocks(None, 8, f.windows)
    one = f._in_catalyst(windows, 8).orderBy("series_id", "step").toPandas()
    two = f._in_lanes(windows, 8, None).orderBy("series_id", "step").toPandas()
    np.testing.assert_allclose(one["pred"], two["pred"], atol=1e-9)


def test_predict_matrix(series):
    f = RecursiveForecaster(lags=[1, 3], window_features=X.RollingFeatures(["mean"], 2)).fit(series(wave(60)))
    p = preds(f.predict(4))
    m = f.create_predict_matrix(4).orderBy("step").collect()
    y = wave(60) + p
    for k, r in enumerate(m):
        assert (r.lag_1, r.lag_3, r.roll_mean_2) == pytest.approx((y[59 + k], y[57 + k], (y[59 + k] + y[58 + k]) / 2))
        coef, intercept = f.models["y"]
        assert intercept + coef[0] * r.lag_1 + coef[1] * r.lag_3 + coef[2] * r.roll_mean_2 == pytest.approx(p[k])


def test_ramp_by_differences(series):
    f = RecursiveForecaster(lags=[1], differencing=1).fit(series([2 * t for t in range(30)]))
    assert preds(f.predict(3)) == pytest.approx([60, 62, 64])
    g = RecursiveForecaster(lags=[1], differencing=2).fit(series([t * t for t in range(30)]))
    assert preds(g.predict(3)) == pytest.approx([900, 961, 1024])


def test_scaled(series):
    y = wave(150)
    a = preds(RecursiveForecaster(lags=[1, 24], estimator_params={"ridge": 0.0}).fit(series(y)).predict(5))
    b = preds(RecursiveForecaster(lags=[1, 24], scaled=True, estimator_params={"ridge": 0.0}).fit(series(y)).predict(5))
    assert a == pytest.approx(b, abs=1e-6)


def test_exog(series):
    t = np.arange(120)
    x = np.random.default_rng(4).normal(size=130)
    s = series(list(5 + 2.0 * x[:120] + 0 * t))
    exog = series(list(x)).select("ts", F.col("y").alias("x"))
    f = RecursiveForecaster(lags=[1]).fit(s, exog)
    assert preds(f.predict(5, exog)) == pytest.approx(list(5 + 2 * x[120:125]), abs=1e-4)
    with pytest.raises(ValueError):
        f.predict(5)
    with pytest.raises(ValueError):
        f.predict(5, exog.withColumnRenamed("x", "z"))


def test_sample_weights(series):
    s = series([1.0] * 30 + [9.0] * 30)
    w = s.select("ts", F.when(F.col("y") == 9, 1.0).otherwise(0.0).alias("weight"))
    f = RecursiveForecaster(lags=[1]).fit(s, weights=w)
    assert preds(f.predict(1)) == pytest.approx([9.0], abs=0.3)


@pytest.mark.parametrize("encoding", ["ordinal", "onehot", None])
def test_global_models(series, encoding):
    s = series(wave(120), b=wave(120, 1, 20))
    f = RecursiveForecaster(lags=[1, 24], per_series=False, encoding=encoding).fit(s)
    assert f.predict(5).count() == 10
    assert f.predict(5, levels=["b"]).select("series_id").distinct().collect()[0][0] == "b"
    unknown = s.filter("series_id = 'b'").withColumn("series_id", F.lit("new"))
    assert f.predict(3, last_window=unknown).count() == 3


def test_ragged_series_are_left_out(series):
    s = series(wave(120), b=wave(100))
    f = RecursiveForecaster(lags=[1], per_series=False).fit(s)
    assert {r.series_id for r in f.predict(2).collect()} == {"y"}


@pytest.mark.parametrize("kind", ["gbt", "forest", "tree"])
def test_trees_match_spark(spark, series, kind):
    s = series(wave(150))
    f = RecursiveForecaster(lags=[1, 24], estimator=kind, encoding=None, per_series=False, estimator_params={"maxDepth": 3} | ({"maxIter": 4} if kind == "gbt" else {})).fit(s)
    assert isinstance(f.models[None], Trees) and f.predict(6).count() == 6
    assert f.feature_importances().importance.sum() == pytest.approx(1)
    mae = f.predict_one_step(s).agg(F.avg(F.abs(F.col("y") - F.col("pred")))).first()[0]
    assert mae < 1.0


def test_bootstraps(spark, series, tmp_path):
    s = series(wave(200), b=wave(200, 3))
    f = RecursiveForecaster(lags=[1, 24], window_features=X.RollingFeatures(["mean"], 6)).fit(s, store_residuals=True)
    a = f.predict_bootstrapping(4, n_boot=30).orderBy("series_id", "step", "boot_id").toPandas()
    again = f.predict_bootstrapping(4, n_boot=30).repartition(3).orderBy("series_id", "step", "boot_id").toPandas()
    pd.testing.assert_frame_equal(a, again)
    assert len(a) == 240
    assert not a.equals(f.predict_bootstrapping(4, n_boot=30, seed=1).orderBy("series_id", "step", "boot_id").toPandas())
    q = f.predict_quantiles(4, (0.1, 0.5, 0.9), n_boot=50).collect()
    assert all(r["q_0.1"] <= r["q_0.5"] <= r["q_0.9"] for r in q)
    assert f.predict_dist(2, n_boot=20).filter("scale > 0").count() == 4
    for method in ("conformal", "bootstrapping"):
        rows = f.predict_interval(3, (10, 90), method).collect()
        assert len(rows) == 6 and all(r.lower_bound < r.upper_bound for r in rows)
    f.save(str(tmp_path / "m"))
    g = RecursiveForecaster.load(spark, str(tmp_path / "m"))
    assert preds(f.predict(5)) == pytest.approx(preds(g.predict(5)))
    assert g.predict_quantiles(2, n_boot=10).count() == 4
    loaded, missing = store.load_all(spark, ["m", "other"], str(tmp_path))
    assert list(loaded) == ["m"] and missing == ["other"]


def test_params(series):
    f = RecursiveForecaster(lags=2, forecaster_id="x")
    f.set_params(lags=3, estimator__ridge=0.1)
    assert f.get_params()["estimator__ridge"] == 0.1 and f.window_size == 3
    assert f.set_lags([5]).summary()["lags"] == [5]
    with pytest.raises(ValueError):
        f.set_params(nothing=1)
    with pytest.raises(NotFitted):
        f.predict(1)
    for bad in ({"lags": None}, {"estimator": "oracle"}, {"encoding": "words"}):
        with pytest.raises(ValueError):
            RecursiveForecaster(**bad)
    wide = predict_multivariate({"a": SeasonalNaive(2).fit(series([1, 2])), "b": SeasonalNaive(2).fit(series([3, 4]))}, 2)
    assert [(r.a, r.b) for r in wide.orderBy("ts").collect()] == [(1, 3), (2, 4)]
    assert predict_multivariate({}, 2) is None


# ---- folds and backtests


def fold_rows(cv, spark, n):
    return [tuple(r) for r in cv.split(spark, n).orderBy("fold").collect()]


def test_folds(spark):
    assert fold_rows(TimeSeriesFold(2, 5, window_size=3), spark, 10) == [(0, 0, 5, 2, 5, 5, 7, 5, 7, True), (1, 0, 5, 4, 7, 7, 9, 7, 9, False), (2, 0, 5, 6, 9, 9, 10, 9, 10, False)]
    assert [r[:3] for r in fold_rows(TimeSeriesFold(2, 5, refit=True, fixed_train_size=True), spark, 10)] == [(0, 0, 5), (1, 2, 7), (2, 4, 9)]
    assert [r[:3] for r in fold_rows(TimeSeriesFold(2, 5, refit=True, fixed_train_size=False, allow_incomplete_fold=False), spark, 10)] == [(0, 0, 5), (1, 0, 7)]
    assert [r[-1] for r in fold_rows(TimeSeriesFold(1, 5, refit=2), spark, 10)] == [True, False, True, False, True]
    assert [r[0] for r in fold_rows(TimeSeriesFold(1, 5, skip_folds=2), spark, 10)] == [0, 2, 4]
    assert [r[0] for r in fold_rows(TimeSeriesFold(1, 5, skip_folds=[1, 3]), spark, 10)] == [0, 2, 4]
    gap = fold_rows(TimeSeriesFold(2, 5, gap=1), spark, 9)
    assert gap[0][5:9] == (5, 8, 6, 8)
    for bad in ({"steps": 0, "initial_train_size": 5}, {"steps": 1, "initial_train_size": None, "refit": True}, {"steps": 1, "initial_train_size": 5, "gap": -1}):
        with pytest.raises(ValueError):
            TimeSeriesFold(**bad)
    with pytest.raises(ValueError):
        TimeSeriesFold(1, 10).split(spark, 10)
    with pytest.warns(UserWarning):
        TimeSeriesFold(1, 5).set_params(nonsense=1)
    assert TimeSeriesFold(1, 5).split(spark, 10).columns == COLUMNS


def test_backtests(series):
    s = series(wave(120), b=wave(120, 1))
    for f in (SeasonalNaive(24), RecursiveForecaster(lags=[1, 24])):
        scored, rows = B.backtest(f, s, TimeSeriesFold(12, 72, fold_stride=6), ["mean_absolute_error", "mean_absolute_scaled_error"])
        assert scored.count() == 2 and scored.filter("mean_absolute_error < 1").count() == 2
        assert rows.filter("pred is null").count() == 0
    refit, _ = B.backtest(RecursiveForecaster(lags=[1]), s, TimeSeriesFold(24, 72, refit=True), "mean_squared_error")
    assert refit.count() == 2
    gap = B.backtest(RecursiveForecaster(lags=[1]), s, TimeSeriesFold(10, 72, gap=2))[1]
    assert gap.agg(F.min("pos")).first()[0] == 74
    interval = B.backtest(RecursiveForecaster(lags=[1]), s, TimeSeriesFold(24, 72), interval=0.8)[1]
    assert interval.filter("lower_bound <= upper_bound").count() == interval.count()
    one, rows = B.backtest(RecursiveForecaster(lags=[1]), s, OneStepAheadFold(72))
    assert one.count() == 2 and rows.count() == 96


def test_naive_backtest_by_hand(series):
    y = list(range(20))
    rows = B.backtest(SeasonalNaive(4), series(y), TimeSeriesFold(6, 8))[1].orderBy("pos").collect()
    assert [int(r.pred) for r in rows] == [4, 5, 6, 7, 4, 5, 10, 11, 12, 13, 10, 11]


# ---- a model of each series


@pytest.mark.parametrize("kind", ["gbt", "forest", "tree"])
def test_trees_of_each_series(spark, series, kind, tmp_path):
    """Every series gets trees of its own: another series in the table changes nothing."""
    s = series(wave(150), b=[10 * x for x in wave(150, 2)])
    make = lambda: RecursiveForecaster(lags=[1, 24], estimator=kind, estimator_params={"maxDepth": 3})
    both, alone = make().fit(s, store_residuals=True), make().fit(s.filter("series_id = 'b'"))
    assert set(both.models) == {"y", "b"}
    assert preds(both.predict(5).filter("series_id = 'b'")) == pytest.approx(preds(alone.predict(5)))
    mae = both.predict_one_step(s).groupBy("series_id").agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("e"), F.stddev("y").alias("s"))
    assert mae.filter("e < 0.6 * s").count() == 2
    assert both.feature_importances().groupby("series_id").importance.sum().tolist() == pytest.approx([1, 1])
    assert both.predict_interval(3, 0.8).filter("lower_bound <= pred AND pred <= upper_bound").count() == 6
    both.save(str(tmp_path / "m"))
    assert preds(RecursiveForecaster.load(spark, str(tmp_path / "m")).predict(5)) == pytest.approx(preds(both.predict(5)))


def test_tree_splits_minimise_squares():
    r = np.random.default_rng(2)
    x, y, w = r.normal(size=(60, 2)), r.normal(size=60), r.random(60) + 0.1
    model = E.NamedTrees("tree", maxDepth=1, exact=True).fit(x, y, w)

    def cost(j, cut):
        return sum((w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum() for m in (x[:, j] <= cut, x[:, j] > cut) if m.any())

    best = min(cost(j, c) for j in (0, 1) for c in x[:, j])
    t = model.trees[0]
    assert cost(t["feature"][0], t["cut"][0]) == pytest.approx(best)
    inside = x[:, t["feature"][0]] <= t["cut"][0]
    assert model.predict(x)[inside] == pytest.approx(np.average(y[inside], weights=w[inside]))
    assert E.NamedTrees("gbt", maxIter=0).fit(x, y).predict(x) == pytest.approx(y.mean())
    assert E.NamedTrees("tree").fit(np.zeros((3, 1)), np.array([1.0, 2, 3])).predict(np.zeros((1, 1))) == pytest.approx([2])


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the executors don't know the tests' classes


class Means:
    """An estimator object: the mean of all features, plus a bias it learns."""

    def __init__(self, factor=1.0):
        self.factor = factor

    def fit(self, x, y, sample_weight=None, shift=0.0):
        self.bias = np.average(y - self.factor * x.mean(axis=1), weights=sample_weight) + shift
        self.coef_ = np.full(x.shape[1], self.factor / x.shape[1])
        return self

    def predict(self, x):
        return self.factor * np.asarray(x).mean(axis=1) + self.bias


class Bare:
    def fit(self, x, y):
        return self

    def predict(self, x):
        return np.zeros(len(x))


def test_estimator_objects(series):
    s = series([float(i) for i in range(40)], b=[5.0] * 40)
    f = RecursiveForecaster(lags=2, estimator=Means()).fit(s)
    got = {(r.series_id, r.step): r.pred for r in f.predict(3).collect()}
    assert got["y", 1] == pytest.approx(40) and got["b", 3] == pytest.approx(5)
    assert got["y", 2] == pytest.approx((40 + 39) / 2 + 1.5)
    shifted = RecursiveForecaster(lags=2, estimator=Means(), fit_kwargs={"shift": 1.0}, estimator_params={"factor": 0.5}).fit(s)
    assert shifted.models["b"].factor == 0.5 and shifted.models["b"].bias == pytest.approx(3.5)
    assert f.feature_importances().importance.tolist() == [0.5] * 4
    weights = s.select("ts").distinct().withColumn("weight", F.lit(1.0))
    assert RecursiveForecaster(lags=2, estimator=Means()).fit(s, weights=weights).predict(1).count() == 2
    with pytest.raises(Exception, match="sample_weight"):
        RecursiveForecaster(lags=2, estimator=Bare()).fit(s, weights=weights).predict(1).count()
    for bad in ({"estimator": object()}, {"estimator": Means(), "per_series": False}, {"scaled": "wild"}):
        with pytest.raises(ValueError):
            RecursiveForecaster(lags=1, **bad)
    with pytest.raises(ValueError):
        f.save("/nowhere")
    with pytest.raises(ValueError):
        RecursiveForecaster(lags=2, estimator=Bare()).fit(s).feature_importances()


@pytest.mark.parametrize("how", [True, "standard", "minmax", "maxabs", "robust", X.Affine(F.min, F.stddev_pop)])
def test_scalings_are_undone(series, how):
    """A linear model forecasts the same in every scale; a last window is scaled as the training was."""
    s = series(wave(120), b=[100 + 7 * x for x in wave(120, 1)])
    plain, scaled = (RecursiveForecaster(lags=[1, 2, 24], scaled=x).fit(s) for x in (False, how))
    assert preds(scaled.predict(6)) == pytest.approx(preds(plain.predict(6)), rel=1e-4)
    window = s.filter("ts < '2024-01-04'")
    assert preds(scaled.predict(6, last_window=window)) == pytest.approx(preds(plain.predict(6, last_window=window)), rel=1e-4)
    exog = s.filter("series_id = 'y'").select("ts", (F.hour("ts") * 3.0).alias("x"))
    more = exog.unionByName(exog.select((F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("ts"), "x"))
    a, b = (preds(RecursiveForecaster(lags=[1], scaled_exog=x).fit(s, exog).predict(4, more)) for x in (False, how))
    assert a == pytest.approx(b, rel=1e-4)


def test_codes_of_levels(series):
    """Ordinal codes are those of the names in order; an unknown series has none."""
    s = series(wave(60), b=wave(60, 1), c=wave(60, 2))
    f = RecursiveForecaster(lags=[1], per_series=False).fit(s)
    assert f._coded(s.select("series_id").distinct()).orderBy("series_id").select("_level").toPandas()["_level"].tolist() == [0, 1, 2]
    assert f.levels == ["b", "c", "y"]


def test_distributions(series):
    f = RecursiveForecaster(lags=[1, 24]).fit(series(wave(200)), store_residuals=True)
    paths = f.predict_bootstrapping(2, n_boot=60).toPandas()
    x = paths[paths.step == 1].pred.to_numpy()
    got = {name: f.predict_dist(2, name, n_boot=60).filter("step = 1").first().asDict() for name in ("norm", "laplace", "uniform", "expon", "logistic", "gumbel_r")}
    assert (got["norm"]["loc"], got["norm"]["scale"]) == pytest.approx((x.mean(), x.std()))
    assert (got["laplace"]["loc"], got["laplace"]["scale"]) == pytest.approx((np.median(x), np.abs(x - np.median(x)).mean()))
    assert (got["uniform"]["loc"], got["uniform"]["scale"]) == pytest.approx((x.min(), np.ptp(x)))
    assert (got["expon"]["loc"], got["expon"]["scale"]) == pytest.approx((x.min(), x.mean() - x.min()))
    own = f.predict_dist(2, {"top": F.max}, n_boot=60).filter("step = 1").first()
    assert own.top == pytest.approx(x.max())
    with pytest.raises(ValueError):
        f.predict_dist(2, "cauchy-ish")


# ---- functions as aggregates


def test_naive_with_a_function(series):
    s = series([float(i % 7) for i in range(40)])
    weighted = lambda a: F.aggregate(F.transform(a, lambda x, i: x * F.pow(F.lit(0.5), i)), F.lit(0.0), lambda t, x: t + x)
    steps = preds(SeasonalNaive(7, 2, weighted).fit(s).predict(3))
    assert steps == pytest.approx([1.5 * (40 % 7), 1.5 * (41 % 7), 1.5 * (42 % 7)])
    assert preds(SeasonalNaive("7 hours", 2, weighted).fit(s).predict(3)) == pytest.approx(steps)
    assert SeasonalNaive(7, 2, weighted).fit(s, store_residuals=True).predict_interval(2, 0.8).count() == 2
    month = SeasonalNaive("1 month", 2, lambda a: F.array_max(a), rule="D").fit(series([float(i) for i in range(80)], "D"))
    assert preds(month.predict(1)) == [80 - 31 + 2]  # 20 March looks to 20 February, the 50th day
    rows = B.backtest(SeasonalNaive(7, 2, lambda a: F.array_min(a)), s, TimeSeriesFold(5, 20))[1]
    assert rows.filter("pred <> y").count() == 0
    assert SeasonalNaive(7).tags()["prediction_types"] == ["point", "interval"]
    assert SeasonalNaive(7).fit(s).summary()["n_series"] == 1 and not SeasonalNaive(7).summary()["fitted"]


# ---- folds at once


@pytest.mark.parametrize(("refit", "fixed", "how"), [(True, True, {}), (True, False, {"differencing": 1}), (2, False, {"scaled": True}), (False, True, {"window_features": X.RollingFeatures(["mean"], 5), "scaled": "minmax"}), (2, True, {"estimator": "tree"})])
def test_folds_at_once_are_those_one_by_one(series, refit, fixed, how):
    s = series(wave(90), b=wave(90, 3))
    cv = TimeSeriesFold(8, 50, refit=refit, fixed_train_size=fixed, gap=1, window_size=30)
    f = RecursiveForecaster(lags=[1, 3], **how)
    placed, n = B.placed_on_axis(s)
    cv = cv.set_params(window_size=f.window_size)
    folds = cv.split(s.sparkSession, n)
    a, b = ({(r.series_id, r.fold, r.pos): (r.y, r.pred) for r in g(f, placed, folds, cv, None, None).collect()} for g in (B._recursive, B._recursive_at_once))
    assert a.keys() == b.keys() and len(a) > 50
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-6)


def test_folds_of_ragged_series(series, spark):
    """A shorter series takes part in the folds that it has rows for; the others' forecasts are as without it."""
    s = series(wave(100))
    late = series(wave(40, 2), start="2024-01-03 12:00").withColumn("series_id", F.lit("late"))
    for f in (RecursiveForecaster(lags=[1, 2]), SeasonalNaive(12)):
        alone = {(r.fold, r.pos): r.pred for r in B.backtest(f, s, TimeSeriesFold(10, 40, refit=isinstance(f, RecursiveForecaster)))[1].collect()}
        rows = B.backtest(f, s.unionByName(late), TimeSeriesFold(10, 40, refit=isinstance(f, RecursiveForecaster)))[1].collect()
        both = {(r.fold, r.pos): r.pred for r in rows if r.series_id == "y"}
        assert both == pytest.approx(alone)
        mine = [r for r in rows if r.series_id == "late"]
        assert mine and min(r.pos for r in mine) >= 60
    with pytest.raises(ValueError):
        B.backtest(SeasonalNaive(1), s.filter("false"), TimeSeriesFold(1, 1))


def test_unknown_series_take_pooled_residuals(series):
    """A series that a global model has not seen gets intervals and paths from the residuals of all series."""
    s = series(wave(150), b=wave(150, 3))
    f = RecursiveForecaster(lags=[1, 24], per_series=False, encoding="onehot").fit(s, store_residuals=True)
    new = s.filter("series_id = 'b'").withColumn("series_id", F.lit("new"))
    rows = f.predict_interval(3, 0.8, last_window=s.unionByName(new)).collect()
    assert len(rows) == 9 and all(r.lower_bound < r.pred < r.upper_bound for r in rows)
    known = {(r.series_id, r.step): r.upper_bound - r.lower_bound for r in rows}
    alone = {(r.series_id, r.step): r.upper_bound - r.lower_bound for r in f.predict_interval(3, 0.8).collect()}
    assert all(known[k] == pytest.approx(v) for k, v in alone.items())
    width = np.quantile(np.abs([r.residual for r in f.residuals.collect()]), 0.8)
    assert known["new", 1] == pytest.approx(2 * width, rel=0.02)
    for binned in (True, False):
        assert f.predict_bootstrapping(2, n_boot=5, last_window=s.unionByName(new), binned=binned).filter("pred IS NOT NULL").count() == 30
