import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import curate
from tidewright.operators.curate import QuantileBinner


def test_manual_limits_are_strict(series):
    masked, n = curate.mask_outside(series([1, 2, 3, None]), 1, 2)
    assert [r.y for r in masked.orderBy("ts").collect()] == [1, 2, None, None]
    assert n.first().n_outliers == 1
    assert curate.mask_outside(series([1, 2]))[1].first().n_outliers == 0


def test_isolation_forest_finds_spikes(series):
    r = np.random.default_rng(3)
    y = r.normal(0, 1, 500)
    y[[50, 200, 400]] = [30, -40, 25]
    s = series(list(y))
    found = curate.get_outliers(s, 0.01)
    assert {50, 200, 400} <= {int((t.ts - s.agg(F.min("ts")).first()[0]).total_seconds() // 3600) for t in found.collect()}
    assert found.count() <= 10
    marked = curate.mark_outliers(s, 0.01)
    assert marked.filter("y is null").count() == found.count()
    with pytest.raises(ValueError):
        curate.get_outliers(s.filter("false"))
    with pytest.raises(ValueError):
        curate.flag_outliers(s, 0.9)


def test_missing_weights(series):
    s = series([1, None, 3, 4, 5])
    got = curate.missing_weights(s, 2).orderBy("ts").collect()
    assert [r.weight for r in got] == [1, 0, 0, 0, 1] and [r.y for r in got] == [1, 1, 3, 4, 5]
    assert {r.weight for r in curate.missing_weights(s, 2, "flags_off").collect()} == {1.0}
    with pytest.raises(ValueError):
        curate.missing_weights(s, 0)
    with pytest.raises(ValueError):
        curate.check_window(s, 5)
    with pytest.raises(ValueError):
        curate.check_window(s.filter("false"), 1)


def test_combine(spark, series):
    wide = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0)], "ts int, a double, b double")
    got = lambda w: [r.combined for r in curate.combine(wide, w).orderBy("ts").collect()]
    assert got(None) == [3.0, None] and got([1, -1]) == [-1.0, None] and got({"b": 2}) == [4.0, 2.0]
    with pytest.raises(ValueError):
        curate.combine(wide, [1])
    with pytest.raises(ValueError):
        curate.combine(wide, {"c": 1})
    long = series([1, None], b=[2, 3]).withColumnRenamed("y", "pred")
    w = spark.createDataFrame([("y", 1.0), ("b", -1.0)], "series_id string, w double")
    assert [r.combined for r in curate.weighted_sum(long, w).orderBy("ts").collect()] == [-1.0, None]


def test_binner_matches_numpy(spark, series):
    y = np.random.default_rng(5).gamma(2, 3, 400)
    s = series(list(y))
    b = QuantileBinner(5).fit(s, "y")
    edges = np.quantile(y, np.linspace(0, 1, 6))
    np.testing.assert_allclose(b.edges.first().edges, edges)
    out = b.transform(s.unionByName(series([-99, 999], start="2030-01-01")), "y").orderBy("ts").toPandas()
    np.testing.assert_array_equal(out["bin"], np.clip(np.searchsorted(edges[1:-1], out["y"], "right"), 0, 4))
    assert b.intervals().count() == 5


def test_binner_merges_equal_edges(series):
    b = QuantileBinner(4).fit(series([1, 1, 1, 1, 1, 2]), "y")
    with pytest.warns(UserWarning):
        b.check()
    one = QuantileBinner(4).fit(series([3, 3, 3]), "y")
    assert {r.bin for r in one.transform(series([1, 3, 9]), "y").collect()} == {0}
    with pytest.raises(ValueError):
        QuantileBinner(1)


@pytest.mark.parametrize("method", curate.METHODS)
def test_quantile_methods(spark, method):
    r = np.random.default_rng(3)
    groups = {f"g{n}": r.normal(size=n).round(1) for n in (1, 2, 3, 7, 40, 41)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "series_id string, v double")
    marks = [i / 8 for i in range(9)]
    got = {r["series_id"]: r["edges"] for r in curate.quantile_edges(df, "v", marks, ["series_id"], method).collect()}
    for g, vs in groups.items():
        assert got[g] == pytest.approx(np.quantile(vs, marks, method=method)), g
    pooled = curate.quantile_edges(df, "v", marks, [], method).first()["edges"]
    assert pooled == pytest.approx(np.quantile(np.concatenate(list(groups.values())), marks, method=method))


def test_binner_options(spark, series):
    s = series([float(i) for i in range(100)])
    small = curate.QuantileBinner(4, subsample=20).fit(s, "y")
    assert 0 <= min(small.edges.first()["edges"]) and small.transform(s, "y").count() == 100
    for bad in ({"n_bins": 1}, {"method": "mode"}, {"subsample": 0}):
        with pytest.raises(ValueError):
            curate.QuantileBinner(**bad)


def test_outliers_with_their_original_values(series):
    s = series([1.0, 1.1, 0.9, 1.0, 50.0] * 4)
    found = curate.get_outliers(s, 0.2, original=s.withColumn("y", F.col("y") * 2)).select("y").distinct().collect()
    assert [r.y for r in found] == [100.0]


def test_thresholds_come_from_all_values(series, monkeypatch):
    """The flagged values are those whose scores pass the quantile of all scores, however few the trees have seen, in any number of parts."""
    r = np.random.default_rng(5)
    y = np.concatenate([r.normal(size=3000), r.normal(size=30) * 30]).round(3)
    s = series(y.tolist())
    monkeypatch.setattr(curate, "PART_ROWS", 500)
    got = curate.flag_outliers(s, 0.02, sample=400).toPandas()
    assert got.is_outlier.mean() == pytest.approx(0.02, abs=0.004)
    assert got[np.abs(got.y) > 20].is_outlier.mean() > 0.9
    whole = curate.flag_outliers(s, 0.02).toPandas()
    x = np.sort(y)
    f = curate.IsolationForest().fit(x)
    want = f.score(y) > np.quantile(f.score(y), 0.98)
    by_time = whole.sort_values("ts").is_outlier.to_numpy()
    assert (by_time == want).all()
    values, counts = r.random(50), r.integers(0, 5, 50)
    for q in (0, 0.3, 0.77, 1):
        assert curate.weighted_quantile(values, counts, q) == pytest.approx(np.quantile(np.repeat(values, counts), q))
