import json
import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright import tasks
from tidewright.functions import misc
from tidewright.operators import validate as V
from tidewright.plans.config import CombinedConfig, WorkflowConfig
from tidewright.plans.recursive import NotFitted, RecursiveForecaster


def test_series_checks(spark, series):
    V.check_y(series([1, 2]))
    with pytest.raises(ValueError):
        V.check_y(series([1, None]))
    with pytest.raises(TypeError):
        V.check_y(series([1]).drop("ts"))
    with pytest.raises(TypeError):
        V.check_y(series([1]).withColumn("y", F.lit("x")))
    exog = series([1, None]).select("ts", F.col("y").alias("x"), F.lit("s").alias("s"))
    with pytest.warns(V.MissingValuesWarning):
        V.check_exog(exog)
    with pytest.raises(ValueError):
        V.check_exog(exog, allow_missing=False)
    with pytest.warns(V.DataTypeWarning):
        assert V.check_exog_types(exog) == {"x": "double", "s": "string"}
    for bad in ((5,), (95, 5), (-1, 50)):
        with pytest.raises(ValueError):
            V.check_interval(bad)
    with pytest.raises(ValueError):
        V.check_quantile([0.5, 1.5])


def test_collections(spark, series):
    a, b = series([1, 2, 3]).select("ts", "y"), series([4, 5, 6], start="2024-02-01").select("ts", F.col("y").alias("v"))
    assert V.collect_series({"a": a, "b": b}).count() == 6
    assert V.collect_series(series([1, 2], b=[3, 4])).count() == 4
    assert V.collect_series(a.withColumn("z", F.lit(1.0))).count() == 6
    for bad in ({}, {"a": a.withColumn("z", F.lit(1.0))}, {"a": a, "b": series([1, 2, 3], "D").select("ts", "y")}, {"a": series([None, None]).select("ts", "y")}):
        with pytest.raises(ValueError):
            V.collect_series(bad)


def test_predict_checks(series):
    f = RecursiveForecaster(lags=2)
    with pytest.raises(NotFitted):
        V.check_predict_input(f, 1)
    f.fit(series(range(20)))
    V.check_predict_input(f, 1)
    with pytest.raises(ValueError):
        V.check_predict_input(f, 0)
    with pytest.raises(ValueError):
        V.check_predict_input(f, 1, last_window=series([1]))
    with pytest.warns(V.UnknownLevelWarning):
        V.check_predict_input(f, 1, last_window=series([1, 2]).withColumn("series_id", F.lit("new")))
    with pytest.raises(ValueError):
        V.check_residuals(f)


def test_misc(tmp_path):
    assert [misc.parse_bool(x) for x in ("yes", "OFF", True)] == [True, False, True]
    with pytest.raises(ValueError):
        misc.parse_bool("maybe")
    assert misc.mask_coordinates(51.4567, 7.4999) == (51.5, 7.5)
    assert misc.mask_secrets("api_key=abc token: x1") == "api_key=*** token: ***"
    assert misc.cpe().startswith("cpe:2.3:a:") and "tidewright" in misc.greeting()
    a = misc.logger("t", file=str(tmp_path / "l/x.log"))
    assert misc.logger("t", file=str(tmp_path / "l/x.log")) is a and len(a.handlers) == 2
    logging.getLogger("t").info("hello")
    assert "hello" in (tmp_path / "l/x.log").read_text()


def test_configs():
    c = WorkflowConfig()
    assert c.get_params()["periods__daily__n_periods"] == 12
    d = c.set_params(predict_size=48, periods__daily__n_periods=6)
    assert d.predict_size == 48 and d.get_params()["periods__daily__n_periods"] == 6 and c.predict_size == 24
    for bad in ({"nope": 1}, {"periods__nope__n_periods": 2}):
        with pytest.raises(ValueError):
            c.set_params(**bad)
    assert len(CombinedConfig().weights) == 11


def test_command_line(spark, tmp_path, capsys):
    t = np.arange(24 * 15)
    lines = [f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00,{10 + np.sin(i / 24 * 6.283):.4f},{5 + np.cos(i / 24 * 6.283):.4f}" for i in t]
    (tmp_path / "d.csv").write_text("time,a,b\n" + "\n".join(lines[: 24 * 14]))
    (tmp_path / "t.csv").write_text("time,a,b\n" + "\n".join(lines[24 * 14 :]))
    assert tasks.main(["compare", "--data", str(tmp_path / "d.csv"), "--truth", str(tmp_path / "t.csv"), "--weights", "1,-1", "--lags", "24", "--contamination", "0", "--out", str(tmp_path / "out")]) == 0
    got = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert got["naive"]["MAE"] < 0.01 and got["linear"]["MAE"] < 0.2 and got["trees"]["MAE"] < 1
    assert tasks.main(["combine", "--data", str(tmp_path / "none.csv")]) == 1


def test_warnings(spark, series):
    s = series([float(i) for i in range(40)])
    exog = s.select("ts", (F.col("y") % 3).alias("x"))
    ranges = V.exog_ranges(exog)
    assert ranges == {"x": (0.0, 2.0)} and V.check_exog_range(exog, ranges) == [] and V.check_exog_range(exog, {}) == []
    with pytest.warns(V.FeatureOutOfRangeWarning):
        assert V.check_exog_range(exog.withColumn("x", F.col("x") + 1), ranges) == ["x"]
    with pytest.warns(V.ExogInterpretationWarning):
        f = RecursiveForecaster(lags=2, differencing=1).fit(s, exog)
    with pytest.warns(V.TransformedSpaceWarning):
        f.create_predict_matrix(1, exog.select((F.col("ts") + F.expr("INTERVAL 40 HOURS")).alias("ts"), "x"))
    with pytest.warns(V.InputTypeWarning):
        V.collect_series({f"s{i}": s.select("ts", "y") for i in range(V.MANY_FRAMES + 1)})
    assert issubclass(V.MissingExogWarning, V.MissingValuesWarning) and issubclass(NotFitted, ValueError)

    @V.deprecated("new", "9")
    def old(x):
        return x + 1

    with pytest.warns(DeprecationWarning, match="use new"):
        assert old(1) == 2 and old.__name__ == "old"


def test_saved_versions(spark, series, tmp_path, monkeypatch):
    import tidewright

    f = RecursiveForecaster(lags=1).fit(series([1.0, 2.0, 4.0, 7.0, 3.0, 5.0]), store_residuals=True)
    f.save(str(tmp_path / "m"))
    monkeypatch.setattr(tidewright, "__version__", "0.0.0")
    with pytest.warns(V.VersionWarning):
        RecursiveForecaster.load(spark, str(tmp_path / "m"))
    f.out_residuals = f.residuals
    with pytest.warns(V.SavedModelWarning):
        f.save(str(tmp_path / "n"))
