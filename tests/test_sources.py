import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from tidewright.plans import pipelines
from tidewright.plans.recursive import RecursiveForecaster
from tidewright.sources import series as S
from tidewright.sources import store
from tidewright.sources.weather import WeatherService


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("t,a,b\n2024-01-01 00:00:00,1,x\n2024-01-01 01:00:00,,y\n")
    wide = S.from_csv(spark, str(p), columns=["a"])
    assert wide.df.columns == ["ts", "a"] and [r.a for r in wide.df.orderBy("ts").collect()] == [1.0, None]
    berlin = S.from_csv(spark, str(p), "Europe/Berlin", ["a"]).df.agg(F.min("ts")).first()[0]
    assert berlin == dt.datetime(2023, 12, 31, 23)
    assert "b" not in wide.df._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    for bad in ({"columns": []}, {"columns": ["zzz"]}):
        with pytest.raises(ValueError):
            S.from_csv(spark, str(p), **bad)
    with pytest.raises(ValueError):
        S.fetch(spark)
    with pytest.raises(ValueError):
        S.fetch(spark, str(p), wide.df)
    with pytest.raises(ValueError):
        S.to_utc("ts", None)
    assert S.fetch(spark, frame=wide.df).long().count() == 2
    with pytest.raises(Exception, match="(?i)path"):
        S.from_csv(spark, str(tmp_path / "none.csv"))


def test_load_series(spark, tmp_path):
    (tmp_path / "interim").mkdir()
    (tmp_path / "interim/energy_load.csv").write_text("Time (UTC),Actual Load,Forecasted Load\n2022-01-01 00:00:00,1,5\n2022-01-01 02:00:00,3,6\n")
    got = S.load_load(spark, str(tmp_path)).orderBy("ts").collect()
    assert [r.y for r in got] == [1, 1, 3]
    assert [r.y for r in S.load_load_forecast(spark, str(tmp_path)).orderBy("ts").collect()] == [5, 5, 6]


def test_merge_raw(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time (UTC),load\n2022-01-01 00:00:00,1\n2022-01-01 01:00:00,-\n")
    (tmp_path / "b.csv").write_text("Time (UTC),load\n2022-01-01 00:00:00,9\n2099-01-01 00:00:00,1\n")
    got = S.merge_raw(spark, str(tmp_path / "*.csv"), ["load"]).collect()
    assert [r.load for r in got] == [9.0, None]


def test_download(tmp_path):
    asked = []

    def query(a, b):
        asked.append((a, b))
        if len(asked) == 1:
            raise OSError("down")
        return "Time (UTC),load\n"

    out = S.download(query, tmp_path / "raw", "2024-01-01T00:00:00", wait_s=0)
    assert out.exists() and asked[0][0] == "2024-01-01T01:00:00" and len(asked) == 2
    assert S.download(query, tmp_path / "raw", None) is None  # too soon
    assert S.download(query, tmp_path / "raw", None, force=True, now=time.time() + 1)
    with pytest.raises(OSError):
        S.download(lambda a, b: (_ for _ in ()).throw(OSError("down")), tmp_path / "other", None, tries=2, wait_s=0)


def test_homes(tmp_path, monkeypatch):
    monkeypatch.setenv("TIDEWRIGHT_DATA", str(tmp_path / "d"))
    assert S.home().is_dir()
    with pytest.raises(ValueError):
        S.home("other")
    assert S.package_data().name == "data"


def answer(start, days, value):
    hours = [(dt.datetime.fromisoformat(start) + dt.timedelta(hours=h)).strftime("%Y-%m-%dT%H:%M") for h in range(24 * days)]
    return json.dumps({"hourly": {"time": hours, "temperature_2m": [value] * len(hours), "rain": [0.0] * len(hours)}})


def test_weather(spark, tmp_path):
    calls = []

    def fetch(url, params):
        calls.append(url)
        return answer(params["start_date"], 3, 1.0 if "archive" in url else 2.0)

    cache = f"file://{tmp_path}/weather"
    make = lambda f: WeatherService(spark, 51.5, 7.5, cache, f, ("temperature_2m", "rain"), dt.datetime(2024, 1, 10))
    got = make(fetch).between("2024-01-01T00:00:00", "2024-01-02T23:00:00")
    assert got.count() == 48 and got.agg(F.max("temperature_2m")).first()[0] == 1.0
    n = len(calls)
    make(fetch).between("2024-01-01T05:00:00", "2024-01-01T08:00:00").count()
    assert len(calls) == n  # from the cache
    both = make(fetch).between("2024-01-03T00:00:00", "2024-01-06T00:00:00")
    assert {r[0] for r in both.select("temperature_2m").distinct().collect()} == {1.0, 2.0}

    def down(url, params):
        raise OSError("down")

    rep = make(down).between("2024-02-01T00:00:00", "2024-02-02T12:00:00")
    assert rep.count() == 37 and rep.filter("temperature_2m is null").count() == 0
    with pytest.raises(OSError):
        make(down).between("2024-02-01T00:00:00", "2024-02-02T00:00:00", fallback=False)
    assert len(store.names(spark, cache)) == 2


def test_pipelines(spark, series, tmp_path):
    import numpy as np

    t = np.arange(24 * 20)
    s = series(list(10 + 3 * np.sin(2 * np.pi * t / 24)), b=list(20 + 3 * np.cos(2 * np.pi * t / 24)))
    naive = pipelines.forecast_many(s, 24, contamination=None)
    assert naive.count() == 48
    cov = pipelines.Covariates("DE", "NW", latitude=51.5, longitude=7.5, include_holidays=True, include_poly=True)
    home = f"file://{tmp_path}/model"
    got, meta, model = pipelines.forecast_with_covariates(s, 24, cov, RecursiveForecaster(lags=[1, 24]), model_dir=home)
    assert got.count() == 48 and meta["targets"] == ["b", "y"] and "is_holiday" in meta["exog"]
    assert abs(got.join(naive.withColumnRenamed("pred", "n"), ["series_id", "ts"]).agg(F.avg(F.abs(F.col("pred") - F.col("n")))).first()[0]) < 2
    again = pipelines.forecast_with_covariates(s, 24, cov, model_dir=home, force_train=False)[2]
    assert again.models == model.models
    combined, _, _ = pipelines.forecast_n_to_1(s, {"y": 1.0, "b": -1.0}, covariates=pipelines.Covariates(None), contamination=None)
    assert combined.count() == 24
    with pytest.raises(ValueError):
        pipelines.forecast_with_covariates(s, 0)


def test_workflow(spark, series, tmp_path):
    import numpy as np

    s = series(list(10 + 3 * np.sin(2 * np.pi * np.arange(24 * 20) / 24)))
    w = pipelines.ModelWorkflow("m", s, "2024-01-18", 3, predict_size=12, refit_size=2, forecaster=RecursiveForecaster(lags=4))
    w.tune([[1], 24])
    assert w.is_tuned and w.forecaster.lag_list == list(range(1, 25))
    package = w.package()
    assert package["future_errors"].first().MAE < 0.1 and package["train_errors"].count() == 1
    assert w.backtest()[0].first()[1] < 0.5
    assert len(w.feature_importance()) == 24
    w.save(f"file://{tmp_path}")
    assert store.last_iteration(spark, f"file://{tmp_path}", "m") == 3 and store.last_iteration(spark, f"file://{tmp_path}", "x") == -1
    again = pipelines.model_prediction(f"file://{tmp_path}", "m", lambda f, n: pipelines.ModelWorkflow("m", s, "2024-01-18", n, forecaster=f), spark)
    assert again["future_pred"].count() == 24
    assert pipelines.model_prediction(f"file://{tmp_path}", "x", None, spark) is None


def answer(kind, resolution, values, start="2024-01-01T22:00Z", end="2024-01-02T01:00Z"):
    inner = "".join(f"<Point><position>{i}</position><quantity>{v}</quantity></Point>" for i, v in values.items())
    return f'<?xml version="1.0"?><GL_MarketDocument xmlns="urn:x:{kind}"><TimeSeries><Period><timeInterval><start>{start}</start><end>{end}</end></timeInterval><resolution>{resolution}</resolution>{inner}</Period></TimeSeries></GL_MarketDocument>'


def test_energy_answers(tmp_path):
    from tidewright.sources import energy as E

    quarter = E.points(answer("a", "PT15M", {1: 10, 2: 20, 4: 40, 9: 5}))
    assert len(quarter) == 12 and [quarter[k] for k in sorted(quarter)] == [10, 20, 20, 40, 40, 40, 40, 40, 5, 5, 5, 5]
    asked = []

    def fetch(url, params):
        asked.append((url, params))
        return answer("a", "PT60M", {1: 1, 2: 2, 3: 3}) if params["processType"] == "A01" else answer("b", "PT30M", {1: 10, 2: 30, 3: 50, 4: 50}, end="2024-01-02T00:00Z")

    text = E.load_query("secret", "FR", fetch)("2024-01-01T22:00", "2024-01-02T01:00")
    assert text.splitlines() == ["Time (UTC),Forecasted Load,Actual Load", "2024-01-01 22:00:00,1.0,20.0", "2024-01-01 23:00:00,2.0,50.0", "2024-01-02 00:00:00,3.0,-"]
    assert asked[0][1]["periodStart"] == "202401012200" and asked[0][1]["outBiddingZone_Domain"] == E.ZONES["FR"]
    kept = S.download(E.load_query("secret", "FR", fetch), tmp_path, "2024-01-01T21:00:00", force=True, now=1_704_157_200)
    assert kept.read_text() == text
    nothing = "<Acknowledgement_MarketDocument><Reason><code>999</code><text>No matching data found</text></Reason></Acknowledgement_MarketDocument>"
    with pytest.raises(E.NoData, match="No matching"):
        E.load_query("secret", "FR", lambda *_: nothing)("2024-01-01", "2024-01-02")
    for bad in (("", "FR"), ("secret", "XX")):
        with pytest.raises(ValueError):
            E.load_query(*bad)
    with pytest.raises(ValueError):
        E.load_query("secret", "FR", fetch)("2024-01-02", "2024-01-01")
    with pytest.raises(ValueError):
        E._minutes("P1D")
