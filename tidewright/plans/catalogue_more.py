"""More registered queries beside their SQL: sources and sinks, regressions that have a closed form, callables, streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidewright.functions import calendar as K
from tidewright.operators import curate, features, folds, grid, validate
from tidewright.plans import backtest as B
from tidewright.plans import pipelines
from tidewright.plans.catalogue import BASE, DAILY, TYPES, _EASTER, daily, events, filled, hourly, q6, query, rounded, streamed, table
from tidewright.plans.naive import SeasonalNaive
from tidewright.plans.recursive import RecursiveForecaster, path_quantiles
from tidewright.session import scratch, to_wide
from tidewright.sources import series as S
from tidewright.sources import weather as W

RECURSIVE = BASE.replace("WITH e", "WITH RECURSIVE e")
_LAG = "x AS (SELECT series_id, ts, pos, y, lag(y) OVER (PARTITION BY series_id ORDER BY ts) AS l FROM filled)"
_LAST = "z AS (SELECT series_id, max(ts) AS t, arg_max(y, ts) AS y FROM filled GROUP BY 1)"


def _path(coefficients: str, steps: int, value: str = "a + b * y", keys: str = "series_id") -> str:
    """The recursion of a forecast from each series' last value, by the coefficients of `coefficients`."""
    return f"p(series_id, t, step, y) AS (SELECT series_id, t, 0, y FROM z UNION ALL SELECT p.series_id, t, step + 1, {value} FROM p JOIN {coefficients} USING ({keys}) WHERE step < {steps})"


# ---- sources and sinks ------------------------------------------------------------------------------------------------


def _csv(spark, sf_dir, columns: dict[str, str], index: str = "time") -> str:
    """The hourly means of some event types as CSV files, under the names that a source expects."""
    wide = to_wide(hourly(spark, sf_dir), TYPES)
    path = scratch(spark, "csv")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias(index)
    wide.select(text, *(F.col(k).alias(v) for k, v in columns.items())).write.option("header", True).csv(f"{path}/interim/energy_load.csv")
    return path


@query(f"{BASE} SELECT series_id, ts, {q6('y')} AS y FROM hourly WHERE series_id IN ('click', 'view')")
def csv_scan(spark, sf_dir):
    path = _csv(spark, sf_dir, {t: t for t in TYPES})
    return rounded(S.from_csv(spark, f"{path}/interim/energy_load.csv", columns=["click", "view"], index="time").long(), "y")


@query(f"{BASE} SELECT series_id, ts, {q6('y')} AS y FROM hourly WHERE series_id IN ('error', 'signup')")
def frame_scan(spark, sf_dir):
    wide = to_wide(hourly(spark, sf_dir), TYPES)
    return rounded(S.fetch(spark, frame=wide, index="ts", columns=["error", "signup"]).long(), "y")


@query(f"{BASE} SELECT series_id, ts - INTERVAL 2 HOUR AS ts, {q6('y')} AS y FROM hourly WHERE series_id = 'click'")
def fetch_with_zone(spark, sf_dir):
    """Clock times of a zone two hours ahead of UTC."""
    path = _csv(spark, sf_dir, {"click": "click"})
    return rounded(S.fetch(spark, path=f"{path}/interim/energy_load.csv", zone="Etc/GMT-2").long(), "y")


_ONE = "SELECT '{}' AS series_id, ts, {} AS y FROM filled WHERE series_id = '{}'"


@query(f"{BASE} {_ONE.format('Actual Load', q6('y'), 'click')}")
def actual_load(spark, sf_dir):
    return rounded(S.load_load(spark, _csv(spark, sf_dir, {"click": "Actual Load", "view": "Forecasted Load"}, "Time (UTC)")), "y")


@query(f"{BASE} {_ONE.format('Forecasted Load', q6('y'), 'view')}")
def forecast_load(spark, sf_dir):
    return rounded(S.load_load_forecast(spark, _csv(spark, sf_dir, {"click": "Actual Load", "view": "Forecasted Load"}, "Time (UTC)")), "y")


@query(f"{BASE}, w AS (SELECT ts, max(y) FILTER (series_id = 'click') AS a, max(y) FILTER (series_id = 'view') AS b FROM hourly GROUP BY 1 ORDER BY 1 LIMIT 48) SELECT ts, {q6('a - 0.5 * b')} AS combined FROM w")
def ground_truth(spark, sf_dir):
    path = _csv(spark, sf_dir, {t: t for t in TYPES})
    return rounded(S.load_actual_combined(spark, f"{path}/interim/energy_load.csv", ["click", "view"], 48, [1.0, -0.5]), "combined")


_AR1 = f"c AS (SELECT series_id, regr_slope(y, l) AS b, regr_intercept(y, l) AS a FROM x WHERE l IS NOT NULL GROUP BY 1)"
_STEPS = f"SELECT series_id, t + to_hours(step) AS ts, CAST(step AS BIGINT) AS step, {q6('y')} AS pred FROM p WHERE step > 0"


@query(f"{RECURSIVE}, {_LAG}, {_AR1}, {_LAST}, {_path('c', 12)} {_STEPS}")
def model_store(spark, sf_dir):
    """Forecasts of a model that was saved and read again."""
    path = scratch(spark, "model")
    RecursiveForecaster(lags=1, estimator_params={"ridge": 0.0}).fit(filled(spark, sf_dir)).save(path)
    return rounded(RecursiveForecaster.load(spark, path).predict(12), "pred")


def _service(spark, sf_dir, cache: str | None = None) -> tuple[W.WeatherService, list[str]]:
    """A weather service whose answers are the means of one event type; and the hours that it knows."""
    import datetime as dt

    known = {r.ts.strftime("%Y-%m-%dT%H:%M"): r.y for r in hourly(spark, sf_dir).filter("series_id = 'view'").orderBy("ts").collect()}  # the answer of a service is one text
    times = list(known)

    def fetch(url, params):
        some = [t for t in times if params["start_date"] <= t[:10] <= params["end_date"]]
        return json.dumps({"hourly": {"time": some, "temperature_2m": [known[t] for t in some]}})

    return W.WeatherService(spark, 51.5, 7.5, cache, fetch, ["temperature_2m"], dt.datetime.fromisoformat(times[-1]) + dt.timedelta(days=30)), times


@query(f"{BASE} SELECT ts, {q6('y')} AS temperature_2m FROM filled WHERE series_id = 'view'")
def weather_service(spark, sf_dir):
    service, times = _service(spark, sf_dir)
    return rounded(service.between(times[0], times[-1]), "temperature_2m")


@query(f"{BASE} SELECT ts, {q6('y')} AS temperature_2m FROM filled WHERE series_id = 'view'")
def weather_cache(spark, sf_dir):
    """The second half was asked for first; the cache then holds both, and the last answer comes from it alone."""
    service, times = _service(spark, sf_dir, scratch(spark, "weather"))
    service.between(times[len(times) // 2], times[-1])
    service.between(times[0], times[-1])

    def fail(*_):
        raise RuntimeError("the cache should have answered")

    service.fetch = fail
    return rounded(service.between(times[0], times[-1]), "temperature_2m")


@query(f"{BASE}, v AS (SELECT * FROM filled WHERE series_id = 'view'), s AS (SELECT unnest(range(0, 48)) AS k), m AS (SELECT max(pos) AS m, max(ts) AS t FROM v) SELECT t + to_hours(k + 1) AS ts, {q6('y')} AS temperature_2m FROM s, m JOIN v ON v.pos = m - 23 + k % 24")
def weather_fallback(spark, sf_dir):
    """The network has failed: the last day that the cache knows, again and again."""
    import datetime as dt

    service, times = _service(spark, sf_dir, scratch(spark, "weather"))
    full = service.between(times[0], times[-1])
    service._save(full, None)

    def fail(*_):
        raise OSError("no network")

    service.fetch = fail
    end = dt.datetime.fromisoformat(times[-1])
    return rounded(service.between((end + dt.timedelta(hours=1)).isoformat(sep=" "), (end + dt.timedelta(hours=48)).isoformat(sep=" ")), "temperature_2m")


@query(f"{BASE} SELECT series_id, ts, {q6('y')} AS y FROM filled WHERE series_id IN ('click', 'view')")
def collected_series(spark, sf_dir):
    one = lambda t: filled(spark, sf_dir).filter(F.col("series_id") == t).select("ts", F.col("y").alias("value"))
    return rounded(validate.collect_series({t: one(t) for t in ("click", "view")}, 3600), "y")


# ---- keys, names and lags ---------------------------------------------------------------------------------------------


@query(f"{BASE}, k AS (SELECT DISTINCT ts FROM hourly WHERE series_id = 'click') SELECT 'grid' AS part, (SELECT count(*) FROM (SELECT * FROM k EXCEPT SELECT ts FROM filled)) + (SELECT count(*) FROM (SELECT ts FROM filled EXCEPT SELECT * FROM k)) = 0 AS same UNION ALL SELECT 'shifted', (SELECT count(*) FROM (SELECT ts + INTERVAL 30 MINUTE FROM k EXCEPT SELECT * FROM k)) = 0")
def index_guard(spark, sf_dir):
    h = hourly(spark, sf_dir).filter("series_id = 'click'")

    def same(other) -> bool:
        try:
            features.same_index(h, other)
            return True
        except ValueError:
            return False

    return spark.createDataFrame([("grid", same(filled(spark, sf_dir))), ("shifted", same(h.select((F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("ts"))))], "part string, same boolean")


@query("SELECT * FROM (VALUES (0, 'hour_sin'), (1, 'hour_cos'), (2, 'rain_window_1D_mean'), (3, 'rain'), (4, 'is_holiday'), (5, 'poly_month__hour')) t(pos, name)")
def selected_features(spark, sf_dir):
    names = features.select_features(["rain", "poly_month__hour", "hour", "hour_sin", "hour_cos", "rain_window_1D_mean", "is_holiday"], ["rain"], True, True, True)
    return spark.createDataFrame(list(enumerate(names)), "pos int, name string")


@query("SELECT name, unnest(lags) AS lag FROM (VALUES ('None', [CAST(NULL AS INTEGER)]), ('3', [1, 2, 3]), ('[24, 1, 24]', [1, 24])) t(name, lags)")
def lag_grid(spark, sf_dir):
    grids = features.lags_grid(None) | features.lags_grid([3, [24, 1, 24]])
    return spark.createDataFrame([(n, x) for n, lags in grids.items() for x in (lags or [None])], "name string, lag int")


@query(f"{BASE}, n AS (SELECT max(pos) + 1 AS n FROM filled) SELECT CAST(0 AS BIGINT) AS fold, CAST(0 AS BIGINT) AS train_start, CAST(300 AS BIGINT) AS train_end, CAST(300 AS BIGINT) AS test_start, CAST(n AS BIGINT) AS test_end, TRUE AS fit_forecaster FROM n")
def folds_one_step(spark, sf_dir):
    placed, n = B.placed_on_axis(filled(spark, sf_dir))
    return folds.OneStepAheadFold(300).split(spark, n)


# ---- functions as aggregates and statistics ---------------------------------------------------------------------------


@query(f"{BASE}, r AS (SELECT series_id, date_trunc('hour', ts) AS ts, max(y) - min(y) AS y FROM e GROUP BY 1, 2) SELECT h.series_id, h.ts, {q6('r.y')} AS y FROM hourly h LEFT JOIN r ON r.series_id = h.series_id AND r.ts = h.ts")
def resample_by_function(spark, sf_dir):
    return rounded(grid.resample(events(spark, sf_dir), "h", by=lambda c: F.max(c) - F.min(c)), "y")


@query(f"{BASE}, z AS (SELECT series_id, max(pos) AS z, max(ts) AS t FROM filled GROUP BY 1), s AS (SELECT *, unnest(range(1, 25)) AS step FROM z) SELECT s.series_id, t + to_hours(step) AS ts, CAST(step AS BIGINT) AS step, {q6('0.7 * f.y + 0.3 * g.y')} AS pred FROM s JOIN filled f ON f.series_id = s.series_id AND f.pos = z - 24 + step JOIN filled g ON g.series_id = s.series_id AND g.pos = z - 48 + step")
def naive_by_function(spark, sf_dir):
    return rounded(SeasonalNaive(24, 2, lambda a: 0.7 * F.get(a, 0) + 0.3 * F.get(a, 1)).fit(filled(spark, sf_dir)).predict(24), "pred")


@query(f"{BASE} SELECT series_id, ts, {q6('y')} AS y, CASE WHEN count(y) OVER w >= 6 THEN {q6('max(y) OVER w - min(y) OVER w')} END AS roll_span_6 FROM filled WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)")
def rolling_by_function(spark, sf_dir):
    span = features.RollingFeatures(["span"], 6, custom={"span": lambda s: s.max() - s.min()})
    return rounded(span.transform(filled(spark, sf_dir)), "y", "roll_span_6").select("series_id", "ts", "y", "roll_span_6")


@query(f"{BASE} SELECT ts, {q6('quantile_cont(y, 0.1)')} AS \"q_0.1\", {q6('quantile_cont(y, 0.5)')} AS \"q_0.5\", {q6('quantile_cont(y, 0.9)')} AS \"q_0.9\" FROM filled GROUP BY 1")
def quantiles_over_paths(spark, sf_dir):
    """The event types as paths of one forecast."""
    out = path_quantiles(filled(spark, sf_dir), [0.1, 0.5, 0.9], ["ts"], "y")
    return out.select("ts", *((F.round(F.col(f"`{c}`"), 6) + 0.0).alias(c) for c in out.columns[1:]))


# ---- training and prediction matrices ---------------------------------------------------------------------------------


@query(f"""{BASE}, m AS (SELECT series_id, ts, y, lag(y, 1) OVER w AS lag_1, lag(y, 24) OVER w AS lag_24, avg(y) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS a, count(y) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS n FROM filled WINDOW w AS (PARTITION BY series_id ORDER BY ts))
SELECT series_id, ts, {q6('y')} AS y, {q6('lag_1')} AS lag_1, {q6('lag_24')} AS lag_24, {q6('a', 'roll_mean_6')} AS roll_mean_6, CAST(hour(ts) AS DOUBLE) AS hour FROM m WHERE lag_24 IS NOT NULL AND n = 6""")
def train_matrix(spark, sf_dir):
    h = filled(spark, sf_dir)
    f = RecursiveForecaster(lags=[1, 24], window_features=features.RollingFeatures(["mean"], 6))
    return rounded(f.create_train_matrix(h, _hours(h)), "y", "lag_1", "lag_24", "roll_mean_6")


def _hours(h):
    return h.select("ts").distinct().withColumn("hour", F.hour("ts").cast("double"))


@query(f"{BASE}, n AS (SELECT *, max(pos) OVER (PARTITION BY series_id) - pos AS back FROM filled) SELECT series_id, max(ts) + INTERVAL 1 HOUR AS ts, CAST(1 AS BIGINT) AS step, {q6('max(y) FILTER (back = 0)')} AS lag_1, {q6('max(y) FILTER (back = 23)')} AS lag_24, {q6('avg(y) FILTER (back < 6)', 'roll_mean_6')} AS roll_mean_6 FROM n GROUP BY 1")
def predict_matrix_first_step(spark, sf_dir):
    f = RecursiveForecaster(lags=[1, 24], window_features=features.RollingFeatures(["mean"], 6)).fit(filled(spark, sf_dir))
    return rounded(f.create_predict_matrix(1), "lag_1", "lag_24", "roll_mean_6")


@query(f"""{RECURSIVE}, {_LAG}, {_AR1}, {_LAST}, {_path('c', 11)} SELECT series_id, t + to_hours(step + 1) AS ts, CAST(step + 1 AS BIGINT) AS step, {q6('y')} AS lag_1 FROM p""")
def predict_matrix_ar1(spark, sf_dir):
    f = RecursiveForecaster(lags=1, estimator_params={"ridge": 0.0}).fit(filled(spark, sf_dir))
    return rounded(f.create_predict_matrix(12), "lag_1")


# ---- regressions with a closed form -----------------------------------------------------------------------------------

EXACT = {"ridge": 0.0}


@query(f"{RECURSIVE}, {_LAG}, {_AR1}, {_LAST}, {_path('c', 24)} {_STEPS}")
def scaled_ar1_forecast(spark, sf_dir):
    f = RecursiveForecaster(lags=1, scaled="robust", estimator_params=EXACT).fit(filled(spark, sf_dir))
    return rounded(f.predict(24), "pred")


@query(f"""{RECURSIVE}, d AS (SELECT series_id, ts, y, y - lag(y) OVER (PARTITION BY series_id ORDER BY ts) AS d FROM filled), x AS (SELECT *, lag(d) OVER (PARTITION BY series_id ORDER BY ts) AS l FROM d),
c AS (SELECT series_id, regr_slope(d, l) AS b, regr_intercept(d, l) AS a FROM x WHERE l IS NOT NULL GROUP BY 1), z AS (SELECT series_id, max(ts) AS t, arg_max(y, ts) AS y, arg_max(d, ts) AS d FROM d GROUP BY 1),
p(series_id, t, step, d, y) AS (SELECT series_id, t, 0, d, y FROM z UNION ALL SELECT p.series_id, t, step + 1, a + b * d, y + a + b * d FROM p JOIN c USING (series_id) WHERE step < 24) {_STEPS}""")
def differenced_ar1_forecast(spark, sf_dir):
    f = RecursiveForecaster(lags=1, differencing=1, estimator_params=EXACT).fit(filled(spark, sf_dir))
    return rounded(f.predict(24), "pred")


@query(f"{RECURSIVE}, {_LAG}, c AS (SELECT regr_slope(y, l) AS b, regr_intercept(y, l) AS a FROM x WHERE l IS NOT NULL), {_LAST}, p(series_id, t, step, y) AS (SELECT series_id, t, 0, y FROM z UNION ALL SELECT series_id, t, step + 1, a + b * y FROM p, c WHERE step < 24) {_STEPS}")
def global_ar1_forecast(spark, sf_dir):
    """One model of all series."""
    f = RecursiveForecaster(lags=1, per_series=False, encoding=None, estimator_params=EXACT).fit(filled(spark, sf_dir))
    return rounded(f.predict(24), "pred")


def _two(y: str, u: str, v: str, rows: str, by: str = "") -> str:
    """Least squares of y on u and v, from covariances: columns b, g, a."""
    cov = lambda p, q: f"covar_pop({p}, {q})"
    group = f" GROUP BY {by}" if by else ""
    key = f"{by}, " if by else ""
    return f"(SELECT {key}(yu * vv - yv * uv) / (uu * vv - uv * uv) AS b, (yv * uu - yu * uv) / (uu * vv - uv * uv) AS g, my - (yu * vv - yv * uv) / (uu * vv - uv * uv) * mu - (yv * uu - yu * uv) / (uu * vv - uv * uv) * mv AS a FROM (SELECT {key}{cov(y, u)} AS yu, {cov(y, v)} AS yv, {cov(u, v)} AS uv, var_pop({u}) AS uu, var_pop({v}) AS vv, avg({y}) AS my, avg({u}) AS mu, avg({v}) AS mv FROM {rows}{group}))"


_CODES = "k AS (SELECT series_id, row_number() OVER (ORDER BY series_id) - 1 AS code FROM (SELECT DISTINCT series_id FROM filled))"


@query(f"{RECURSIVE}, {_LAG}, {_CODES}, xk AS (SELECT y, l, CAST(code AS DOUBLE) AS code FROM x JOIN k USING (series_id) WHERE l IS NOT NULL), c AS {_two('y', 'l', 'code', 'xk')}, {_LAST}, p(series_id, t, step, y) AS (SELECT series_id, t, 0, y FROM z UNION ALL SELECT p.series_id, t, step + 1, a + b * y + g * code FROM p JOIN k USING (series_id), c WHERE step < 24) {_STEPS}")
def global_ordinal_forecast(spark, sf_dir):
    """One model of all series, with the series' place among their names as a feature."""
    f = RecursiveForecaster(lags=1, per_series=False, encoding="ordinal", estimator_params=EXACT).fit(filled(spark, sf_dir))
    return rounded(f.predict(24), "pred")


@query(f"{BASE}, {_LAG}, h AS (SELECT series_id, ts, y, l, CAST(hour(ts) AS DOUBLE) AS h FROM x WHERE l IS NOT NULL), c AS {_two('y', 'l', 'h', 'h', 'series_id')} SELECT series_id, ts, {q6('y')} AS y, {q6('a + b * l + g * h')} AS pred FROM h JOIN c USING (series_id)")
def one_step_with_exog(spark, sf_dir):
    h = filled(spark, sf_dir)
    f = RecursiveForecaster(lags=1, estimator_params=EXACT).fit(h, _hours(h))
    return rounded(f.predict_one_step(h, _hours(h)), "y", "pred")


@query(f"{RECURSIVE}, {_LAG}, h AS (SELECT series_id, ts, y, l, CAST(hour(ts) AS DOUBLE) AS h FROM x WHERE l IS NOT NULL), c AS {_two('y', 'l', 'h', 'h', 'series_id')}, {_LAST}, {_path('c', 24, 'a + b * y + g * hour(t + to_hours(step + 1))')} {_STEPS}")
def forecast_with_exog(spark, sf_dir):
    h = filled(spark, sf_dir)
    f = RecursiveForecaster(lags=1, estimator_params=EXACT, scaled_exog="minmax").fit(h, _hours(h))
    ahead = grid.future(h.select("series_id", "ts"), 24, "h").select("ts").distinct().withColumn("hour", F.hour("ts").cast("double"))
    return rounded(f.predict(24, _hours(h).unionByName(ahead)), "pred")


_WEIGHTED = "w AS (SELECT series_id, y, l, 1.0 + hour(ts) AS w FROM x WHERE l IS NOT NULL), s AS (SELECT series_id, sum(w) AS n, sum(w * l) AS l1, sum(w * y) AS y1, sum(w * l * l) AS l2, sum(w * l * y) AS ly FROM w GROUP BY 1), c AS (SELECT series_id, (n * ly - l1 * y1) / (n * l2 - l1 * l1) AS b, (y1 - (n * ly - l1 * y1) / (n * l2 - l1 * l1) * l1) / n AS a FROM s)"


@query(f"{RECURSIVE}, {_LAG}, {_WEIGHTED}, {_LAST}, {_path('c', 24)} {_STEPS}")
def weighted_ar1_forecast(spark, sf_dir):
    h = filled(spark, sf_dir)
    weights = h.select("ts").distinct().withColumn("weight", 1.0 + F.hour("ts"))
    f = RecursiveForecaster(lags=1, estimator_params=EXACT).fit(h, weights=weights)
    return rounded(f.predict(24), "pred")


@query(f"{BASE} SELECT series_id, ts, CAST(1 + hour(ts) AS DOUBLE) AS weight FROM filled")
def custom_weights(spark, sf_dir):
    h = filled(spark, sf_dir)
    weights = h.select("ts").distinct().withColumn("weight", 1.0 + F.hour("ts"))
    return curate.look_up_weights(h.select("series_id", "ts"), weights)


class DayMean:
    """An estimator object: the mean of the features."""

    def fit(self, x, y):
        self.coef_ = [1 / x.shape[1]] * x.shape[1]
        return self

    def predict(self, x):
        return x.mean(axis=1)


@query(f"{BASE}, m AS (SELECT series_id, ts, y, avg(y) OVER w AS pred, count(y) OVER w AS n FROM filled WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) SELECT series_id, ts, {q6('y')} AS y, {q6('pred', 'roll_mean_24')} AS roll_mean_24 FROM m WHERE n = 24")
def estimator_object(spark, sf_dir):
    h = filled(spark, sf_dir)
    out = RecursiveForecaster(lags=24, estimator=DayMean()).fit(h).predict_one_step(h)
    return rounded(out.withColumnRenamed("pred", "roll_mean_24"), "y", "roll_mean_24")


@query(f"""{BASE}, {_LAG}, t AS (SELECT series_id, y, l FROM x WHERE l IS NOT NULL), o AS (SELECT series_id, y, l, sum(y) OVER v AS s, count(*) OVER v AS n, sum(y) OVER q AS total, count(*) OVER q AS m, lead(l) OVER (PARTITION BY series_id ORDER BY l) AS nx FROM t WINDOW v AS (PARTITION BY series_id ORDER BY l RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY series_id)),
gains AS (SELECT *, s * s / n + (total - s) * (total - s) / (m - n) AS gain FROM o WHERE nx > l), best AS (SELECT series_id, arg_max(l, gain) AS cut FROM gains GROUP BY 1), f AS (SELECT t.series_id, avg(y) FILTER (l <= cut) AS lo, avg(y) FILTER (l > cut) AS hi, any_value(cut) AS cut FROM t JOIN best USING (series_id) GROUP BY 1)
SELECT x.series_id, ts, {q6('y')} AS y, {q6('CASE WHEN l <= cut THEN lo ELSE hi END')} AS pred FROM x JOIN f USING (series_id) WHERE l IS NOT NULL""")
def stump_of_each_series(spark, sf_dir):
    """A tree of one split, in each series, at the best of all cuts."""
    h = filled(spark, sf_dir)
    f = RecursiveForecaster(lags=1, estimator="tree", estimator_params={"maxDepth": 1, "exact": True}).fit(h)
    return rounded(f.predict_one_step(h), "y", "pred")


@query(f"{BASE}, {_LAG}, {_AR1} SELECT series_id, 'lag_1' AS feature, {q6('b')} AS importance FROM c")
def importances(spark, sf_dir):
    f = RecursiveForecaster(lags=1, estimator_params=EXACT).fit(filled(spark, sf_dir))
    return rounded(spark.createDataFrame(f.feature_importances(), "series_id string, feature string, importance double"), "importance")


_RESIDUALS = "r AS (SELECT series_id, quantile_cont(abs(y - a - b * l), 0.8) AS width FROM x JOIN c USING (series_id) WHERE l IS NOT NULL GROUP BY 1)"


@query(f"{RECURSIVE}, {_LAG}, {_AR1}, {_RESIDUALS}, {_LAST}, {_path('c', 12)} SELECT p.series_id, t + to_hours(step) AS ts, CAST(step AS BIGINT) AS step, {q6('y')} AS pred, {q6('y - width')} AS lower_bound, {q6('y + width')} AS upper_bound FROM p JOIN r USING (series_id) WHERE step > 0")
def ar1_interval(spark, sf_dir):
    f = RecursiveForecaster(lags=1, estimator_params=EXACT).fit(filled(spark, sf_dir), store_residuals=True)
    return rounded(f.predict_interval(12, 0.8, binned=False), "pred", "lower_bound", "upper_bound")


@query(f"""{RECURSIVE}, {_LAG}, {_AR1}, {_LAST}, o AS (SELECT x.series_id, quantile_cont(abs(0.5 * y - a - b * l), 0.8) AS width FROM x JOIN c USING (series_id) WHERE l IS NOT NULL GROUP BY 1), {_path('c', 12)}
SELECT p.series_id, t + to_hours(step) AS ts, CAST(step AS BIGINT) AS step, {q6('y')} AS pred, {q6('y - width')} AS lower_bound, {q6('y + width')} AS upper_bound FROM p JOIN o USING (series_id) WHERE step > 0""")
def out_of_sample_interval(spark, sf_dir):
    """Intervals from residuals of values that the fit has not seen: here, halves of those that it has."""
    h = filled(spark, sf_dir)
    f = RecursiveForecaster(lags=1, estimator_params=EXACT).fit(h, store_residuals=True)
    f.set_out_sample_residuals(f.predict_one_step(h).withColumn("y", 0.5 * F.col("y")))
    return rounded(f.predict_interval(12, 0.8, in_sample=False, binned=False), "pred", "lower_bound", "upper_bound")


# ---- backtests --------------------------------------------------------------------------------------------------------


def _fold_sql(moving: bool) -> str:
    """Folds of 24 steps from position 300 on, every 120 rows; the AR(1) model of each fold's training rows, and its forecasts."""
    return f"""n AS (SELECT max(pos) + 1 AS n FROM filled), f AS (SELECT i AS fold, 300 + 120 * i AS s, least(300 + 120 * i + 24, n) AS u, {'300 + 120 * i' if moving else '300'} AS train_end FROM n, (SELECT unnest(range(0, 1000)) AS i) WHERE 300 + 120 * i < n),
c AS (SELECT fold, series_id, regr_slope(y, l) AS b, regr_intercept(y, l) AS a FROM f JOIN x ON x.pos < f.train_end WHERE l IS NOT NULL GROUP BY 1, 2), z AS (SELECT fold, series_id, s, u, y FROM f JOIN filled ON pos = s - 1),
p(fold, series_id, pos, u, y) AS (SELECT fold, series_id, s - 1, u, y FROM z UNION ALL SELECT p.fold, p.series_id, pos + 1, u, a + b * y FROM p JOIN c ON c.fold = p.fold AND c.series_id = p.series_id WHERE pos + 1 < u),
rows AS (SELECT p.series_id, ts, CAST(p.fold AS BIGINT) AS fold, CAST(p.pos AS BIGINT) AS pos, g.y, p.y AS pred FROM p JOIN f USING (fold) JOIN filled g ON g.series_id = p.series_id AND g.pos = p.pos WHERE p.pos >= s)"""


@query(f"{RECURSIVE}, {_LAG}, {_fold_sql(True)} SELECT series_id, ts, fold, pos, {q6('y')} AS y, {q6('pred')} AS pred FROM rows")
def backtest_refit_rows(spark, sf_dir):
    f = RecursiveForecaster(lags=1, estimator_params=EXACT)
    rows = B.backtest(f, filled(spark, sf_dir), folds.TimeSeriesFold(24, 300, fold_stride=120, refit=True, fixed_train_size=False))[1]
    return rounded(rows.select("series_id", "ts", F.col("fold").cast("long").alias("fold"), "pos", "y", "pred"), "y", "pred")


@query(f"{RECURSIVE}, {_LAG}, {_fold_sql(False)} SELECT series_id, {q6('avg(abs(y - pred))')} AS mean_absolute_error, {q6('avg(pow(y - pred, 2))')} AS mean_squared_error FROM rows GROUP BY 1")
def backtest_fit_once(spark, sf_dir):
    f = RecursiveForecaster(lags=1, estimator_params=EXACT)
    scored = B.backtest(f, filled(spark, sf_dir), folds.TimeSeriesFold(24, 300, fold_stride=120), ["mean_absolute_error", "mean_squared_error"])[0]
    return rounded(scored, "mean_absolute_error", "mean_squared_error")


@query(f"{BASE}, {_LAG}, c AS (SELECT series_id, regr_slope(y, l) AS b, regr_intercept(y, l) AS a FROM x WHERE l IS NOT NULL AND pos < 300 GROUP BY 1) SELECT series_id, {q6('avg(abs(y - a - b * l))')} AS mean_absolute_error FROM x JOIN c USING (series_id) WHERE pos >= 300 GROUP BY 1")
def backtest_one_step(spark, sf_dir):
    f = RecursiveForecaster(lags=1, estimator_params=EXACT)
    return rounded(B.backtest(f, filled(spark, sf_dir), folds.OneStepAheadFold(300))[0], "mean_absolute_error")


@query(f"""{BASE}, r AS (SELECT * FROM filled WHERE series_id <> 'view' OR pos >= 350), n AS (SELECT max(pos) + 1 AS n FROM r), f AS (SELECT i AS fold, 300 + 24 * i AS s, least(324 + 24 * i, n) AS u FROM n, (SELECT unnest(range(0, 10000)) AS i) WHERE 300 + 24 * i < n)
SELECT a.series_id, a.ts, CAST(fold AS BIGINT) AS fold, CAST(a.pos AS BIGINT) AS pos, {q6('a.y')} AS y, {q6('b.y')} AS pred FROM r a JOIN f ON a.pos >= s AND a.pos < u JOIN r b ON b.series_id = a.series_id AND b.pos = s - 24 + (a.pos - s) % 24""")
def backtest_ragged(spark, sf_dir):
    """One series starts later than the others."""
    h = filled(spark, sf_dir)
    start = h.agg(F.min("ts")).first()[0]
    late = h.filter((F.col("series_id") != "view") | (F.col("ts") >= F.lit(start) + F.expr("INTERVAL 350 HOURS")))
    rows = B.backtest(SeasonalNaive(24), late, folds.TimeSeriesFold(24, 300))[1]
    return rounded(rows.select("series_id", "ts", F.col("fold").cast("long").alias("fold"), "pos", "y", "pred"), "y", "pred")


# ---- the model workflow -----------------------------------------------------------------------------------------------

_DEV = 600
_DEV_AR1 = f"c AS (SELECT series_id, regr_slope(y, l) AS b, regr_intercept(y, l) AS a FROM x WHERE l IS NOT NULL AND pos < {_DEV} GROUP BY 1), z AS (SELECT series_id, ts AS t, y FROM filled WHERE pos = {_DEV - 1})"


def _workflow(spark, sf_dir) -> pipelines.ModelWorkflow:
    """An AR(1) model of the first 600 hours."""
    h = filled(spark, sf_dir)
    end = h.agg(F.min("ts") + F.expr(f"INTERVAL {_DEV - 1} HOURS")).first()[0]
    return pipelines.ModelWorkflow("ar1", h, str(end), forecaster=RecursiveForecaster(lags=1, estimator_params=EXACT), refit_size=3)


@query(f"{RECURSIVE}, {_LAG}, {_DEV_AR1}, {_path('c', 24)} {_STEPS}")
def workflow_forecast(spark, sf_dir):
    return rounded(_workflow(spark, sf_dir).fit().predict(), "pred")


_ERRORS = f"{q6('avg(abs(y - pred))')} AS MAE, {q6('avg(pow(y - pred, 2))')} AS MSE"


@query(f"{BASE}, {_LAG}, {_DEV_AR1}, o AS (SELECT series_id, x.y, a + b * l AS pred FROM x JOIN c USING (series_id) WHERE l IS NOT NULL AND pos < {_DEV}) SELECT series_id, {_ERRORS} FROM o GROUP BY 1")
def workflow_training_errors(spark, sf_dir):
    return rounded(_workflow(spark, sf_dir).fit().training_errors().drop("MAPE"), "MAE", "MSE")


@query(f"{RECURSIVE}, {_LAG}, {_DEV_AR1}, {_path('c', 24)}, o AS (SELECT p.series_id, f.y, p.y AS pred FROM p JOIN filled f ON f.series_id = p.series_id AND f.ts = t + to_hours(step) WHERE step > 0) SELECT series_id, {_ERRORS} FROM o GROUP BY 1")
def workflow_package(spark, sf_dir):
    """Errors of the future rows of the package that the last saved iteration gives."""
    home, flow = scratch(spark, "home"), _workflow(spark, sf_dir)
    for flow.iteration in (0, 1):
        flow.fit().save(home)
    make = lambda f, number: pipelines.ModelWorkflow("ar1", flow.series, flow.end_dev, number, forecaster=f)
    return rounded(pipelines.model_prediction(home, "ar1", make, spark)["future_errors"].drop("MAPE"), "MAE", "MSE")


@query(f"""{RECURSIVE}, {_LAG}, f AS (SELECT i AS fold, {_DEV} - 72 + 24 * i AS s, {_DEV} - 48 + 24 * i AS u FROM (SELECT unnest(range(0, 3)) AS i)), c AS (SELECT series_id, regr_slope(y, l) AS b, regr_intercept(y, l) AS a FROM x WHERE l IS NOT NULL AND pos < {_DEV} - 72 GROUP BY 1),
p(fold, series_id, pos, u, y) AS (SELECT fold, series_id, s - 1, u, y FROM f JOIN filled ON pos = s - 1 UNION ALL SELECT p.fold, p.series_id, pos + 1, u, a + b * y FROM p JOIN c USING (series_id) WHERE pos + 1 < u)
SELECT p.series_id, {q6('avg(abs(g.y - p.y))')} AS mean_absolute_error FROM p JOIN f USING (fold) JOIN filled g ON g.series_id = p.series_id AND g.pos = p.pos WHERE p.pos >= s GROUP BY 1""")
def workflow_backtest(spark, sf_dir):
    return rounded(_workflow(spark, sf_dir).backtest()[0], "mean_absolute_error")


@query(f"""{BASE}, {_LAG}, t AS (SELECT *, lag(y, 24) OVER (PARTITION BY series_id ORDER BY ts) AS l24 FROM filled WHERE pos < {_DEV}), e1 AS (SELECT series_id, regr_slope(y, l) AS b, regr_intercept(y, l) AS a FROM x WHERE l IS NOT NULL AND pos < {_DEV} - 24 GROUP BY 1), e24 AS (SELECT series_id, regr_slope(y, l24) AS b, regr_intercept(y, l24) AS a FROM t WHERE l24 IS NOT NULL AND pos < {_DEV} - 24 GROUP BY 1),
m AS (SELECT [1] AS lags, avg(abs(x.y - a - b * l)) AS e FROM x JOIN e1 USING (series_id) WHERE pos >= {_DEV} - 24 AND pos < {_DEV} UNION ALL SELECT [24], avg(abs(t.y - a - b * l24)) FROM t JOIN e24 USING (series_id) WHERE pos >= {_DEV} - 24) SELECT unnest(arg_min(lags, e)) AS lag FROM m""")
def workflow_tuned_lags(spark, sf_dir):
    flow = _workflow(spark, sf_dir).tune([[1], [24]])
    return spark.createDataFrame([(x,) for x in flow.forecaster.lag_list], "lag int")


# ---- checks -----------------------------------------------------------------------------------------------------------


@query(f"""{BASE}, n AS (SELECT (SELECT count(*) FROM hourly WHERE y IS NULL) AS holes, (SELECT count(DISTINCT series_id) FROM filled) AS k) SELECT * FROM (SELECT 'complete series' AS part, TRUE AS passes UNION ALL SELECT 'series with holes', holes = 0 FROM n UNION ALL SELECT 'exogenous values', holes = 0 FROM n
UNION ALL SELECT 'interval', TRUE UNION ALL SELECT 'falling interval', FALSE UNION ALL SELECT 'quantile', TRUE UNION ALL SELECT 'quantile beyond 1', FALSE UNION ALL SELECT 'not fitted', FALSE UNION ALL SELECT 'fitted', TRUE UNION ALL SELECT 'short last window', FALSE UNION ALL SELECT 'no residuals', FALSE UNION ALL SELECT 'uneven collection', k = 1 FROM n)""")
def input_checks(spark, sf_dir):
    """Which checks pass on the hourly series, before and after their holes are filled."""
    h, holed = filled(spark, sf_dir), hourly(spark, sf_dir)
    fresh, fitted = RecursiveForecaster(lags=24), RecursiveForecaster(lags=24).fit(h)
    uneven = h.filter((F.col("series_id") == h.agg(F.min("series_id")).first()[0]) | (F.hour("ts") % 2 == 0))
    short = h.filter(F.col("ts") >= F.lit(h.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 3 HOURS"))
    checks = {
        "complete series": lambda: validate.check_y(h),
        "series with holes": lambda: validate.check_y(holed),
        "exogenous values": lambda: validate.check_exog(holed, allow_missing=False),
        "interval": lambda: validate.check_interval([5, 95]),
        "falling interval": lambda: validate.check_interval([95, 5]),
        "quantile": lambda: validate.check_quantile([0.0, 1.0]),
        "quantile beyond 1": lambda: validate.check_quantile(1.5),
        "not fitted": lambda: validate.check_predict_input(fresh, 1),
        "fitted": lambda: validate.check_predict_input(fitted, 1),
        "short last window": lambda: validate.check_predict_input(fitted, 1, last_window=short),
        "no residuals": lambda: validate.check_residuals(fitted),
        "uneven collection": lambda: validate.collect_series(uneven),
    }

    def passes(check) -> bool:
        try:
            check()
            return True
        except ValueError:
            return False

    return spark.createDataFrame([(name, passes(c)) for name, c in checks.items()], "part string, passes boolean")


# ---- calendar tables --------------------------------------------------------------------------------------------------

_H = _EASTER.replace("(50), (60)", "(50)").replace("(11, 1), ", "")


@query(f"{DAILY}, {_H} SELECT ts, dayofyear(ts) AS dayofyear, isodow(ts) - 1 AS dayofweek, quarter(ts) AS quarter, month(ts) AS month, hour(ts) AS hour, CAST(CASE WHEN CAST(ts AS DATE) IN (SELECT CAST(holiday AS DATE) FROM h) THEN 1 ELSE 0 END AS INTEGER) AS holidays, CAST(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend FROM daily")
def exog_builder(spark, sf_dir):
    out = K.ExogBuilder(country="DE").add_to(daily(spark, sf_dir).select("ts"))
    return out.select("ts", *(F.col(c).cast("long").alias(c) for c in ("dayofyear", "dayofweek", "quarter", "month", "hour")), "holidays", "is_weekend")


_CYCLES = ", ".join(f"round({f}(2 * pi() * {x} / {n}), 6) + 0.0 AS {c}_{f}" for c, x, n in (("month", "month(ts)", 12), ("week", "weekofyear(ts)", 52), ("day_of_week", "(isodow(ts) - 1)", 6), ("hour", "hour(ts)", 24)) for f in ("sin", "cos"))


@query(f"{DAILY}, {_EASTER} SELECT ts, {_CYCLES}, CAST(CASE WHEN CAST(ts AS DATE) IN (SELECT CAST(holiday AS DATE) FROM h) THEN 1 ELSE 0 END AS INTEGER) AS is_holiday FROM daily")
def covariate_table(spark, sf_dir):
    bounds = daily(spark, sf_dir).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    out = pipelines.Covariates("DE", "NW", include_holidays=True).build(bounds, "D")
    return rounded(out, *(c for c in out.columns if c.endswith(("_sin", "_cos"))))


# ---- streams ----------------------------------------------------------------------------------------------------------

_MARK = "m AS (SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL 10 MINUTE AS w FROM events)"


@query(f"WITH ev AS (SELECT event_type AS series_id, CAST(ts AS TIMESTAMP) AS ts, value AS y FROM events), k AS (SELECT series_id, time_bucket(INTERVAL 1 HOUR, ts) + to_hours(i) AS e, y FROM ev, (SELECT unnest(range(1, 7)) AS i)), {_MARK} SELECT series_id, e AS ts, {q6('avg(y)')} AS roll_mean FROM k, m WHERE e <= w GROUP BY 1, 2")
def streaming_sliding(spark, sf_dir):
    """Means over windows of six hours that move by one."""
    from tidewright.streaming.resample import rolling_mean_stream

    return rounded(streamed(spark, sf_dir, lambda s: rolling_mean_stream(s, "6 hours", "1 hour")), "roll_mean").withColumn("roll_mean", F.round("roll_mean", 6) + 0.0)


@query(f"""WITH ev AS (SELECT event_type AS series_id, CAST(ts AS TIMESTAMP) AS ts, value AS y FROM events), g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), {_MARK}, t AS (SELECT series_id, k, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, sum(y) AS total FROM s GROUP BY 1, 2) SELECT series_id, start, "end", n, {q6('total')} AS total FROM t, m WHERE "end" <= w""")
def streaming_sessions(spark, sf_dir):
    from tidewright.streaming.resample import sessions_stream

    return rounded(streamed(spark, sf_dir, sessions_stream), "total")


@query(f"{BASE} SELECT series_id, ts, {q6('y')} AS y FROM hourly WHERE y IS NOT NULL")
def streaming_late_merge(spark, sf_dir):
    """A sink that keeps the last row of each key: a first batch of wrong values, one of corrections, and that one once more."""
    from tidewright.streaming.resample import current, merge_late

    target = scratch(spark, "merged")
    h = hourly(spark, sf_dir).filter("y IS NOT NULL")
    write = merge_late(spark, target, ["series_id", "ts"])
    write(h.withColumn("y", F.lit(-1.0)), 0)
    write(h, 1)
    write(h, 1)
    return rounded(current(spark, target, ["series_id", "ts"]), "y").select("series_id", "ts", "y")
