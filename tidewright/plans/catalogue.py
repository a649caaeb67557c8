"""The registered queries, each beside the SQL that gives the same rows.

Floating results are rounded on both sides, as sums in another order differ in their last digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import calendar as K
from tidewright.functions import metrics as M
from tidewright.operators import curate, features, folds, grid
from tidewright.plans import backtest as B
from tidewright.plans.naive import SeasonalNaive
from tidewright.plans.recursive import RecursiveForecaster
from tidewright.session import as_series, scratch, table, with_pos

#: The event types.
TYPES = ["click", "error", "purchase", "signup", "view"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Means over windows keep 8 digits, at which they have no ties; the rest 6."""
    return df.withColumns({c: F.round(c, digits(c)) + 0.0 for c in columns})


def digits(name: str) -> int:
    return 8 if name.startswith("roll_mean") or name.endswith("_window_1D_mean") else 6


def q6(x: str, name: str = "") -> str:
    return f"(round({x}, {digits(name)}) + 0.0)"


# ---- inputs -----------------------------------------------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_series(table(spark, sf_dir, "events"), "event_type", "ts", "value")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.resample(events(spark, sf_dir), "h")


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.fill(hourly(spark, sf_dir))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = as_series(table(spark, sf_dir, "orders"), F.lit("orders"), "o_orderdate", "o_totalprice")
    return grid.resample(orders, "D", by="sum")


def exog_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias("ts")).agg(F.sum("l_quantity").alias("qty"))


BASE = """WITH e AS (SELECT event_type AS series_id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN isnan(value) THEN NULL ELSE value END AS y FROM events),
b AS (SELECT series_id, date_trunc('hour', ts) AS ts, avg(y) AS y FROM e GROUP BY 1, 2),
g AS (SELECT unnest(generate_series((SELECT min(ts) FROM b), (SELECT max(ts) FROM b), INTERVAL 1 HOUR)) AS ts),
hourly AS (SELECT s.series_id, g.ts, b.y FROM (SELECT DISTINCT series_id FROM b) s CROSS JOIN g LEFT JOIN b ON b.series_id = s.series_id AND b.ts = g.ts),
filled AS (SELECT series_id, ts, row_number() OVER w - 1 AS pos,
  coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y
  FROM hourly WINDOW w AS (PARTITION BY series_id ORDER BY ts))"""

DAILY = """WITH d0 AS (SELECT date_trunc('day', CAST(o_orderdate AS TIMESTAMP)) AS ts, sum(o_totalprice) AS y FROM orders GROUP BY 1),
dg AS (SELECT unnest(generate_series((SELECT min(ts) FROM d0), (SELECT max(ts) FROM d0), INTERVAL 1 DAY)) AS ts),
daily AS (SELECT 'orders' AS series_id, dg.ts, coalesce(d0.y, 0.0) AS y FROM dg LEFT JOIN d0 ON d0.ts = dg.ts)"""


# ---- grids and filling ------------------------------------------------------------------------------------------------


@query(f"{BASE} SELECT series_id, ts, {q6('y')} AS y FROM hourly")
def resample_hourly_mean(spark, sf_dir):
    return rounded(hourly(spark, sf_dir), "y")


@query("""WITH b AS (SELECT event_type AS series_id, time_bucket(INTERVAL 30 MINUTE, CAST(ts AS TIMESTAMP)) AS ts, sum(value) AS y FROM events GROUP BY 1, 2),
g AS (SELECT unnest(generate_series((SELECT min(ts) FROM b), (SELECT max(ts) FROM b), INTERVAL 30 MINUTE)) AS ts)
SELECT s.series_id, g.ts, round(coalesce(b.y, 0.0), 6) + 0.0 AS y FROM (SELECT DISTINCT series_id FROM b) s CROSS JOIN g LEFT JOIN b ON b.series_id = s.series_id AND b.ts = g.ts""")
def resample_sum_empty_zero(spark, sf_dir):
    return rounded(grid.resample(events(spark, sf_dir), "30min", by="sum"), "y")


@query("""WITH x AS (SELECT event_type AS series_id, CAST(floor((epoch_us(CAST(ts AS TIMESTAMP)) - 1) / 10800000000.0) AS BIGINT) AS k, value AS y FROM events),
b AS (SELECT series_id, k, max(y) AS y FROM x GROUP BY 1, 2), g AS (SELECT unnest(generate_series((SELECT min(k) FROM b), (SELECT max(k) FROM b))) AS k)
SELECT s.series_id, make_timestamp((g.k + 1) * 10800000000) AS ts, round(b.y, 6) + 0.0 AS y FROM (SELECT DISTINCT series_id FROM b) s CROSS JOIN g LEFT JOIN b ON b.series_id = s.series_id AND b.k = g.k""")
def resample_right_label(spark, sf_dir):
    return rounded(grid.resample(events(spark, sf_dir), "3h", closed="right", label="right", by="max"), "y")


@query("""WITH o AS (SELECT date_trunc('day', min(CAST(ts AS TIMESTAMP))) AS o FROM events),
x AS (SELECT event_type AS series_id, CAST(floor((epoch_us(CAST(ts AS TIMESTAMP)) - epoch_us(o)) / 18000000000.0) AS BIGINT) AS k, value AS y, o FROM events, o),
b AS (SELECT series_id, k, min(y) AS y FROM x GROUP BY 1, 2), g AS (SELECT unnest(generate_series((SELECT min(k) FROM b), (SELECT max(k) FROM b))) AS k)
SELECT s.series_id, o + to_microseconds(g.k * 18000000000) AS ts, round(b.y, 6) + 0.0 AS y FROM (SELECT DISTINCT series_id FROM b) s CROSS JOIN g CROSS JOIN o LEFT JOIN b ON b.series_id = s.series_id AND b.k = g.k""")
def resample_uneven_origin(spark, sf_dir):
    return rounded(grid.resample(events(spark, sf_dir), "5h", by="min"), "y")


@query(f"{DAILY} SELECT series_id, ts, round(y, 2) + 0.0 AS y FROM daily")
def resample_daily_orders(spark, sf_dir):
    return daily(spark, sf_dir).withColumn("y", F.round("y", 2) + 0.0)


@query(f"{BASE}, r AS (SELECT series_id, min(ts) AS a, max(ts) AS z FROM b GROUP BY 1) SELECT h.series_id, h.ts FROM hourly h JOIN r ON r.series_id = h.series_id AND h.ts BETWEEN a AND z WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.series_id = h.series_id AND b.ts = h.ts)")
def completeness_gaps(spark, sf_dir):
    e = events(spark, sf_dir)
    return grid.gaps(e.select("series_id", grid.bin_start("ts", "h").alias("ts")).distinct())


@query(f"{BASE} SELECT series_id, ts, {q6('y')} AS y FROM filled")
def impute_ffill_bfill(spark, sf_dir):
    return rounded(filled(spark, sf_dir), "y")


@query(f"{BASE} SELECT series_id, ts, {q6('last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS y FROM hourly")
def impute_ffill_in_blocks(spark, sf_dir):
    return rounded(grid.forward_fill(hourly(spark, sf_dir), block="day"), "y")


@query(f"""{BASE}, p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS p FROM hourly),
n AS (SELECT *, last_value(y IGNORE NULLS) OVER a AS y0, last_value(CASE WHEN y IS NOT NULL THEN p END IGNORE NULLS) OVER a AS p0, first_value(y IGNORE NULLS) OVER z AS y1, first_value(CASE WHEN y IS NOT NULL THEN p END IGNORE NULLS) OVER z AS p1
FROM p WINDOW a AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series_id, ts, {q6("CASE WHEN y0 IS NULL THEN NULL WHEN y1 IS NULL OR p1 = p0 THEN y0 ELSE y0 + (y1 - y0) * (p - p0) / (p1 - p0) END")} AS y FROM n""")
def impute_linear(spark, sf_dir):
    return rounded(grid.interpolate(hourly(spark, sf_dir)), "y")


_DEDUPE = "SELECT user_id, event_type, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS hour, event_id, round(value, 6) + 0.0 AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, date_trunc('hour', CAST(ts AS TIMESTAMP)) ORDER BY ts {0}, event_id {0}) = 1"


def _dedupe(spark, sf_dir, last):
    e = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    kept = grid.keep_one(e, ["user_id", "event_type", "hour"], [F.col("ts"), F.col("event_id")], last)
    return kept.select("user_id", "event_type", "hour", "event_id", r6("value").alias("value"))


@query(_DEDUPE.format("DESC"))
def dedupe_keep_last(spark, sf_dir):
    return _dedupe(spark, sf_dir, True)


@query(_DEDUPE.format("ASC"))
def dedupe_keep_first(spark, sf_dir):
    return _dedupe(spark, sf_dir, False)


@query(f"{BASE}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rn FROM filled), f AS (SELECT series_id, max(ts) AS z, unnest(range(1, 49)) AS step FROM filled GROUP BY 1) SELECT f.series_id, z + to_hours(step) AS ts, CAST(step AS BIGINT) AS step, {q6('k.y')} AS y FROM f JOIN k ON k.series_id = f.series_id AND k.rn <= 24 AND 24 - k.rn = (step - 1) % 24")
def tile_last_day(spark, sf_dir):
    return rounded(grid.tile(filled(spark, sf_dir), 24, 48), "y")


@query(f"{BASE} SELECT series_id, max(ts) + to_hours(step) AS ts, CAST(step AS BIGINT) AS step FROM filled, (SELECT unnest(range(1, 13)) AS step) GROUP BY series_id, step")
def future_index(spark, sf_dir):
    return grid.future(filled(spark, sf_dir), 12)


@query(f"{BASE} SELECT series_id, CAST(count(CASE WHEN ts <= TIMESTAMP '2024-01-15 12:00:00' THEN 1 END) AS BIGINT) AS rows_until, CAST(date_diff('hour', max(ts), TIMESTAMP '2024-03-01 00:00:00') AS BIGINT) AS steps_until FROM filled GROUP BY 1")
def date_positions(spark, sf_dir):
    f = filled(spark, sf_dir)
    a = grid.steps_until(f, "2024-01-15 12:00:00", method="validation").withColumnRenamed("steps", "rows_until")
    return a.join(grid.steps_until(f, "2024-03-01").withColumnRenamed("steps", "steps_until"), "series_id")


@query(f"{BASE} SELECT strftime(min(ts), '%Y-%m-%dT%H:%M') AS start, strftime(max(ts), '%Y-%m-%dT%H:%M') AS \"end\", strftime(min(ts), '%Y-%m-%dT%H:%M') AS cov_start, strftime(max(ts) + INTERVAL 24 HOUR, '%Y-%m-%dT%H:%M') AS cov_end FROM filled")
def covariate_range(spark, sf_dir):
    return grid.covariate_range(filled(spark, sf_dir), 24)


@query(f"{BASE}, t AS (SELECT *, min(CASE WHEN y IS NOT NULL THEN ts END) OVER (PARTITION BY series_id) AS a, max(CASE WHEN y IS NOT NULL THEN ts END) OVER (PARTITION BY series_id) AS z FROM hourly) SELECT series_id, ts, {q6('y')} AS y FROM t WHERE ts BETWEEN a AND z")
def trim_series(spark, sf_dir):
    return rounded(features.trim(hourly(spark, sf_dir)), "y")


@query("SELECT event_id, CAST(ts AS TIMESTAMP) - INTERVAL 1 HOUR AS utc FROM events")
def utc_conversion(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.to_utc_timestamp(F.col("ts").cast("timestamp"), "+01:00").alias("utc"))


@query(f"{BASE} SELECT ts, " + ", ".join(f"{q6(f'max(CASE WHEN series_id = {chr(39)}{t}{chr(39)} THEN y END)')} AS {t}" for t in TYPES) + " FROM hourly GROUP BY ts")
def wide_from_long(spark, sf_dir):
    from tidewright.session import to_wide

    return rounded(to_wide(hourly(spark, sf_dir), TYPES), *TYPES)


@query("SELECT CAST(ts AS TIMESTAMP) AS ts, series_id, round(y, 6) + 0.0 AS y FROM (SELECT o_orderdate AS ts, 'price' AS series_id, o_totalprice AS y FROM orders UNION ALL SELECT o_orderdate, 'customer', CAST(o_custkey AS DOUBLE) FROM orders)")
def long_from_wide(spark, sf_dir):
    from tidewright.session import from_wide

    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"))
    return rounded(from_wide(orders, "ts"), "y")


# ---- curation ---------------------------------------------------------------------------------------------------------


@query(f"{BASE} SELECT series_id, ts, {q6('CASE WHEN NOT (y < 20 OR y > 80) THEN y END')} AS y FROM hourly")
def outlier_manual_mask(spark, sf_dir):
    return rounded(curate.mask_outside(hourly(spark, sf_dir), 20, 80)[0], "y")


@query(f"{BASE} SELECT series_id, count(CASE WHEN y < 20 OR y > 80 THEN 1 END) AS n_outliers FROM hourly GROUP BY 1")
def outlier_manual_count(spark, sf_dir):
    return curate.mask_outside(hourly(spark, sf_dir), 20, 80)[1]


@query(f"{BASE}, w AS (SELECT series_id, ts, 1.0 - max(CASE WHEN y IS NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS weight FROM hourly) SELECT f.series_id, f.ts, {q6('y')} AS y, CAST(weight AS DOUBLE) AS weight FROM filled f JOIN w USING (series_id, ts)")
def missing_weights(spark, sf_dir):
    return rounded(curate.missing_weights(hourly(spark, sf_dir), 12), "y")


@query(f"{BASE} SELECT series_id, count(*) - count(y) AS n_missing, {q6('100.0 * avg(CASE WHEN y IS NULL THEN 1.0 ELSE 0.0 END)')} AS pct_missing FROM hourly GROUP BY 1")
def missing_share(spark, sf_dir):
    return rounded(curate.missing_share(hourly(spark, sf_dir)), "pct_missing")


@query(f"{BASE}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM filled), s AS (SELECT *, round_even(n * 0.7, 0) AS a, round_even(n * 0.2, 0) AS v FROM n) SELECT series_id, ts, pos, CASE WHEN pos < a THEN 'train' WHEN pos < a + v THEN 'validation' ELSE 'test' END AS part FROM s")
def split_relative(spark, sf_dir):
    return curate.split_label(filled(spark, sf_dir), 0.7, 0.2).select("series_id", "ts", "pos", "part")


@query(f"{BASE} SELECT 'train' AS part, series_id, ts FROM filled WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' UNION ALL SELECT 'validation', series_id, ts FROM filled WHERE ts BETWEEN TIMESTAMP '2024-01-20 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00' UNION ALL SELECT 'test', series_id, ts FROM filled WHERE ts >= TIMESTAMP '2024-01-25 00:00:00'")
def split_absolute(spark, sf_dir):
    parts = curate.split_absolute(filled(spark, sf_dir), "2024-01-20", "2024-01-25")
    named = [p.select(F.lit(n).alias("part"), "series_id", "ts") for n, p in zip(("train", "validation", "test"), parts, strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(f"{BASE} SELECT series_id, ts, pos FROM filled WHERE pos >= 100 AND pos < 124")
def slice_positional(spark, sf_dir):
    return curate.slice_pos(with_pos(filled(spark, sf_dir)), 100, 124).select("series_id", "ts", "pos")


@query(f"{BASE} SELECT series_id, ts FROM filled WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 00:00:00'")
def slice_time(spark, sf_dir):
    return curate.slice_time(filled(spark, sf_dir), "2024-01-05", "2024-01-06").select("series_id", "ts")


# ---- window features --------------------------------------------------------------------------------------------------


@query(f"{BASE}, l AS (SELECT series_id, ts, pos, y, lag(y, 1) OVER w AS lag_1, lag(y, 2) OVER w AS lag_2, lag(y, 24) OVER w AS lag_24 FROM filled WINDOW w AS (PARTITION BY series_id ORDER BY ts)) SELECT series_id, ts, {', '.join(f'{q6(c)} AS {c}' for c in ('y', 'lag_1', 'lag_2', 'lag_24'))} FROM l WHERE pos >= 24")
def lag_matrix(spark, sf_dir):
    f = RecursiveForecaster(lags=[1, 2, 24])
    return rounded(f.create_train_matrix(filled(spark, sf_dir)), "y", "lag_1", "lag_2", "lag_24")


def _rolling_sql(stats: dict[str, str], size: int, closed: str) -> str:
    a, z = (size - 1, "CURRENT ROW") if closed == "right" else (size, "1 PRECEDING")
    cols = ", ".join(f"{q6(f'CASE WHEN count(y) OVER f >= {size} THEN {x} END', f'roll_{n}')} AS roll_{n}_{size}" for n, x in stats.items())
    return f"{BASE} SELECT series_id, ts, {cols} FROM filled WINDOW f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {a} PRECEDING AND {z})"


_BASIC = {"mean": "avg(y) OVER f", "std": "coalesce(stddev_samp(y) OVER f, 0)", "min": "min(y) OVER f", "max": "max(y) OVER f", "sum": "sum(y) OVER f"}


@query(_rolling_sql(_BASIC, 24, "left"))
def rolling_basic(spark, sf_dir):
    w = features.RollingFeatures(list(_BASIC), 24)
    return rounded(w.transform(filled(spark, sf_dir)).drop("y"), *w.names)


@query(_rolling_sql({"mean": "avg(y) OVER f", "std_pop": "stddev_pop(y) OVER f"}, 12, "right"))
def rolling_right_closed(spark, sf_dir):
    w = features.RollingFeatures(["mean", "std_pop"], 12, closed="right")
    return rounded(w.transform(filled(spark, sf_dir)).drop("y"), *w.names)


@query(_rolling_sql({"median": "quantile_cont(y, 0.5) OVER f"}, 24, "left"))
def rolling_median(spark, sf_dir):
    w = features.RollingFeatures(["median"], 24)
    return rounded(w.transform(filled(spark, sf_dir)).drop("y"), *w.names)


_EWM = "list_sum(list_transform(list(y) OVER f, lambda x, i: x * pow(0.7, 12 - i))) / (1 - pow(0.7, 12)) * 0.3"


@query(_rolling_sql({"ratio_min_max": "min(y) OVER f / max(y) OVER f", "coef_variation": "stddev_samp(y) OVER f / avg(y) OVER f", "ewm": _EWM}, 12, "left"))
def rolling_ratio_cv_ewm(spark, sf_dir):
    w = features.RollingFeatures(["ratio_min_max", "coef_variation", "ewm"], 12)
    return rounded(w.transform(filled(spark, sf_dir)).drop("y"), *w.names)


@query(_rolling_sql({"mean": "avg(y) OVER f", "max": "max(y) OVER f"}, 12, "left"))
def rolling_in_blocks(spark, sf_dir):
    w = features.RollingFeatures(["mean", "max"], 12)
    return rounded(w.transform(filled(spark, sf_dir), halo="week").drop("y"), *w.names)


@query(f"{BASE}, d AS (SELECT series_id, ts, y - lag(y) OVER (PARTITION BY series_id ORDER BY ts) AS d FROM filled) SELECT series_id, ts, {q6('d')} AS d1, {q6('d - lag(d) OVER (PARTITION BY series_id ORDER BY ts)')} AS d2 FROM d")
def difference(spark, sf_dir):
    f = features.difference(features.difference(filled(spark, sf_dir), 1, out="d1"), 2, out="d2")
    return rounded(f, "d1", "d2").select("series_id", "ts", "d1", "d2")


@query(f"{BASE} SELECT series_id, ts, {q6('y')} AS y FROM filled WHERE pos >= 200")
def difference_inverse(spark, sf_dir):
    """Second differences of the rows from 200 on, undone from the tails of the rows before."""
    f = with_pos(filled(spark, sf_dir))
    d = features.difference(f, 2).filter("pos >= 200").select("series_id", "ts", "d")
    tails = features.difference_tails(f.filter("pos < 200").drop("pos"), 2)
    return rounded(features.undifference(d, tails, 2), "y").select("series_id", "ts", "y")


@query(f"{BASE}, m AS (SELECT series_id, avg(y) AS m, stddev_pop(y) AS s FROM filled GROUP BY 1) SELECT series_id, ts, {q6('(y - m) / s')} AS z FROM filled JOIN m USING (series_id)")
def scale_series(spark, sf_dir):
    return rounded(features.scale(filled(spark, sf_dir))[0], "z").select("series_id", "ts", "z")


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS code FROM events")
def ordinal_encode(spark, sf_dir):
    return features.ordinal_encode(table(spark, sf_dir, "events"), "event_type").select("event_id", "code")


@query("SELECT c_custkey, " + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"c_mktsegment_{s}\"" for s in ("AUTOMOBILE", "BUILDING")) + " FROM customer")
def onehot_encode(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return features.onehot_encode(c, ["AUTOMOBILE", "BUILDING"], "c_mktsegment").drop("c_mktsegment")


# ---- calendar ---------------------------------------------------------------------------------------------------------


@query(f"{DAILY} SELECT ts, CAST(month(ts) AS INTEGER) AS month, CAST(weekofyear(ts) AS INTEGER) AS week, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofyear(ts) AS INTEGER) AS dayofyear, CAST(quarter(ts) AS INTEGER) AS quarter, CAST(CASE WHEN isodow(ts) > 5 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend FROM daily")
def calendar_parts(spark, sf_dir):
    d = daily(spark, sf_dir).select("ts")
    return K.calendar_parts(d, ["month", "week", "day_of_week", "hour", "dayofyear", "quarter"]).withColumn("is_weekend", K.is_weekend())


_CYCLE_SQL = ", ".join(f"{q6(f'{f}({x} * {2 * math.pi / p!r})')} AS {n}_{f}" for n, x, p in (("month", "month(ts)", 12), ("week", "weekofyear(ts)", 52), ("day_of_week", "(isodow(ts) - 1)", 6), ("hour", "hour(ts)", 24)) for f in ("sin", "cos"))


@query(f"{BASE} SELECT DISTINCT ts, {_CYCLE_SQL} FROM filled")
def cyclical_encode(spark, sf_dir):
    df = K.cyclical(K.calendar_parts(hourly(spark, sf_dir).select("ts").distinct()), drop=True)
    return rounded(df, *[c for c in df.columns if c != "ts"])


def _rbf_sql(x: str, n: int, lo: float, hi: float, name: str) -> str:
    d = lambda i: f"abs(({x} - {lo}) / ({hi} - {lo}) - {i / n!r})"
    return ", ".join(f"{q6(f'exp(-pow(least({d(i)}, 1 - {d(i)}), 2) / {2 * (1 / n) ** 2!r})')} AS {name}_{i}" for i in range(n))


@query(f"{BASE} SELECT DISTINCT ts, {_rbf_sql('hour(ts)::DOUBLE', 6, 1.0, 24.0, 'daily')}, {_rbf_sql('month(ts)::DOUBLE', 4, 1.0, 12.0, 'yearly')} FROM filled")
def rbf_encode(spark, sf_dir):
    df = K.calendar_parts(hourly(spark, sf_dir).select("ts").distinct(), ["hour", "month"])
    cols = K.Period("daily", 6, "hour", (1, 24)).columns() | K.Period("yearly", 4, "month", (1, 12)).columns()
    return df.select("ts", *(r6(c).alias(n) for n, c in cols.items()))


@query(f"{BASE} SELECT DISTINCT ts, CAST(month(ts) * hour(ts) AS DOUBLE) AS poly_month__hour, CAST(month(ts) * (isodow(ts) - 1) AS DOUBLE) AS poly_month__day_of_week, CAST(hour(ts) * (isodow(ts) - 1) AS DOUBLE) AS poly_hour__day_of_week FROM filled")
def interactions(spark, sf_dir):
    df = K.calendar_parts(hourly(spark, sf_dir).select("ts").distinct(), ["month", "hour", "day_of_week"])
    return features.interactions(df, ["month", "hour", "day_of_week"]).drop("month", "hour", "day_of_week")


_EASTER = """x AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM (SELECT DISTINCT year(ts) AS y FROM daily)),
z AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS d FROM x), v AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - d - c % 4) % 7 AS e FROM z),
u AS (SELECT y, d + e - 7 * ((a + 11 * d + 22 * e) // 451) + 114 AS f FROM v), s AS (SELECT y, make_date(y, f // 31, f % 31 + 1) AS easter FROM u),
h AS (SELECT easter + n AS holiday FROM s, (VALUES (-2), (1), (39), (50), (60)) k(n) UNION SELECT make_date(y, m, dd) FROM s, (VALUES (1, 1), (5, 1), (10, 3), (11, 1), (12, 25), (12, 26)) k(m, dd)
UNION SELECT make_date(y, 11, 22) - CAST((isodow(make_date(y, 11, 22)) + 4) % 7 AS INTEGER) FROM s WHERE y BETWEEN 1990 AND 1994)"""


@query(f"{DAILY}, {_EASTER} SELECT ts, CAST(CASE WHEN CAST(ts AS DATE) IN (SELECT CAST(holiday AS DATE) FROM h) THEN 1 ELSE 0 END AS INTEGER) AS is_holiday FROM daily")
def holiday_flags(spark, sf_dir):
    return K.with_holidays(daily(spark, sf_dir).select("ts"), "DE", "NW")


_SUN = f"""g AS (SELECT ts, (dayofyear(ts) - 1) * {2 * math.pi / 365!r} AS g FROM daily),
q AS (SELECT ts, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eq, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS decl FROM g),
p AS (SELECT ts, 720 - 4 * 7.5 - eq AS noon, degrees(acos(greatest(-1.0, least(1.0, {math.cos(math.radians(90.833))!r} / ({math.cos(math.radians(51.5))!r} * cos(decl)) - {math.tan(math.radians(51.5))!r} * tan(decl))))) AS half FROM q)"""


@query(f"{DAILY}, {_SUN} SELECT ts, CAST(round((noon - 4 * half) / 60) AS INTEGER) AS sunrise_hour, CAST(round((noon + 4 * half) / 60) AS INTEGER) AS sunset_hour, CAST(round((noon + 4 * half) / 60) - round((noon - 4 * half) / 60) AS INTEGER) AS daylight_hours, CAST(CASE WHEN hour(ts) >= round((noon - 4 * half) / 60) AND hour(ts) < round((noon + 4 * half) / 60) THEN 1 ELSE 0 END AS INTEGER) AS is_daylight FROM p")
def sun_features(spark, sf_dir):
    return K.sun(daily(spark, sf_dir).select("ts"), 51.5, 7.5)


# ---- joins ------------------------------------------------------------------------------------------------------------


@query(f"{BASE}, s AS (SELECT DISTINCT ts FROM filled), x AS (SELECT ts, avg(y) AS y FROM e GROUP BY ts) SELECT s.ts, {q6('x.y')} AS value FROM s ASOF LEFT JOIN x ON s.ts >= x.ts")
def asof_align(spark, sf_dir):
    known = events(spark, sf_dir).groupBy("ts").agg(F.avg("y").alias("value"))
    return rounded(features.asof(hourly(spark, sf_dir).select("ts").distinct(), known, ["value"]), "value")


@query(f"{BASE} SELECT series_id, ts, {q6('avg(y) OVER f', 'y_window_1D_mean')} AS y_window_1D_mean, {q6('max(y) OVER f')} AS y_window_1D_max, {q6('min(y) OVER f')} AS y_window_1D_min FROM filled WINDOW f AS (PARTITION BY series_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 89999 PRECEDING AND 3600 PRECEDING)")
def time_window_features(spark, sf_dir):
    df = features.time_windows(filled(spark, sf_dir), ["y"], ["1D"]).drop("y")
    return rounded(df, "y_window_1D_mean", "y_window_1D_max", "y_window_1D_min")


_QTY = "q AS (SELECT date_trunc('day', CAST(l_shipdate AS TIMESTAMP)) AS ts, sum(l_quantity) AS qty FROM lineitem GROUP BY 1)"


@query(f"{DAILY}, {_QTY} SELECT ts, round(y, 2) + 0.0 AS y, {q6('qty')} AS qty FROM daily JOIN q USING (ts)")
def exog_inner_merge(spark, sf_dir):
    df = features.exog_inner_merge(daily(spark, sf_dir), exog_daily(spark, sf_dir))
    return df.select("ts", (F.round("y", 2) + 0.0).alias("y"), r6("qty").alias("qty"))


@query(f"WITH {_QTY} SELECT ts, {q6('qty')} AS qty FROM q WHERE ts > TIMESTAMP '1998-01-01' AND ts <= TIMESTAMP '1998-02-01'")
def exog_future_block(spark, sf_dir):
    return rounded(features.exog_future(exog_daily(spark, sf_dir), "1998-01-01", "1998-02-01"), "qty")


@query(f"{DAILY}, {_QTY} SELECT ts, {q6('coalesce(qty, 0)')} AS qty FROM daily LEFT JOIN q USING (ts)")
def left_join_default(spark, sf_dir):
    return rounded(features.left_default(daily(spark, sf_dir).select("ts"), exog_daily(spark, sf_dir), default=0.0), "qty")


@query(f"{DAILY}, l AS (SELECT series_id, ts, y AS y_step_1, lead(y, 1) OVER w AS y_step_2, lead(y, 2) OVER w AS y_step_3 FROM daily WINDOW w AS (ORDER BY ts)) SELECT series_id, ts, {', '.join(f'round(y_step_{i}, 2) + 0.0 AS y_step_{i}' for i in (1, 2, 3))} FROM l WHERE y_step_3 IS NOT NULL")
def direct_exog_leads(spark, sf_dir):
    df = features.exog_direct(daily(spark, sf_dir), ["y"], 3)
    return df.withColumns({f"y_step_{i}": F.round(f"y_step_{i}", 2) + 0.0 for i in (1, 2, 3)})


@query(f"{BASE} SELECT ts, " + ", ".join(f"{q6(f'max(CASE WHEN series_id = {chr(39)}{t}{chr(39)} THEN y END)')} AS {t}" for t in TYPES) + " FROM filled GROUP BY ts")
def outer_concat(spark, sf_dir):
    f = filled(spark, sf_dir)
    parts = [f.filter(F.col("series_id") == t).select("ts", F.col("y").alias(t)) for t in TYPES]
    return rounded(features.outer_concat(parts), *TYPES)


# ---- seasonal-naive forecasts -----------------------------------------------------------------------------------------


@query(f"{BASE}, z AS (SELECT *, max(ts) OVER (PARTITION BY series_id) AS z FROM filled) SELECT series_id, ts + INTERVAL 24 HOUR AS ts, CAST(date_diff('hour', z, ts) + 24 AS BIGINT) AS step, {q6('y')} AS pred FROM z WHERE ts > z - INTERVAL 24 HOUR")
def seasonal_naive_24h(spark, sf_dir):
    return rounded(SeasonalNaive("1 day").fit(filled(spark, sf_dir)).predict(24), "pred")


@query(f"{BASE}, z AS (SELECT series_id, max(pos) AS z, max(ts) AS t FROM filled GROUP BY 1), s AS (SELECT *, unnest(range(1, 37)) AS step FROM z), k AS (SELECT *, unnest(range(0, 3)) AS k FROM s) SELECT k.series_id, t + to_hours(step) AS ts, CAST(step AS BIGINT) AS step, {q6('avg(f.y)')} AS pred FROM k JOIN filled f ON f.series_id = k.series_id AND f.pos = z - 24 + 1 + (step - 1) % 24 - k * 24 GROUP BY ALL")
def seasonal_naive_multi_offset(spark, sf_dir):
    return rounded(SeasonalNaive(24, n_offsets=3).fit(filled(spark, sf_dir)).predict(36), "pred")


@query(f"{DAILY}, z AS (SELECT max(ts) AS z FROM daily), s AS (SELECT z, unnest(range(1, 41)) AS step FROM z), a AS (SELECT step, z, z + to_days(CAST(step AS INTEGER)) AS ts FROM s), m AS (SELECT *, CASE WHEN ts - INTERVAL 1 MONTH <= z THEN 1 ELSE 2 END AS m FROM a) SELECT 'orders' AS series_id, m.ts, CAST(step AS BIGINT) AS step, round(d.y, 2) + 0.0 AS pred FROM m JOIN daily d ON d.ts = m.ts - to_months(m)")
def seasonal_naive_month_offset(spark, sf_dir):
    f = SeasonalNaive("1 month", rule="D").fit(daily(spark, sf_dir)).predict(40)
    return f.withColumn("pred", F.round("pred", 2) + 0.0)


_WEIGHTS = {"click": 1.0, "view": -0.5, "purchase": 2.0, "error": -1.0}
_WEIGHT_SQL = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in _WEIGHTS.items()) + ") w(series_id, w)"


@query(f"{BASE}, z AS (SELECT *, max(ts) OVER (PARTITION BY series_id) AS z FROM filled) SELECT ts + INTERVAL 24 HOUR AS ts, {q6('CASE WHEN count(*) = count(y) THEN sum(y * w) END')} AS combined FROM z JOIN {_WEIGHT_SQL} USING (series_id) WHERE ts > z - INTERVAL 24 HOUR GROUP BY 1")
def weighted_n_to_1(spark, sf_dir):
    w = spark.createDataFrame(list(_WEIGHTS.items()), "series_id string, w double")
    return rounded(curate.weighted_sum(SeasonalNaive("1 day").fit(filled(spark, sf_dir)).predict(24), w), "combined")


@query(f"{BASE}, z AS (SELECT *, max(ts) OVER (PARTITION BY series_id) AS z FROM filled), c AS (SELECT ts, sum(y * w) AS c FROM z JOIN {_WEIGHT_SQL} USING (series_id) WHERE ts > z - INTERVAL 24 HOUR GROUP BY 1) SELECT {q6('avg(c)')} AS mean, {q6('stddev_samp(c)')} AS std, {q6('min(c)')} AS min, {q6('max(c)')} AS max FROM c")
def combined_summary(spark, sf_dir):
    w = spark.createDataFrame(list(_WEIGHTS.items()), "series_id string, w double")
    c = curate.weighted_sum(SeasonalNaive("1 day").fit(filled(spark, sf_dir)).predict(24), w)
    return c.agg(r6(F.avg("combined")).alias("mean"), r6(F.stddev_samp("combined")).alias("std"), r6(F.min("combined")).alias("min"), r6(F.max("combined")).alias("max"))


# ---- bins, residuals and intervals ------------------------------------------------------------------------------------

_EDGES = "ed AS (SELECT series_id, list_sort(list_distinct(quantile_cont(pred, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS edges FROM res GROUP BY 1)"
_RES = "res AS (SELECT series_id, ts, y, pred, y - pred AS residual FROM (SELECT *, lag(y, 24) OVER (PARTITION BY series_id ORDER BY ts) AS pred FROM filled) WHERE pred IS NOT NULL)"
_BIN = "len(list_filter(edges[2:len(edges) - 1], lambda x: x <= pred))"


def _residuals(spark, sf_dir):
    return SeasonalNaive(24, n_bins=4).fit(filled(spark, sf_dir), store_residuals=True)


@query(f"{BASE}, {_RES}, {_EDGES} SELECT series_id, CAST({_BIN} AS BIGINT) AS bin, count(*) AS n FROM res JOIN ed USING (series_id) GROUP BY 1, 2")
def quantile_bins(spark, sf_dir):
    return _residuals(spark, sf_dir).residuals.groupBy("series_id", F.col("bin").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE}, {_RES}, {_EDGES}, i AS (SELECT series_id, edges, unnest(range(1, len(edges))) AS k FROM ed) SELECT series_id, CAST(k - 1 AS BIGINT) AS bin, {q6('edges[k]')} AS lo, {q6('edges[k + 1]')} AS hi FROM i")
def bin_intervals(spark, sf_dir):
    return rounded(_residuals(spark, sf_dir).binner.intervals().withColumn("bin", F.col("bin").cast("long")), "lo", "hi")


@query(f"{BASE}, {_RES}, {_EDGES} SELECT series_id, CAST({_BIN} AS BIGINT) AS bin, {q6('avg(residual)')} AS mean_residual, {q6('quantile_cont(abs(residual), 0.9)')} AS width FROM res JOIN ed USING (series_id) GROUP BY 1, 2")
def residuals_by_bin(spark, sf_dir):
    r = _residuals(spark, sf_dir).residuals
    return r.groupBy("series_id", F.col("bin").cast("long").alias("bin")).agg(r6(F.avg("residual")).alias("mean_residual"), r6(F.percentile(F.abs("residual"), F.lit(0.9))).alias("width"))


@query(f"""{BASE}, {_RES}, {_EDGES}, wd AS (SELECT series_id, {_BIN} AS bin, quantile_cont(abs(residual), 0.9) AS width FROM res JOIN ed USING (series_id) GROUP BY 1, 2), pw AS (SELECT series_id, quantile_cont(abs(residual), 0.9) AS pooled FROM res GROUP BY 1),
z AS (SELECT *, max(ts) OVER (PARTITION BY series_id) AS z FROM filled), fc AS (SELECT series_id, ts + INTERVAL 24 HOUR AS ts, y AS pred FROM z WHERE ts > z - INTERVAL 24 HOUR), fb AS (SELECT fc.*, {_BIN} AS bin FROM fc JOIN ed USING (series_id))
SELECT fb.series_id, ts, {q6('pred')} AS pred, {q6('pred - coalesce(width, pooled)')} AS lower_bound, {q6('pred + coalesce(width, pooled)')} AS upper_bound FROM fb JOIN pw ON pw.series_id = fb.series_id LEFT JOIN wd ON wd.series_id = fb.series_id AND wd.bin = fb.bin""")
def conformal_interval(spark, sf_dir):
    df = _residuals(spark, sf_dir).predict_interval(24, 0.9)
    return rounded(df, "pred", "lower_bound", "upper_bound").drop("step")


# ---- folds and backtests ----------------------------------------------------------------------------------------------

_N = "n AS (SELECT CAST(max(pos) + 1 AS BIGINT) AS n FROM filled)"


def _fold_columns(init: str, stride: int, steps: int, gap: int, window: int, fixed: bool, moving: bool) -> str:
    ts = f"{init} + i * {stride}"
    return f"""CAST(i AS BIGINT) AS fold, CAST({f'i * {stride}' if fixed and moving else 0} AS BIGINT) AS train_start, CAST({ts if moving else init} AS BIGINT) AS train_end, CAST({ts} - {window} AS BIGINT) AS last_window_start, CAST({ts} AS BIGINT) AS last_window_end,
    CAST({ts} AS BIGINT) AS test_start, CAST(least({ts} + {gap + steps}, n) AS BIGINT) AS test_end, CAST({ts} + {gap} AS BIGINT) AS test_start_with_gap, CAST(least({ts} + {gap + steps}, n) AS BIGINT) AS test_end_with_gap"""


@query(f"{BASE}, {_N}, i AS (SELECT n, unnest(range(0, CAST(ceil((n - 300) / 24.0) AS BIGINT))) AS i FROM n) SELECT {_fold_columns('300', 24, 24, 0, 24, False, True)}, true AS fit_forecaster FROM i")
def folds_expanding(spark, sf_dir):
    cv = folds.TimeSeriesFold(24, 300, window_size=24, refit=True, fixed_train_size=False)
    return cv.split(spark, B.placed_on_axis(filled(spark, sf_dir))[1])


@query(f"{BASE}, {_N}, i AS (SELECT n, unnest(range(0, CAST(ceil((n - 306) / 12.0) AS BIGINT))) AS i FROM n), f AS (SELECT {_fold_columns('300', 12, 24, 6, 48, True, True)}, i % 2 = 0 AS fit_forecaster FROM i) SELECT * FROM f WHERE test_end - test_start - 6 >= 24")
def folds_rolling_gap(spark, sf_dir):
    cv = folds.TimeSeriesFold(24, 300, window_size=48, fold_stride=12, refit=2, gap=6, allow_incomplete_fold=False)
    return cv.split(spark, B.placed_on_axis(filled(spark, sf_dir))[1])


@query(f"{BASE}, {_N}, i AS (SELECT n, unnest(range(0, CAST(ceil((n - 300) / 24.0) AS BIGINT))) AS i FROM n) SELECT {_fold_columns('300', 24, 24, 0, 24, True, False)}, i = 0 AS fit_forecaster FROM i WHERE i % 3 = 0")
def folds_skipped(spark, sf_dir):
    return folds.TimeSeriesFold(24, 300, window_size=24, skip_folds=3).split(spark, B.placed_on_axis(filled(spark, sf_dir))[1])


_BACK = f"""{_N}, fo AS (SELECT i, 300 + i * 12 AS s, least(300 + i * 12 + 24, n) AS z FROM (SELECT n, unnest(range(0, CAST(ceil((n - 300) / 12.0) AS BIGINT))) AS i FROM n)),
bt AS (SELECT t.series_id, t.ts, fo.i AS fold, t.pos, t.y, h.y AS pred FROM filled t JOIN fo ON t.pos >= fo.s AND t.pos < fo.z JOIN filled h ON h.series_id = t.series_id AND h.pos = fo.s - 24 + (t.pos - fo.s) % 24),
kept AS (SELECT * FROM bt QUALIFY row_number() OVER (PARTITION BY series_id, ts ORDER BY fold DESC) = 1)"""


def _backtest_rows(spark, sf_dir):
    series = filled(spark, sf_dir)
    empty = events(spark, sf_dir).filter(F.col("ts").isNotNull()).isEmpty()
    placed, n = (with_pos(series), 0) if empty else B.placed_on_axis(series)
    cv = folds.TimeSeriesFold(24, 300, fold_stride=12)
    return B.naive_rows(placed, cv.split(spark, max(n, 301)), 24)  # a table of up to 300 times, or none, has no row in the fold of 301


@query(f"{BASE}, {_BACK} SELECT series_id, ts, CAST(fold AS BIGINT) AS fold, CAST(pos AS BIGINT) AS pos, {q6('y')} AS y, {q6('pred')} AS pred FROM bt")
def backtest_naive(spark, sf_dir):
    return rounded(_backtest_rows(spark, sf_dir), "y", "pred")


_METRIC_SQL = f"""{q6('avg(pow(y - pred, 2))')} AS mean_squared_error, {q6('avg(abs(y - pred))')} AS mean_absolute_error, {q6('avg(abs(y - pred) / greatest(abs(y), 2.220446049250313e-16))')} AS mean_absolute_percentage_error,
{q6('avg(pow(ln(1 + y) - ln(1 + pred), 2))')} AS mean_squared_log_error, {q6('quantile_cont(abs(y - pred), 0.5)')} AS median_absolute_error,
{q6('100 * avg(CASE WHEN abs(y) + abs(pred) = 0 THEN 0 ELSE abs(y - pred) / ((abs(y) + abs(pred)) / 2) END)')} AS symmetric_mean_absolute_percentage_error"""
_METRICS = ["mean_squared_error", "mean_absolute_error", "mean_absolute_percentage_error", "mean_squared_log_error", "median_absolute_error", "symmetric_mean_absolute_percentage_error"]


@query(f"{BASE}, {_BACK} SELECT series_id, {_METRIC_SQL} FROM kept GROUP BY 1")
def metrics_all(spark, sf_dir):
    return rounded(M.score(B.keep_last_fold(_backtest_rows(spark, sf_dir)), _METRICS, ["series_id"]), *_METRICS)


@query(f"{BASE}, {_BACK}, tr AS (SELECT series_id, y - lag(y) OVER (PARTITION BY series_id ORDER BY ts) AS d FROM filled WHERE pos < 300), sc AS (SELECT series_id, avg(abs(d)) AS a, sqrt(avg(d * d)) AS q FROM tr GROUP BY 1), er AS (SELECT series_id, avg(abs(y - pred)) AS mae, sqrt(avg(pow(y - pred, 2))) AS rmse FROM kept GROUP BY 1) SELECT series_id, {q6('mae / a')} AS mean_absolute_scaled_error, {q6('rmse / q')} AS root_mean_squared_scaled_error FROM er JOIN sc USING (series_id)")
def mase_rmsse(spark, sf_dir):
    scored, _ = B.backtest(SeasonalNaive(24), filled(spark, sf_dir), folds.TimeSeriesFold(24, 300, fold_stride=12), list(M.SCALED))
    return rounded(scored, *M.SCALED)


@query(f"{BASE}, c AS (SELECT series_id, CASE WHEN y > 50 THEN 1 ELSE 0 END AS y, CASE WHEN lag(y) OVER (PARTITION BY series_id ORDER BY ts) > 50 THEN 1 ELSE 0 END AS p FROM filled), k AS (SELECT series_id, sum(y * p) AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn, sum((1 - y) * (1 - p)) AS tn FROM c GROUP BY 1) SELECT series_id, {q6('(tp + tn) / (tp + tn + fp + fn)')} AS accuracy_score, {q6('(tp / (tp + fn) + tn / (tn + fp)) / 2')} AS balanced_accuracy_score, {q6('2 * tp / (2 * tp + fp + fn)')} AS f1_score, {q6('tp / (tp + fp)')} AS precision_score, {q6('tp / (tp + fn)')} AS recall_score FROM k")
def classification_metrics(spark, sf_dir):
    w = Window.partitionBy("series_id").orderBy("ts")
    df = filled(spark, sf_dir).select("series_id", "ts", (F.col("y") > 50).cast("int").alias("y"), F.coalesce((F.lag("y").over(w) > 50).cast("int"), F.lit(0)).alias("pred"))
    names = ["accuracy_score", "balanced_accuracy_score", "f1_score", "precision_score", "recall_score"]
    return rounded(M.score(df, names, ["series_id"]), *names)


@query(f"{BASE}, {_BACK} SELECT series_id, {q6('avg(CASE WHEN y BETWEEN pred - 10 AND pred + 10 THEN 1.0 ELSE 0.0 END)')} AS coverage FROM kept GROUP BY 1")
def coverage(spark, sf_dir):
    rows = B.keep_last_fold(_backtest_rows(spark, sf_dir)).withColumns({"lower_bound": F.col("pred") - 10, "upper_bound": F.col("pred") + 10})
    return rows.groupBy("series_id").agg(r6(M.coverage()).alias("coverage"))


@query(f"{BASE}, {_BACK} SELECT series_id, {q6('avg(greatest(0.9 * (y - pred), -0.1 * (y - pred)))')} AS pinball_90, {q6('avg(greatest(0.1 * (y - pred), -0.9 * (y - pred)))')} AS pinball_10 FROM kept GROUP BY 1")
def pinball(spark, sf_dir):
    return B.keep_last_fold(_backtest_rows(spark, sf_dir)).groupBy("series_id").agg(r6(M.pinball(0.9)).alias("pinball_90"), r6(M.pinball(0.1)).alias("pinball_10"))


@query(f"""{BASE}, m AS (SELECT t.series_id, t.ts, t.y, h.y AS pred FROM filled t JOIN filled h ON h.series_id = t.series_id AND t.pos - h.pos IN (24, 48, 72, 96, 120) WHERE t.pos >= 120),
a AS (SELECT series_id, ts, avg(abs(pred - y)) AS a FROM m GROUP BY 1, 2), s AS (SELECT x.series_id, x.ts, avg(abs(x.pred - z.pred)) / 2 AS s FROM m x JOIN m z ON x.series_id = z.series_id AND x.ts = z.ts GROUP BY 1, 2) SELECT series_id, ts, {q6('a - s')} AS crps FROM a JOIN s USING (series_id, ts)""")
def crps_ensemble(spark, sf_dir):
    f = with_pos(filled(spark, sf_dir))
    w = Window.partitionBy("series_id").orderBy("ts")
    m = f.withColumn("_m", F.array(*(F.lag("y", 24 * k).over(w) for k in range(1, 6)))).filter("pos >= 120").select("series_id", "ts", "y", F.explode("_m").alias("pred"))
    return rounded(M.crps_ensemble(m, ["series_id", "ts"]), "crps")


@query(f"""{BASE}, qq AS (SELECT series_id, quantile_cont(y, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q, arg_max(y, ts) AS y FROM filled GROUP BY 1), rg AS (SELECT *, least(q[1], y) - greatest((greatest(q[5], y) - least(q[1], y)) * 0.1, 1e-9) AS lo, greatest(q[5], y) + greatest((greatest(q[5], y) - least(q[1], y)) * 0.1, 1e-9) AS hi FROM qq),
pt AS (SELECT series_id, i, y, q, lo + i * (hi - lo) / 999 AS x, (hi - lo) / 999 AS s FROM rg, (SELECT unnest(range(0, 1000)) AS i)),
cd AS (SELECT series_id, i, s, pow(CASE WHEN x < q[1] THEN 0.0 WHEN x < q[2] THEN 0.25 * (x - q[1]) / (q[2] - q[1]) WHEN x < q[3] THEN 0.25 + 0.25 * (x - q[2]) / (q[3] - q[2]) WHEN x < q[4] THEN 0.5 + 0.25 * (x - q[3]) / (q[4] - q[3]) WHEN x < q[5] THEN 0.75 + 0.25 * (x - q[4]) / (q[5] - q[4]) ELSE 1.0 END - CASE WHEN x >= y THEN 1.0 ELSE 0.0 END, 2) AS g FROM pt)
SELECT series_id, {q6('sum(CASE WHEN i IN (0, 999) THEN g / 2 ELSE g END * s)')} AS crps FROM cd GROUP BY 1""")
def crps_quantiles(spark, sf_dir):
    levels = [0.0, 0.25, 0.5, 0.75, 1.0]
    q = filled(spark, sf_dir).groupBy("series_id").agg(F.percentile("y", F.array(*(F.lit(x) for x in levels))).alias("q"), F.max_by("y", "ts").alias("y"))
    wide = q.select("series_id", "y", *(F.col("q")[i].alias(f"q{i}") for i in range(5)))
    return rounded(M.crps_quantiles(wide, [f"q{i}" for i in range(5)], levels), "crps").select("series_id", "crps")


@query(f"{BASE} SELECT ts FROM hourly WHERE series_id = 'click' AND y IS NOT NULL INTERSECT SELECT ts FROM hourly WHERE series_id = 'view' AND y IS NOT NULL")
def index_intersection(spark, sf_dir):
    h = hourly(spark, sf_dir).filter("y is not null")
    return h.filter("series_id = 'click'").select("ts").intersect(h.filter("series_id = 'view'").select("ts"))


@query("SELECT event_type AS series_id FROM events WHERE value > 50 EXCEPT SELECT event_type FROM events WHERE value > 1e9")
def level_difference(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.filter("y > 50").select("series_id").distinct().exceptAll(e.filter("y > 1e9").select("series_id").distinct())


@query(f"{BASE}, x AS (SELECT ts, series_id, avg(y) AS y FROM e GROUP BY 1, 2), l AS (SELECT series_id, ts FROM filled) SELECT l.series_id, l.ts, {q6('x.y')} AS value FROM l ASOF LEFT JOIN x ON l.series_id = x.series_id AND l.ts >= x.ts")
def asof_by_key_in_blocks(spark, sf_dir):
    right = events(spark, sf_dir).groupBy("series_id", "ts").agg(F.avg("y").alias("value"))
    left = hourly(spark, sf_dir).select("series_id", "ts")
    return rounded(features.asof(left, right, ["value"], by=["series_id"], block="day"), "value")


@query(f"{BASE}, {_BACK} SELECT {q6('avg(abs(y - pred))')} AS MAE, {q6('avg(pow(y - pred, 2))')} AS MSE FROM kept")
def compare_actual_predicted(spark, sf_dir):
    rows = B.keep_last_fold(_backtest_rows(spark, sf_dir))
    got = M.compare(rows.select("series_id", "ts", "y"), rows.select("series_id", "ts", "pred"))
    return got.select(r6("MAE").alias("MAE"), r6("MSE").alias("MSE"))


# ---- regression forecasts ---------------------------------------------------------------------------------------------


@query(f"""{BASE.replace("WITH e", "WITH RECURSIVE e")}, x AS (SELECT series_id, y, lag(y) OVER (PARTITION BY series_id ORDER BY ts) AS l FROM filled), c AS (SELECT series_id, regr_slope(y, l) AS b, regr_intercept(y, l) AS a FROM x WHERE l IS NOT NULL GROUP BY 1),
z AS (SELECT series_id, max(ts) AS t, arg_max(y, ts) AS y FROM filled GROUP BY 1), p(series_id, t, step, y) AS (SELECT series_id, t, 0, y FROM z UNION ALL SELECT p.series_id, t, step + 1, a + b * y FROM p JOIN c USING (series_id) WHERE step < 24)
SELECT series_id, t + to_hours(step) AS ts, CAST(step AS BIGINT) AS step, {q6('y')} AS pred FROM p WHERE step > 0""")
def ar1_recursive_forecast(spark, sf_dir):
    f = RecursiveForecaster(lags=1, estimator_params={"ridge": 0.0}).fit(filled(spark, sf_dir))
    return rounded(f.predict(24), "pred")


@query(f"""{BASE}, x AS (SELECT series_id, ts, y, lag(y, 24) OVER (PARTITION BY series_id ORDER BY ts) AS l FROM filled), c AS (SELECT series_id, regr_slope(y, l) AS b, regr_intercept(y, l) AS a FROM x WHERE l IS NOT NULL GROUP BY 1) SELECT series_id, ts, {q6('y')} AS y, {q6('a + b * l')} AS pred FROM x JOIN c USING (series_id) WHERE l IS NOT NULL""")
def one_step_linear(spark, sf_dir):
    f = RecursiveForecaster(lags=[24], estimator_params={"ridge": 0.0})
    h = filled(spark, sf_dir)
    return rounded(f.fit(h).predict_one_step(h), "y", "pred")


@query()
def global_linear_forecast(spark, sf_dir):
    f = RecursiveForecaster(lags=[1, 2, 24], window_features=features.RollingFeatures(["mean"], 24), per_series=False, encoding="onehot")
    return f.fit(filled(spark, sf_dir)).predict(24)


@query()
def gbt_forecast(spark, sf_dir):
    f = RecursiveForecaster(lags=[1, 24], estimator="gbt", estimator_params={"maxIter": 5, "maxDepth": 3})
    return f.fit(filled(spark, sf_dir)).predict(24)


@query()
def bootstrap_quantiles(spark, sf_dir):
    f = RecursiveForecaster(lags=[1, 24]).fit(filled(spark, sf_dir), store_residuals=True)
    return f.predict_quantiles(12, (0.1, 0.5, 0.9), n_boot=100)


@query()
def recursive_intervals(spark, sf_dir):
    f = RecursiveForecaster(lags=[1, 24], differencing=1).fit(filled(spark, sf_dir), store_residuals=True)
    return f.predict_interval(12, 0.8)


@query()
def predict_matrix(spark, sf_dir):
    f = RecursiveForecaster(lags=[1, 24], window_features=features.RollingFeatures(["mean"], 6))
    return f.fit(filled(spark, sf_dir)).create_predict_matrix(12)


@query()
def backtest_recursive(spark, sf_dir):
    return B.backtest(RecursiveForecaster(lags=[1, 24]), filled(spark, sf_dir), folds.TimeSeriesFold(24, 300, fold_stride=120), ["mean_absolute_error"])[0]


@query()
def outliers_isolation(spark, sf_dir):
    return curate.get_outliers(hourly(spark, sf_dir), 0.02)


@query()
def covariate_pipeline(spark, sf_dir):
    from tidewright.plans import pipelines

    cov = pipelines.Covariates("DE", "NW", latitude=51.5, longitude=7.5, include_holidays=True)
    return pipelines.forecast_with_covariates(events(spark, sf_dir), 24, cov, RecursiveForecaster(lags=[1, 2, 24]))[0]


@query()
def n_to_1_pipeline(spark, sf_dir):
    from tidewright.plans import pipelines

    return pipelines.forecast_n_to_1(events(spark, sf_dir), _WEIGHTS, covariates=pipelines.Covariates(country=None), contamination=None)[0]


@query(ORACLE_SQL["seasonal_naive_24h"])
def naive_pipeline(spark, sf_dir):
    from tidewright.plans import pipelines

    return rounded(pipelines.forecast_many(events(spark, sf_dir), 24, contamination=None), "pred")


@query("""WITH b AS (SELECT event_type AS series_id, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS ts, avg(value) AS y FROM events GROUP BY 1, 2), m AS (SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL 10 MINUTE AS w FROM events) SELECT series_id, ts, round(y, 6) + 0.0 AS y FROM b, m WHERE ts + INTERVAL 1 HOUR <= w""")
def streaming_resample(spark, sf_dir):
    """The events as a stream of files; hours that the watermark has passed are final."""
    from tidewright.streaming.resample import resample_stream

    return rounded(streamed(spark, sf_dir, resample_stream), "y")


def streamed(spark: SparkSession, sf_dir: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream of the events' files leaves in a table of Parquet files when all of them have been read."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    out = operator(as_series(stream, "event_type", "ts", "value"))
    path = scratch(spark, "stream")
    q = out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


from tidewright.plans import catalogue_more  # noqa: E402, F401  registers its queries
