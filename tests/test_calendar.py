import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidewright.functions import calendar as K


@pytest.mark.parametrize(("year", "day"), [(2024, (3, 31)), (2025, (4, 20)), (2000, (4, 23)), (1995, (4, 16)), (2038, (4, 25))])
def test_easter(year, day):
    assert K.easter(year) == dt.date(year, *day)


def test_holidays(spark):
    got = K.holiday_frame(spark, "2023-12-25 00:00", "2023-12-25 23:00", country="DE", state="NW")
    assert got.count() == 24 and got.agg(F.sum("is_holiday")).first()[0] == 24
    assert dt.date(2024, 11, 20) in K.holidays([2024], "DE", "SN")
    assert dt.date(2024, 5, 30) in K.holidays([2024], "DE", "NW") and dt.date(2024, 5, 30) not in K.holidays([2024], "DE")
    with pytest.raises(ValueError):
        K.holidays([2024], "XX")


@pytest.mark.parametrize(("country", "state"), [(c, s) for c in K.HOLIDAYS for s in (None, *K.STATES.get(c, ()))])
def test_expression_agrees_with_dates(spark, country, state):
    """Every day of 1988 to 2040, and a far year."""
    df = spark.sql("SELECT explode(sequence(timestamp'1988-01-01', timestamp'2040-12-31', interval 1 day)) AS ts UNION ALL SELECT timestamp'2199-12-25'")
    got = {r[0].date() for r in K.with_holidays(df, country, state).filter("is_holiday = 1").select("ts").collect()}
    assert got == {*K.holidays(range(1988, 2041), country, state), dt.date(2199, 12, 25)}


def test_rules_of_years_and_states():
    on = lambda y, m, d, state: dt.date(y, m, d) in K.holidays([y], "DE", state)
    assert on(2019, 3, 8, "BE") and not on(2018, 3, 8, "BE") and on(2023, 3, 8, "MV") and not on(2022, 3, 8, "MV")
    assert on(2018, 10, 31, "HH") and on(2017, 10, 31, "HH") and on(2017, 10, 31, "BY") and not on(2016, 10, 31, "HH") and not on(2018, 10, 31, "BY")
    assert on(2010, 10, 31, "TH") and on(2019, 9, 20, "TH") and on(2024, 1, 6, "ST") and on(2018, 10, 31, "NI") and on(2018, 10, 31, "SH") and on(2018, 10, 31, "HB")
    assert on(1994, 11, 16, "HE") and not on(1995, 11, 22, "HE") and on(1995, 11, 22, "SN")
    assert on(2024, 3, 31, "BB") and not on(2024, 3, 31, "BE") and on(1990, 6, 17, None) and on(1990, 10, 3, None) and not on(1991, 6, 17, None)
    for bad in ("XX", "ni", ""):
        with pytest.raises(ValueError):
            K.holidays([2024], "DE", bad)


def test_local_dates_decide(spark):
    df = spark.sql("SELECT timestamp'2023-12-31 23:30:00' AS ts")
    assert K.with_holidays(df, zone="UTC").first().is_holiday == 0
    assert K.with_holidays(df, zone="Europe/Berlin").first().is_holiday == 1


def test_rbf(spark):
    df = spark.createDataFrame([(h,) for h in (0, 6, 12, 18, 23)], "hour int")
    cols = K.Period("daily", 4, "hour", (0, 23)).columns()
    rows = df.select("hour", *(c.alias(n) for n, c in cols.items())).collect()
    for r in rows:
        for i in range(4):
            d = abs(r.hour / 23 - i / 4)
            assert r[f"daily_{i}"] == pytest.approx(math.exp(-min(d, 1 - d) ** 2 / (2 * 0.25**2)))
            assert 0 <= r[f"daily_{i}"] <= 1
    for bad in ((0, (0, 1)), (2, (1, 1))):
        with pytest.raises(ValueError):
            K.Period("x", bad[0], "hour", bad[1])


def test_cyclical(spark):
    df = K.cyclical(spark.createDataFrame([(6,)], "hour int"))
    assert df.first().hour_sin == pytest.approx(1) and df.first().hour_cos == pytest.approx(0, abs=1e-12)
    assert df.columns == ["hour", "hour_sin", "hour_cos"]


def test_sun(spark):
    df = spark.sql("SELECT explode(array(timestamp'2024-06-21 12:00:00', timestamp'2024-12-21 12:00:00', timestamp'2024-12-21 02:00:00')) AS ts")
    rows = K.sun(df, 51.5, 7.5).orderBy("ts").collect()
    summer, winter_night, winter = rows
    assert summer.daylight_hours in (16, 17) and winter.daylight_hours in (7, 8)
    assert summer.is_daylight == 1 and winter_night.is_daylight == 0
    assert K.sun(df, 80.0, 7.5).orderBy("ts").first().daylight_hours == 24


def test_builder(spark):
    plain = K.ExogBuilder().build(spark, "2024-01-06", "2024-01-06 05:00")
    assert plain.columns == ["ts", "dayofyear", "dayofweek", "quarter", "month", "hour", "is_weekend"]
    assert plain.first().is_weekend == 1
    rich = K.ExogBuilder([K.Period("daily", 3, "hour", (0, 23))], "DE").build(spark, "2024-01-01", "2024-01-01 05:00")
    assert rich.columns == ["ts", "daily_0", "daily_1", "daily_2", "holidays", "is_weekend"] and rich.first().holidays == 1
    with pytest.raises(ValueError):
        K.calendar_parts(plain, ["fortnight"])
