"""Calendar, cyclical, radial-basis, holiday and daylight features as column expressions over a timestamp in UTC."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> expression; Monday is day 0, weeks are ISO weeks.
PARTS = {
    "month": F.month,
    "week": F.weekofyear,
    "day_of_week": F.weekday,
    "hour": F.hour,
    "dayofyear": F.dayofyear,
    "dayofweek": F.weekday,
    "quarter": F.quarter,
    "day": F.dayofmonth,
    "year": F.year,
}
#: The period of each cyclical feature.
CYCLES = {"month": 12, "week": 52, "day_of_week": 6, "hour": 24, "sunrise_hour": 24, "sunset_hour": 24}


def calendar_parts(df: DataFrame, parts: Sequence[str] = ("month", "week", "day_of_week", "hour"), ts: str = "ts") -> DataFrame:
    unknown = set(parts) - set(PARTS)
    if unknown:
        raise ValueError(f"unknown calendar parts: {sorted(unknown)}")
    return df.withColumns({p: PARTS[p](ts) for p in parts})


def is_weekend(ts: str = "ts") -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def cyclical(df: DataFrame, cycles: dict[str, float] | None = None, drop: bool = False) -> DataFrame:
    """{name}_sin and {name}_cos of 2 pi x / period for each named column that df has."""
    cycles = {c: p for c, p in (cycles or CYCLES).items() if c in df.columns}
    out = {}
    for c, period in cycles.items():
        angle = F.col(c) * (2 * math.pi / period)
        out |= {f"{c}_sin": F.sin(angle), f"{c}_cos": F.cos(angle)}
    df = df.withColumns(out) if out else df
    return df.drop(*cycles) if drop else df


@dataclass(frozen=True)
class Period:
    """A periodic feature: n_periods basis functions of a column whose values lie in input_range."""

    name: str
    n_periods: int
    column: str
    input_range: tuple[float, float]

    def __post_init__(self):
        if self.n_periods < 1:
            raise ValueError("n_periods must be positive")
        if self.input_range[0] >= self.input_range[1]:
            raise ValueError("input_range must rise")

    def columns(self) -> dict[str, Column]:
        return rbf(F.col(self.column), self.n_periods, self.input_range, self.name)


def rbf(x: Column, n: int, input_range: tuple[float, float], name: str) -> dict[str, Column]:
    """{name}_{i}: bells of width 1 / n around i / n on the circle of the scaled input."""
    lo, hi = input_range
    v = (x - lo) / (hi - lo)
    out = {}
    for i in range(n):
        away = F.abs(v - i / n)
        d = F.least(away, 1 - away)
        out[f"{name}_{i}"] = F.exp(-(d * d) / (2 * (1 / n) ** 2))
    return out


# ---- holidays -------------------------------------------------------------------------------------------------------


def easter(year: int) -> dt.date:
    """Easter Sunday of the Gregorian calendar."""
    a, b, c = year % 19, year // 100, year % 100
    d = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    e = (32 + 2 * (b % 4) + 2 * (c // 4) - d - c % 4) % 7
    f = d + e - 7 * ((a + 11 * d + 22 * e) // 451) + 114
    return dt.date(year, f // 31, f % 31 + 1)


@dataclass(frozen=True)
class Day:
    """A holiday: a date of the year, days from Easter Sunday, or the last given weekday (Monday is 0) before a date. With the years
    in which it holds, both included, and the states; none for all of the country."""

    date: tuple[int, int] | None = None
    easter: int | None = None
    before: tuple[int, int, int] | None = None
    first: int = 1
    last: int = 9999
    states: tuple[str, ...] = ()


def _days(dates: Sequence[tuple[int, int]], easter: Sequence[int]) -> list[Day]:
    return [Day(date=d) for d in dates] + [Day(easter=n) for n in easter]


# States, and public holidays by law, with the years in which rules changed.
STATES = {
    "DE": ("BB", "BE", "BW", "BY", "HB", "HE", "HH", "MV", "NI", "NW", "RP", "SH", "SL", "SN", "ST", "TH"),
}
HOLIDAYS: dict[str, list[Day]] = {
    "DE": [
        *_days([(1, 1), (5, 1), (12, 25), (12, 26)], [-2, 1, 39, 50]),
        Day((6, 17), first=1954, last=1990),
        Day((10, 3), first=1990),
        Day((10, 31), first=2017, last=2017),
        Day(before=(11, 23, 2), first=1990, last=1994),
        Day(before=(11, 23, 2), first=1995, states=("SN",)),
        Day((1, 6), states=("BW", "BY", "ST")),
        Day((3, 8), first=2019, states=("BE",)),
        Day((3, 8), first=2023, states=("MV",)),
        Day((5, 8), first=2020, last=2020, states=("BE",)),
        Day((5, 8), first=2025, last=2025, states=("BE",)),
        Day(easter=0, states=("BB",)),
        Day(easter=49, states=("BB",)),
        Day(easter=60, states=("BW", "BY", "HE", "NW", "RP", "SL")),
        Day((8, 15), states=("SL",)),
        Day((9, 20), first=2019, states=("TH",)),
        Day((10, 31), first=1990, states=("BB", "MV", "SN", "ST", "TH")),
        Day((10, 31), first=2018, states=("HB", "HH", "NI", "SH")),
        Day((11, 1), states=("BW", "BY", "NW", "RP", "SL")),
    ],
    "AT": [*_days([(1, 1), (1, 6), (5, 1), (8, 15), (11, 1), (12, 8), (12, 25), (12, 26)], [1, 39, 50, 60]), Day((10, 26), first=1967)],
    "BE": _days([(1, 1), (5, 1), (7, 21), (8, 15), (11, 1), (11, 11), (12, 25)], [0, 1, 39, 49, 50]),
    "CH": [*_days([(1, 1), (12, 25)], [39]), Day((8, 1), first=1994)],
    "CZ": [*_days([(1, 1), (5, 1), (5, 8), (7, 5), (7, 6), (9, 28), (10, 28), (11, 17), (12, 24), (12, 25), (12, 26)], [1]), Day(easter=-2, first=2016)],
    "DK": [*_days([(1, 1), (12, 25), (12, 26)], [-3, -2, 0, 1, 39, 49, 50]), Day(easter=26, last=2023)],
    "ES": _days([(1, 1), (1, 6), (5, 1), (8, 15), (10, 12), (11, 1), (12, 6), (12, 8), (12, 25)], [-2]),
    "FR": _days([(1, 1), (5, 1), (5, 8), (7, 14), (8, 15), (11, 1), (11, 11), (12, 25)], [1, 39, 50]),
    "IT": [*_days([(1, 1), (1, 6), (4, 25), (5, 1), (6, 2), (8, 15), (11, 1), (12, 8), (12, 25), (12, 26)], [0, 1]), Day((10, 4), first=2026)],
    "LU": [*_days([(1, 1), (5, 1), (6, 23), (8, 15), (11, 1), (12, 25), (12, 26)], [1, 39, 50]), Day((5, 9), first=2019)],
    "NO": _days([(1, 1), (5, 1), (5, 17), (12, 25), (12, 26)], [-3, -2, 0, 1, 39, 49, 50]),
    "PL": [*_days([(1, 1), (5, 1), (5, 3), (8, 15), (11, 1), (11, 11), (12, 25), (12, 26)], [0, 1, 49, 60]), Day((1, 6), first=2011), Day((12, 24), first=2025)],
}


def rules_of(country: str = "DE", state: str | None = None) -> list[Day]:
    """The holidays of a country and state; unknown ones are errors."""
    if country not in HOLIDAYS:
        raise ValueError(f"no holidays are known for {country!r}; known: {sorted(HOLIDAYS)}")
    if state is not None and state not in STATES.get(country, ()):
        raise ValueError(f"{country} has no state {state!r} here; known: {sorted(STATES.get(country, ()))}")
    return [d for d in HOLIDAYS[country] if not d.states or state in d.states]


def holidays(years: Iterable[int], country: str = "DE", state: str | None = None) -> list[dt.date]:
    found = set()
    for y in years:
        for d in rules_of(country, state):
            if d.first <= y <= d.last:
                if d.before:
                    end = dt.date(y, *d.before[:2]) - dt.timedelta(days=1)
                    found.add(end - dt.timedelta(days=(end.weekday() - d.before[2]) % 7))
                else:
                    found.add(dt.date(y, *d.date) if d.date else easter(y) + dt.timedelta(days=d.easter))
    return sorted(found)


def easter_of(year: Column) -> Column:
    """easter() as an expression over a year."""
    whole = lambda x, n: F.floor(x / n).cast("int")
    a, b, c = year % 19, whole(year, 100), year % 100
    d = (19 * a + b - whole(b, 4) - whole(b - whole(b + 8, 25) + 1, 3) + 15) % 30
    e = (32 + 2 * (b % 4) + 2 * whole(c, 4) - d - c % 4) % 7
    f = d + e - 7 * whole(a + 11 * d + 22 * e, 451) + 114
    return F.make_date(year, whole(f, 31), f % 31 + 1)


def is_holiday(date: Column, country: str = "DE", state: str | None = None) -> Column:
    """Whether a date is a holiday, for any year: an expression, so there is no table to join and no range of years."""
    year = F.year(date)
    days_from = F.datediff(date, easter_of(year))
    out = F.lit(False)
    for d in rules_of(country, state):
        if d.before:
            m, day, weekday = d.before
            away = F.datediff(F.make_date(year, F.lit(m), F.lit(day)), date)
            hit = (F.weekday(date) == weekday) & away.between(1, 7)
        else:
            hit = (F.month(date) == d.date[0]) & (F.dayofmonth(date) == d.date[1]) if d.date else days_from == d.easter
        if d.first > 1 or d.last < 9999:
            hit = hit & year.between(d.first, d.last)
        out = out | hit
    return out


def with_holidays(df: DataFrame, country: str = "DE", state: str | None = None, zone: str = "UTC", ts: str = "ts") -> DataFrame:
    """is_holiday 0/1 by the local date of ts."""
    local = F.to_date(F.from_utc_timestamp(ts, zone))
    return df.withColumn("is_holiday", F.coalesce(is_holiday(local, country, state), F.lit(False)).cast("int"))


def holiday_frame(spark: SparkSession, start: str, end: str, rule: str = "h", country: str = "DE", state: str | None = None, zone: str = "UTC") -> DataFrame:
    """(ts, is_holiday) on a grid from start to end."""
    from tidewright.operators.grid import spine

    bounds = spark.range(1).select(F.lit(start).cast("timestamp").alias("start"), F.lit(end).cast("timestamp").alias("end"))
    return with_holidays(spine(bounds, rule), country, state, zone)


# ---- the sun ---------------------------------------------------------------------------------------------------------


def sun(df: DataFrame, latitude: float, longitude: float, zone: str = "UTC", ts: str = "ts") -> DataFrame:
    """sunrise_hour and sunset_hour (local, rounded to hours), daylight_hours and is_daylight, from the NOAA approximation.

    Polar nights have no daylight, polar days 24 hours of it.
    """
    local = F.from_utc_timestamp(ts, zone)
    g = (F.dayofyear(local) - 1) * (2 * math.pi / 365)
    eq = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    decl = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    lat = math.radians(latitude)
    cos_angle = math.cos(math.radians(90.833)) / (math.cos(lat) * F.cos(decl)) - math.tan(lat) * F.tan(decl)
    half = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_angle))))
    noon = 720 - 4 * longitude - eq  # minutes in UTC
    day = F.unix_timestamp(F.date_trunc("day", local))
    offset = (F.unix_timestamp(local) - F.unix_timestamp(ts)) / 60
    hour = lambda minutes: F.round((minutes + offset) / 60).cast("int")
    out = df.withColumns({"sunrise_hour": hour(noon - 4 * half), "sunset_hour": hour(noon + 4 * half)})
    out = out.withColumn("daylight_hours", F.col("sunset_hour") - F.col("sunrise_hour"))
    at = (F.unix_timestamp(local) - day) / 3600
    return out.withColumn("is_daylight", ((F.floor(at) >= F.col("sunrise_hour")) & (F.floor(at) < F.col("sunset_hour"))).cast("int"))


# ---- the exogenous table ---------------------------------------------------------------------------------------------


@dataclass
class ExogBuilder:
    """Builds the covariates of a time range in one projection over a spine and one broadcast join.

    With periods, their basis functions replace the raw time parts. Holidays come only with a country.
    """

    periods: Sequence[Period] = ()
    country: str | None = None
    state: str | None = None

    def build(self, spark: SparkSession, start: str, end: str, rule: str = "h") -> DataFrame:
        from tidewright.operators.grid import spine

        bounds = spark.range(1).select(F.lit(start).cast("timestamp").alias("start"), F.lit(end).cast("timestamp").alias("end"))
        return self.add_to(spine(bounds, rule))

    def add_to(self, df: DataFrame) -> DataFrame:
        names = ["dayofyear", "dayofweek", "quarter", "month", "hour"]
        before = df.columns
        df = calendar_parts(df, names)
        basis = {n: c for p in self.periods for n, c in p.columns().items()}
        df = df.withColumns(basis | {"is_weekend": is_weekend()})
        extra = []
        if self.country:
            df = with_holidays(df, self.country, self.state).withColumnRenamed("is_holiday", "holidays")
            extra = ["holidays"]
        return df.select(*before, *(list(basis) or names), *extra, "is_weekend")
