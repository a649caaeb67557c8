"""Time grids: spines, resampling, completeness, filling and interpolation.

Every operator takes and gives (series_id, ts, y). Windows are partitioned by series; for a single series too long for
one task, forward_fill() works in blocks of time and carries values from block to block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import over_series, seconds_of

#: name -> (aggregate, value of an empty bin)
AGGREGATES = {
    "mean": (F.avg, None),
    "sum": (F.sum, 0.0),
    "min": (F.min, None),
    "max": (F.max, None),
    "median": (lambda c: F.percentile(c, F.lit(0.5)), None),
    "std": (F.stddev_samp, None),
    "count": (lambda c: F.count(c).cast("double"), 0.0),
    "first": (None, None),
    "last": (None, None),
}


def _us(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def spine(bounds: DataFrame, rule: str, start: str = "start", end: str = "end") -> DataFrame:
    """bounds with a row for each step from start to end, both included, as ts."""
    step = F.make_dt_interval(secs=F.lit(seconds_of(rule)))
    return bounds.withColumn("ts", F.explode(F.sequence(start, end, step))).drop(start, end)


def grid_of(series: DataFrame, rule: str, shared: bool = True) -> DataFrame:
    """(series_id, ts): a row for each series and step. shared: all series have the steps of the whole table, as in a wide table."""
    ids = series.groupBy("series_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    if shared:
        whole = series.agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
        return spine(ids.select("series_id").crossJoin(F.broadcast(whole)), rule)  # one row with the table's range
    return spine(ids, rule)


def bin_start(ts: str | Column, rule: str, closed: str = "left", origin: Column | None = None) -> Column:
    """The start of the bin of ts. Bins count from the origin, the epoch by default; closed='right' puts an edge into the bin before it."""
    step = seconds_of(rule) * 1_000_000
    base = F.unix_micros(origin) if origin is not None else F.lit(0)
    at = _us(ts) - base - (1 if closed == "right" else 0)
    return F.timestamp_micros(F.floor(at / step).cast("long") * step + base)


def resample(series: DataFrame, rule: str = "h", closed: str = "left", label: str = "left", by: str | Callable[[Column], Column] = "mean", shared: bool = True) -> DataFrame:
    """Aggregates to a regular grid; empty bins are kept, with 0 for sums and counts and NULL for the rest.

    by: a name, or a function from a column to an aggregate of it.

    Bins count from the midnight of the table's first day, as is usual for rules of several hours.
    """
    if not callable(by) and by not in AGGREGATES:
        raise ValueError(f"by must be one of {sorted(AGGREGATES)}, or a function")
    if closed not in ("left", "right") or label not in ("left", "right"):
        raise ValueError("closed and label must be 'left' or 'right'")
    step = seconds_of(rule)
    if 86400 % step:
        origin = F.col("_origin")
        first = series.agg(F.date_trunc("day", F.min("ts")).alias("_origin"))
        binned = series.crossJoin(F.broadcast(first))  # one row
    else:
        origin, binned = None, series
    binned = binned.withColumn("_bin", bin_start("ts", rule, closed, origin))
    agg, empty = (lambda y: by(F.col(y)), None) if callable(by) else AGGREGATES[by]
    value = F.min_by("y", F.when(F.col("y").isNotNull(), F.col("ts"))) if by == "first" else F.max_by("y", F.when(F.col("y").isNotNull(), F.col("ts"))) if by == "last" else agg("y")
    bins = binned.groupBy("series_id", F.col("_bin").alias("ts")).agg(value.alias("y"))
    ends = None
    if shared:  # the first and last time of the table, from the source alone
        ends = series.agg(F.min("ts").alias("_a"), F.max("ts").alias("_z"))
        if 86400 % step:
            ends = ends.withColumn("_origin", F.date_trunc("day", "_a"))
        ends = ends.select(*(bin_start(c, rule, closed, origin).alias(c) for c in ("_a", "_z")))
    out = _spread(bins, step, ends)
    if empty is not None:
        out = out.withColumn("y", F.coalesce("y", F.lit(empty)))
    if label == "right":
        out = out.withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.lit(step)))
    return out.select("series_id", "ts", "y")


def _spread(bins: DataFrame, step: int, ends: DataFrame | None) -> DataFrame:
    """bins with a row of NULL for each step between a bin and the next; with ends, from _a to _z for every series.

    Each row stands for the steps up to the next one, so no spine is joined and the table is read once. Rows without a time are in no
    bin; with ends, a series of nothing else has a row of NULL for every step.
    """
    one = F.make_dt_interval(secs=F.lit(step))
    start, end = F.col("ts"), F.coalesce(F.lead("ts").over(over_series()) - one, F.col("ts"))
    if ends is not None:
        bins = bins.crossJoin(F.broadcast(ends))  # one row
        after = F.lead("ts").over(over_series())  # a missing time comes first
        start = F.when(F.lag("ts").over(over_series()).isNull(), F.col("_a")).otherwise(start)
        end = F.when(F.col("ts").isNotNull() | after.isNull(), F.coalesce(after - one, F.col("_z")))
    steps = bins.withColumns({"_from": start, "_to": end})
    out = steps.withColumn("_t", F.explode(F.sequence("_from", "_to", one)))
    return out.select("series_id", F.col("_t").alias("ts"), F.when(F.col("_t") == F.col("ts"), F.col("y")).alias("y"))


def as_frequency(series: DataFrame, rule: str = "h") -> DataFrame:
    """Puts rows on a regular grid without aggregating; steps without a row get NULL."""
    return grid_of(series, rule, shared=False).join(series, ["series_id", "ts"], "left").select("series_id", "ts", "y")


def gaps(series: DataFrame, rule: str = "h") -> DataFrame:
    """(series_id, ts) of the steps between a series' ends that have no row. One window, no join."""
    one = F.make_dt_interval(secs=F.lit(seconds_of(rule)))
    rows = series.select("series_id", "ts").withColumn("_next", F.lead("ts").over(over_series()))
    holed = rows.filter(F.col("_next") > F.col("ts") + one)
    return holed.select("series_id", F.explode(F.sequence(F.col("ts") + one, F.col("_next") - one, one)).alias("ts"))


def check_complete(series: DataFrame, rule: str = "h") -> DataFrame:
    """series itself; raises ValueError if a step is missing or a time repeats. One aggregation, no join."""
    step = seconds_of(rule)
    stats = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ts").alias("d"), ((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / step + 1).alias("want"))
    if stats.isEmpty():
        raise ValueError("the table is empty")
    bad = stats.filter((F.col("n") != F.col("d")) | (F.col("d") != F.col("want"))).take(5)
    if bad:
        raise ValueError(f"series with missing or repeated times: {[r.series_id for r in bad]}")
    return series


def forward_fill(series: DataFrame, block: str | None = None, value: str = "y") -> DataFrame:
    """Each NULL takes the last value before it.

    block: a unit of date_trunc. Then blocks of a series are filled apart, and one small table of each block's last value is
    filled over blocks, so that no task holds a whole series.
    """
    if block is None:
        return series.withColumn(value, F.last(value, ignorenulls=True).over(over_series().rowsBetween(Window.unboundedPreceding, 0)))
    cut = series.withColumn("_block", F.date_trunc(block, "ts"))
    ends = cut.groupBy("series_id", "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("ts"))).alias("_end"))
    w = Window.partitionBy("series_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("series_id", "_block", F.last("_end", ignorenulls=True).over(w).alias("_carry"))
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy("series_id", "_block").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn(value, inside).join(carry, ["series_id", "_block"]).withColumn(value, F.coalesce(value, "_carry")).drop("_block", "_carry")


def backward_fill(series: DataFrame, value: str = "y") -> DataFrame:
    return series.withColumn(value, F.first(value, ignorenulls=True).over(over_series().rowsBetween(0, Window.unboundedFollowing)))


def backward_fill_columns(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Each NULL of the columns takes the next value in time order; the table is one series unless by names keys."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("ts").rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.first(c, ignorenulls=True).over(w) for c in columns}) if columns else df


def fill(series: DataFrame, value: str = "y") -> DataFrame:
    """Forward, then backward. One sort serves both windows."""
    w = over_series()
    forward = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return series.withColumn(value, F.coalesce(forward, first))


def interpolate(series: DataFrame) -> DataFrame:
    """Linear by position between known values, then forward; leading NULLs stay."""
    w = over_series()
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    pos = F.row_number().over(w)
    known = F.when(F.col("y").isNotNull(), F.struct(F.col("_p").alias("p"), F.col("y").alias("y")))
    out = series.withColumn("_p", pos)
    out = out.withColumn("_a", F.last(known, ignorenulls=True).over(before)).withColumn("_b", F.first(known, ignorenulls=True).over(after))
    a, b = F.col("_a"), F.col("_b")
    line = a["y"] + (b["y"] - a["y"]) * (F.col("_p") - a["p"]) / (b["p"] - a["p"])
    return out.withColumn("y", F.when(b.isNull() | (b["p"] == a["p"]), a["y"]).otherwise(line)).drop("_p", "_a", "_b")


def keep_one(rows: DataFrame, keys: list[str], order: list[Column], last: bool = True) -> DataFrame:
    """One row for each key: the last, or first, in an explicit order."""
    order = [c.desc() if last else c.asc() for c in order]
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def future(series: DataFrame, steps: int, rule: str = "h") -> DataFrame:
    """(series_id, ts, step): the next steps after each series."""
    last = series.groupBy("series_id").agg(F.max("ts").alias("_last"))
    out = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return out.select("series_id", (F.col("_last") + F.make_dt_interval(secs=F.col("step") * seconds_of(rule))).alias("ts"), F.col("step").cast("long"))


def tile(series: DataFrame, block: int, steps: int, rule: str = "h") -> DataFrame:
    """The next steps after each series, as repeats of its last `block` values."""
    w = Window.partitionBy("series_id").orderBy(F.col("ts").desc())
    last = series.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= block).select("series_id", "y", (block - F.col("_back")).alias("_at"))
    ahead = future(series, steps, rule).withColumn("_at", F.pmod(F.col("step") - 1, F.lit(block)))
    return ahead.join(last, ["series_id", "_at"], "left").select("series_id", "ts", "step", "y")


def steps_until(series: DataFrame, date: str, rule: str = "h", method: str = "prediction") -> DataFrame:
    """(series_id, steps): `prediction`: steps from the end of a series up to a date; `validation`: its rows up to and including the date."""
    at = F.lit(date).cast("timestamp")
    if method == "validation":
        return series.groupBy("series_id").agg(F.count_if(F.col("ts") <= at).alias("steps"))
    if method != "prediction":
        raise ValueError("method must be 'prediction' or 'validation'")
    steps = ((F.unix_timestamp(at) - F.unix_timestamp(F.max("ts"))) / seconds_of(rule)).cast("long")
    return series.groupBy("series_id").agg(F.when(steps > 0, steps).otherwise(F.raise_error(F.lit("the date is not after the series"))).alias("steps"))


def covariate_range(series: DataFrame, horizon: int, rule: str = "h") -> DataFrame:
    """One row: start, end, cov_start, cov_end, as text with minutes; covariates reach horizon steps beyond the data."""
    form = "yyyy-MM-dd'T'HH:mm"
    a, b = F.min("ts"), F.max("ts")
    far = b + F.make_dt_interval(secs=F.lit(horizon * seconds_of(rule)))
    return series.agg(F.date_format(a, form).alias("start"), F.date_format(b, form).alias("end"), F.date_format(a, form).alias("cov_start"), F.date_format(far, form).alias("cov_end"))
