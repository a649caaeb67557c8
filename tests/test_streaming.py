import datetime as dt
import os

from pyspark.sql import functions as F

from tidewright.streaming import resample as R


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").outputMode(mode).queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def source(spark, series, tmp_path, values):
    s = series(values)
    s.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))


def test_windows(spark, series, tmp_path):
    st = source(spark, series, tmp_path, range(10))
    tumbling = run(spark, R.resample_stream(st, "2 hours", "0 minutes"), "tumbling")
    assert [r.y for r in tumbling.orderBy("ts").collect()] == [0.5, 2.5, 4.5, 6.5]
    assert run(spark, R.rolling_mean_stream(st, "4 hours", "1 hour", "0 minutes"), "sliding").filter("roll_mean = 1.5").count() == 1
    assert run(spark, R.sessions_stream(st, "2 hours"), "sessions").count() == 0  # still open


def test_state(spark, series, tmp_path):
    out = run(spark, R.naive_stream(source(spark, series, tmp_path, range(6)), 3), "naive")
    assert [None if r.pred is None or r.pred != r.pred else r.pred for r in out.orderBy("ts").collect()] == [None, None, None, 0, 1, 2]


def test_merge_late(spark, tmp_path):
    write = R.merge_late(spark, str(tmp_path / "t"), ["k"])
    df = lambda v: spark.createDataFrame([(1, dt.datetime(2024, 1, 1), v)], "k int, ts timestamp, v int")
    write(df(1), 0)
    write(df(2), 1)
    write(df(2), 1)  # a repeated batch
    rows = R.current(spark, str(tmp_path / "t"), ["k"]).collect()
    assert len(rows) == 1 and rows[0].v == 2


def test_merged_batches_are_compacted(spark, series, tmp_path):
    target = str(tmp_path / "m")
    write = R.merge_late(spark, target, ["series_id", "ts"])
    write(series([1.0, 2.0]), 0)
    write(series([5.0]), 1)
    values = lambda: sorted(r.y for r in R.current(spark, target, ["series_id", "ts"]).collect())
    assert values() == [2.0, 5.0]
    R.compact(spark, target, ["series_id", "ts"])
    assert values() == [2.0, 5.0] and [n for n in os.listdir(target) if n[0] == "b"] == ["base=000000000001"]
    write(series([9.0]), 1)  # a batch that is part of the base comes again
    assert values() == [2.0, 5.0]
    write(series([7.0, 8.0, 9.0]), 2)
    R.compact(spark, target, ["series_id", "ts"])
    R.compact(spark, target, ["series_id", "ts"])
    assert values() == [7.0, 8.0, 9.0]


def test_rows_out_of_order_wait_for_the_watermark(spark, series, tmp_path):
    """Three batches in the wrong order give what one in order gives, as far as the watermark has come."""
    h = series([float(i) for i in range(60)])
    for k, (a, b) in enumerate([(10, 20), (0, 10), (20, 60)]):
        part = h.filter((F.col("y") >= a) & (F.col("y") < b)).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
        for f in sorted((tmp_path / "in").glob("part-*.parquet")):
            if "seen" not in f.name:
                f.rename(f.with_name(f"seen-{k}.parquet"))
                os.utime(tmp_path / "in" / f"seen-{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(h.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = R.naive_stream(stream, 3, late="20 hours").writeStream.format("memory").queryName("ordered").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {int(r.y): r.pred for r in spark.table("ordered").collect()}
    assert len(got) >= 35 and set(got) == set(range(len(got)))
    assert all((p is None or p != p) if y < 3 else p == y - 3 for y, p in got.items())
