from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ticketflow.streaming import tickets as streams

START = datetime(2024, 1, 1)


def rows(n, first=0):
    return [(first + i, START + timedelta(hours=6 * (first + i)), "ab"[i % 2], "a") for i in range(n)]


SCHEMA = "id long, ts timestamp, prediction string, truth string"


def test_batch_windows(spark):
    df = spark.createDataFrame(rows(9), SCHEMA)
    got = streams.drift(df, ["a", "b"], truth="truth").orderBy("window_start").collect()
    assert [r.n for r in got] == [4, 4, 1]
    assert [r.share_b for r in got] == [0.5, 0.5, 0.0]
    assert [r.error_rate for r in got] == [0.5, 0.5, 0.0]


def test_stream_drops_only_what_is_too_late(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "ck"))

    def deliver(data):
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = streams.read_stream(spark, source, schema=spark.read.parquet(source).schema)
        daily = streams.drift(stream, ["a", "b"], late="1 hour")
        streams.write_stream(daily, out, check).awaitTermination()

    deliver(rows(8))  # two days; the first closes
    deliver([(100, START + timedelta(days=1, hours=20), "a", "a")])  # out of order, still open
    deliver([(101, START, "a", "a")])  # a day that has closed: dropped
    deliver(rows(1, first=12))  # closes the second day
    got = {r.window_start: r.n for r in spark.read.parquet(out).collect()}
    assert got == {START: 4, START + timedelta(days=1): 5}
