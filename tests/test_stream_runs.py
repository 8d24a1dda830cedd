"""Streams run as streams: files come one after another, results against the same rows as a batch."""

import datetime as dt

from pyspark.sql import functions as F

from lorewright.scratch import Scratch
from lorewright.streaming import streams as S

START = dt.datetime(2024, 1, 1)


def in_order(spark, scratch, parts, schema):
    """A stream that reads one part a batch, in order."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(scratch.path("in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(scratch.path("in"))


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


SCHEMA = "ts timestamp, kind string, value double"


def written(spark, out, scratch):
    S.run_to_files(out, scratch.path("out"), scratch.path("checkpoint"))
    return spark.read.schema(out.schema).parquet(scratch.path("out"))


def test_sliding_windows_drop_late_rows_only(spark):
    scratch = Scratch(spark, "stream")
    parts = [[(at(1), "a", 1.0), (at(50), "a", 2.0)], [(at(200), "a", 4.0)], [(at(210), "b", 1.0)], [(at(55), "a", 8.0), (at(195), "a", 16.0)], [(at(600), "b", 0.0)]]
    stream = in_order(spark, scratch, parts, SCHEMA)
    got = written(spark, S.tumbling(stream, "ts", "kind", "value", "60 minutes", "30 minutes", "30 minutes"), scratch)
    every = spark.createDataFrame([r for p in parts for r in p if r[0] != at(55)], SCHEMA)  # behind the watermark of 200 - 30, which holds two files later
    batch = S.tumbling(every, "ts", "kind", "value", "60 minutes", "30 minutes", "30 minutes").where(F.col("end") <= F.lit(at(570)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and got.count() > 4


def test_sessions_as_a_stream(spark):
    scratch = Scratch(spark, "stream")
    parts = [[(at(m), "a", 1.0) for m in (0, 5, 9)], [(at(m), "a", 1.0) for m in (40, 48)] + [(at(12), "a", 1.0)], [(at(500), "b", 1.0)]]
    stream = in_order(spark, scratch, parts, SCHEMA)
    got = written(spark, S.sessions(stream, "ts", "kind", "10 minutes", "60 minutes"), scratch)
    batch = S.sessions(spark.createDataFrame([r for p in parts for r in p], SCHEMA), "ts", "kind", "10 minutes", "60 minutes").where("kind = 'a'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and got.count() == 2


def test_tail_gives_each_id_once(spark):
    scratch = Scratch(spark, "stream")
    schema = "ts timestamp, id long"
    parts = [[(at(1), 1), (at(2), 2), (at(2), 2)], [(at(2), 2), (at(3), 3)], [(at(4), 1), (at(5), 4)]]
    got = written(spark, S.tail(in_order(spark, scratch, parts, schema), "id", "ts", "2 hours", at(2)), scratch)
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 4]


def test_limiter_stream_equals_batch(spark):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timeouts would keep an availableNow query going
    scratch = Scratch(spark, "stream")
    schema = "key string, request_id long, at double"
    rows = [(f"k{i % 3}", i, 2.0 * i) for i in range(60)]
    stream = in_order(spark, scratch, [rows[:20], rows[20:41], rows[41:]], schema)
    try:
        got = written(spark, S.rate_limited_stream(stream, 2), scratch)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    batch = S.rate_limited_batch(spark.createDataFrame(rows, schema), 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert {r.allowed for r in batch.collect()} == {True, False}
