"""State machines by themselves, and stream against batch."""

import random
import re

from pyspark.sql import functions as F

from lorewright.streaming import streams as S
from lorewright.streaming.bucket import TokenBucket
from lorewright.streaming.segments import SegmentBuffer, cuts_formula, is_decimal_point, is_meant, open_at
from lorewright.streaming.think import ThinkFilter, strip


def test_think_filter_is_independent_of_cuts():
    rnd = random.Random(1)
    texts = ["a<think>x</think>b", "a<THINK k='v'>x<y</Think >b", "<thinking>plain", "1 < 2 <b>", "a<think>never closed", "end <thi", "<think\n>x</think>", "<<think>shown", "<think>a<</think>still inside</think>out"]
    for text in texts:
        whole = strip(text)
        for _ in range(20):
            f, out, at = ThinkFilter(), "", 0
            while at < len(text):
                step = rnd.randint(1, 4)
                out += f.feed(text[at : at + step])
                at += step
            assert out + f.flush() == whole
    assert [strip(t) for t in texts] == ["ab", "ab", "<thinking>plain", "1 < 2 <b>", "a", "end <thi", "", "<<think>shown", "out"]
    regex = re.compile(r"(?is)<think\b[^>]*>.*?</think\s*>")
    assert all(strip(t) == regex.sub("", t) for t in texts[:2])


def test_think_blocks_and_tag_limit():
    f = ThinkFilter()
    assert f.feed("<think>one</think>x<think>two</think>") == "x" and f.blocks == ["one", "two"]
    long = "<think " + "a" * 300 + ">shown"
    assert strip(long) == long


def test_segment_predicates():
    assert open_at("a $x") == 2 and open_at("a $x$") == -1 and open_at(r"\[ x") == 0
    assert cuts_formula("a $x+y$ b", 4) and not cuts_formula("a $x+y$ b", 2)
    assert is_decimal_point("3.14", 1) and is_decimal_point("3.", 1) and not is_decimal_point("a.", 1)
    assert is_meant("eight or more") and not is_meant("12345678") and not is_meant("short")


def run(tokens, limit=100):
    b, out = SegmentBuffer(limit), []
    for t in tokens:
        if (s := b.feed(t)) is not None:
            out.append(s)
    if (s := b.flush()) is not None:
        out.append(s)
    return out


def test_segments():
    assert run(["This is a sentence.", " And another one!", " Tail"]) == ["This is a sentence.", " And another one!", " Tail"]
    assert run(["Ok.", " This comes with it."]) == ["Ok. This comes with it."]
    assert run(["The value 3.", "14 is known, so it is."]) == ["The value 3.14 is known, so it is."]
    text = "Let $x. y$ be given and then it goes on."
    assert run([text[:8], text[8:]]) == [text]
    assert all(len(s) <= 100 for s in run(list("word " * 100)))
    assert "".join(run(list("Some words, $a+b$ more. " * 30))) == "Some words, $a+b$ more. " * 30
    assert SegmentBuffer(buffer="open $x").tick() is None and SegmentBuffer(buffer="done x").tick() == "done x"


def test_bucket():
    b = TokenBucket(2)
    assert [b.allow(t) for t in (0, 0, 0, 29, 30, 31, 1000, 1000, 1000)] == [True, True, False, False, True, False, True, True, False]


def test_rate_limit_holds_no_group(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", "b", None]), i, float(rnd.randint(0, 4000))) for i in range(600)]
    buckets, expected = {}, set()
    for key, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        expected.add((key, i, buckets.setdefault(key, TokenBucket(2)).allow(at)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = S.rate_limited_batch(spark.createDataFrame(rows, "key string, request_id long, at double").repartition(5), 2)
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
        assert {(r.key, r.request_id, r.allowed) for r in out.collect()} == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timeouts would keep an availableNow query going
    rnd = random.Random(3)
    rows = []
    for chat in range(6):
        text = "Hello there, this is text. <think>hidden. stuff</think>And $x. y$ more of it, 3.14 in all! " * rnd.randint(1, 3)
        at, i = 0, 0
        while at < len(text):
            step = rnd.randint(1, 9)
            rows.append((f"c{chat}", i, text[at : at + step]))
            at, i = at + step, i + 1
    batch = spark.createDataFrame(rows, "chat_id string, token_index long, token_text string")
    expected = sorted(map(tuple, S.segments_of_batch(batch).collect()))
    assert expected and not any("hidden" in r[2] for r in expected)
    source = str(tmp_path / "in")
    for part in range(3):
        cut = batch.where((F.col("token_index") / 30).cast("int") == part) if part < 2 else batch.where("token_index >= 60")
        cut.coalesce(1).write.mode("append").json(source)
    ends = spark.createDataFrame([(f"c{c}", 10**9, None) for c in range(6)], batch.schema)
    ends.coalesce(1).write.option("ignoreNullFields", False).mode("append").json(source)
    stream = spark.readStream.schema(batch.schema).json(source)
    q = S.segments_of_stream(stream).writeStream.format("memory").queryName("segments").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert sorted(map(tuple, spark.table("segments").collect())) == expected


def test_tail_drops_repeats(spark, tmp_path):
    rows = [(i % 5, f"2024-01-01 00:00:{i:02d}") for i in range(10)]
    df = spark.createDataFrame(rows, "chunk_id long, at string").select("chunk_id", F.col("at").cast("timestamp_ntz").alias("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "t"))
    q = S.tail(stream, "chunk_id", "at", "1 hour").writeStream.format("memory").queryName("tailed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.table("tailed").count() == 5
