"""Streams with state and timers: any split and order of tokens, the time limit, and what state remains."""

import random
import re
import time

from lorewright.scratch import Scratch
from lorewright.streaming import stateful as X
from lorewright.streaming import streams as S
from lorewright.streaming.segments import has_formula, merged

SCHEMA = "chat_id string, token_index long, token_text string"
TEXTS = {
    "a": "A first sentence, with a comma. The value is $x + 1. 5$ and more words follow. Short. \\[ y = 2. \\] done here now. ",
    "b": "<think>hidden. text</think>Shown is only this sentence. 3.14 is no end of a sentence! And the rest has no end",
    "c": "",
    "d": "Costs $$a$$ and \\(b\\) then $c$ but $$open at the end",
}


def tokens(cut):
    rnd, rows = random.Random(cut), []
    for chat, text in TEXTS.items():
        parts = re.findall(r"\S+\s*|\s+", text) if cut == 0 else []
        while cut and text:
            n = rnd.randint(1, cut)
            parts.append(text[:n])
            text = text[n:]
        rows += [(chat, i, t) for i, t in enumerate(parts)] + [(chat, len(parts), None)]
    return rows


def streamed(spark, rows, n, seed, make):
    """Rows dealt over n batches in random order, through the stream that ``make`` builds."""
    scratch = Scratch(spark, "timed")
    rows = random.Random(seed).sample(rows, len(rows)) if seed else rows
    for i in range(n):
        spark.createDataFrame(rows[i::n] if seed else rows[len(rows) * i // n : len(rows) * (i + 1) // n], SCHEMA).coalesce(1).write.mode("append").json(scratch.path("in"))
    with X.timed_state(spark, ends=True):
        out = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(scratch.path("in")))
        S.run_to_files(out, scratch.path("out"), scratch.path("checkpoint"))
    return spark.read.schema(out.schema).parquet(scratch.path("out")), scratch.path("checkpoint")


def test_segments_of_a_stream_equal_the_batch(spark):
    rows = tokens(0)
    want = S.segments_of_batch(spark.createDataFrame([r for r in rows if r[2] is not None], SCHEMA), 60).collect()
    for n, seed in ((4, 0), (3, 7)):
        got, checkpoint = streamed(spark, rows, n, seed, lambda s: X.timed_segments(s, 60, wait="1 day"))
        done = got.collect()
        assert sorted((r.chat_id, r.seq, r.segment) for r in done) == sorted(map(tuple, want))
        assert all(r.has_formula == has_formula(r.segment) for r in done)
        assert sorted(r.chat_id for r in done if r.is_final) == ["a", "b", "d"]
    state = spark.read.format("statestore").option("stateVarName", "saved").load(checkpoint)
    assert state.count() == 0  # every chat has ended


def test_time_limit_fires_but_not_in_a_formula(spark):
    rows = [("a", 0, "half a sentence "), ("b", 0, "a formula $x + "), ("a", 2, "early"), ("c", 0, "whole sentence.")]
    scratch = Scratch(spark, "timed")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(scratch.path("in"))
    with X.timed_state(spark):
        out = X.timed_segments(spark.readStream.schema(SCHEMA).json(scratch.path("in")), 60, wait="300 milliseconds")
        query = out.writeStream.format("parquet").option("path", scratch.path("out")).option("checkpointLocation", scratch.path("ck")).trigger(processingTime="200 milliseconds").start()
    got, deadline = [], time.time() + 60
    while time.time() < deadline and not any(r.chat_id == "a" for r in got):
        time.sleep(1)
        got = spark.read.schema(out.schema).parquet(scratch.path("out")).collect() if query.lastProgress else []
    time.sleep(2)
    query.stop()
    got = spark.read.schema(out.schema).parquet(scratch.path("out")).collect()
    assert sorted((r.chat_id, r.seq, r.segment) for r in got) == [("a", 0, "half a sentence "), ("c", 0, "whole sentence.")]


def test_formulas_of_a_stream_miss_delimiters_that_batches_cut(spark):
    rows = [("d", i, c) for i, c in enumerate(TEXTS["d"])] + [("d", len(TEXTS["d"]), None)]
    whole = X.FormulaReader()
    want = [(f, k, d) for f, k, d, _ in whole.feed(TEXTS["d"])]
    assert want == [("a", "display", "$$"), ("b", "inline", "\\("), ("c", "inline", "$")] and whole.counts == {"display": 1, "inline": 2}
    got, _ = streamed(spark, rows, 3, 5, lambda s: X.streamed_formulas(s, joined=True))
    assert [(r.formula, r.kind, r.delimiter) for r in got.orderBy("n").collect()] == want
    assert [r.of_kind for r in got.orderBy("n").collect()] == [1, 1, 2]
    cut, _ = streamed(spark, rows, 3, 5, lambda s: X.streamed_formulas(s))
    less = [(r.formula, r.kind, r.delimiter) for r in cut.orderBy("n").collect()]
    assert less != want and ("b", "inline", "\\(") not in less and {k for _, k, _ in less} == {"inline"}


def test_reader_that_looks_ahead_equals_one_piece():
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choices(["$", "$$", "\\(", "\\)", "\\[", "\\]", "a", "b ", "\\"], k=rnd.randint(0, 14)))
        whole, pieces, found, rest = X.FormulaReader(), X.FormulaReader(joined=True), [], text
        want = whole.feed(text)
        while rest:
            n = rnd.randint(1, 3)
            found += pieces.feed(rest[:n])
            rest = rest[n:]
        assert found + pieces.end() == want and pieces.counts == whole.counts and pieces.shown == whole.shown


def test_marks_and_short_prefixes_join_their_neighbours():
    assert merged(["。", "One.", "!", "1.", "two three", "a.", "\n", "b.", "four", "5."]) == ["。One.!", "1.two three", "a.\nb.four", "5."]
    assert merged([]) == [] and merged(["?", "。"]) == ["?。"] and merged(["1.", "。", "x"]) == ["1.。", "x"]


def test_places_and_ends_of_tokens(spark):
    df = spark.createDataFrame([(1, 0, "a b"), (1, 1, "c"), (2, 0, None)], "c long, t long, text string")
    got = sorted(map(tuple, X.placed_tokens(df, "c", ["t"], "text", "(?<= )").collect()), key=repr)
    assert got == sorted([("1", 0, "a "), ("1", 1, "b"), ("1", 2, "c"), ("1", 3, None), ("2", 0, ""), ("2", 1, None)], key=repr)


def test_batches_do_not_grow_with_files(spark, monkeypatch):
    from lorewright.plans import token_streams as P

    seen, run = [], S.run_to_files
    monkeypatch.setattr(P.S, "run_to_files", lambda out, path, checkpoint: seen.append(checkpoint) or run(out, path, checkpoint))
    rows = tokens(0)
    want = S.segments_of_batch(spark.createDataFrame([r for r in rows if r[2] is not None], SCHEMA)).collect()
    got = P._streamed(spark, spark.createDataFrame(rows, SCHEMA).repartition(8), "batches", lambda s: X.timed_segments(s, wait="1 day")).collect()
    assert sorted((r.chat_id, r.seq, r.segment) for r in got) == sorted(map(tuple, want))
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{seen[0]}/commits")
    done = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(fs)
    assert 1 < len([x for x in done if x.getPath().getName().isdigit()]) <= 3
