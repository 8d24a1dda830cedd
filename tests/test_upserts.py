"""Keyed tables that streams write: replays, late rows and deletes."""

from lorewright.scratch import Scratch
from lorewright.streaming.upserts import KeyedTable, run_into

SCHEMA = "id long, version long, status string, gone boolean"


def table(spark, name):
    return KeyedTable(spark, Scratch(spark, name).path("table"), "id long, version long, status string", "id", "version")


def test_a_replayed_batch_changes_nothing(spark):
    t = table(spark, "upserts")
    assert t.rows().count() == 0 and t.batches() == []
    first = spark.createDataFrame([(1, 1, "a", False), (2, 1, "b", False), (3, 1, "c", False), (1, 2, "aa", False)], SCHEMA)
    assert t.apply(first, 0, "gone") and not t.apply(first, 0, "gone")
    second = spark.createDataFrame([(2, 2, None, True), (3, 0, "late", False), (4, 1, "d", False)], SCHEMA)
    assert t.apply(second, 1, "gone")
    want = [(1, 2, "aa"), (3, 1, "c"), (4, 1, "d")]
    assert sorted(map(tuple, t.rows().collect())) == want
    assert not t.apply(second, 1, "gone") and not t.apply(first, 0, "gone")
    assert sorted(map(tuple, t.rows().collect())) == want and t.batches() == [0, 1]
    assert t.apply(spark.createDataFrame([(2, 1, "older than its delete", False)], SCHEMA), 2, "gone")
    assert sorted(map(tuple, t.rows().collect())) == want
    assert t.apply(spark.createDataFrame([(2, 3, "again", False)], SCHEMA), 3, "gone")
    assert sorted(r.id for r in t.rows().collect()) == [1, 2, 3, 4]


def test_a_snapshot_without_its_mark_is_written_again(spark):
    t = table(spark, "upserts")
    batch = spark.createDataFrame([(1, 1, "a", False)], SCHEMA)
    batch.withColumnRenamed("gone", "_gone").limit(0).write.parquet(f"{t.path}/snapshot-0")  # a job that died
    assert t.rows().count() == 0
    assert t.apply(batch, 0, "gone") and [r.id for r in t.rows().collect()] == [1]


def test_stream_equals_batch_in_any_order(spark):
    rows = [(i % 7, i, f"s{i}", i % 5 == 0) for i in range(60)]
    latest = {k: max((r for r in rows if r[0] == k), key=lambda r: r[1]) for k in range(7)}
    want = sorted(r[:3] for r in latest.values() if not r[3])
    for order in (rows, rows[::-1]):
        scratch, t = Scratch(spark, "upserts"), table(spark, "upserts")
        for i in range(0, 60, 20):
            spark.createDataFrame(order[i : i + 20], SCHEMA).coalesce(1).write.mode("append").json(scratch.path("in"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(scratch.path("in"))
        run_into(stream, t, "gone", scratch.path("checkpoint"), replay=True)
        assert sorted(map(tuple, t.rows().collect())) == want
        run_into(stream, t, "gone", scratch.path("checkpoint"))
        assert sorted(map(tuple, t.rows().collect())) == want
