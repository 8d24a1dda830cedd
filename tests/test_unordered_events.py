"""A stream's windows over a table of several files, each with events of the whole time."""

import datetime as dt

import duckdb

from lorewright.plans.registry import ORACLES, QUERIES
from verify import normal


def test_windows_of_files_in_any_order(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=7 * (i * 37 % 600)), "ab"[i % 2], 1.0) for i in range(600)] + [(999, None, "a", 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    spark.conf.set("spark.sql.files.openCostInBytes", "200m")  # each file is a partition, and becomes a file of the stream
    try:
        got = QUERIES["str_windows_stream"](spark, str(tmp_path)).toPandas()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = db.execute(ORACLES["str_windows_stream"]).df()
    assert len(want) > 100 and normal(got) == normal(want)


def test_sketches_are_kept_by_type_only(spark, tmp_path):
    rows = [(i % 3, "ab"[i % 2] if i % 5 else None) for i in range(60)] + [(None, "c")]
    spark.createDataFrame(rows, "user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    df = QUERIES["agg_approximate_distinct"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect()), key=repr) == sorted([("a", True, True), ("b", True, True), ("c", False, True), (None, True, True)], key=repr)
    sketches = [x for x in df._jdf.queryExecution().sparkPlan().toString().split("\n") if "approx_count_distinct" in x]
    assert sketches and not any("user_id" in x.split("keys=[")[1].split("]")[0] for x in sketches)
