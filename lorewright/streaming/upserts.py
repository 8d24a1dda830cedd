"""Streams into keyed tables: upserts and deletes that a replayed batch does not change (SNK6, SNK11, STR13).

A table is a folder of snapshots, each written whole before it is named in a folder of marks by the batch
that it holds. A batch that is marked already is skipped, so one that is delivered again after a failure
changes nothing; one whose snapshot was not marked is written again. What a row says about its key counts
only if its version is later than what the table has, so late batches do no harm, and deletes stay as
rows without values until ``compacted`` drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """The latest row of every ``key`` by ``version``, below ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, version: str):
        self.spark, self.path, self.key, self.version = spark, path.rstrip("/"), key, version
        self.schema = f"{schema}, _gone boolean"
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def batches(self) -> list[int]:
        """The batches that the table holds, in order."""
        marks = self._folder("marks")
        return sorted(int(x.getPath().getName()) for x in self.fs.listStatus(marks)) if self.fs.exists(marks) else []

    def _state(self, done: list[int]) -> DataFrame:
        if not done:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/snapshot-{done[-1]}")

    def rows(self) -> DataFrame:
        """What the table holds now."""
        return self._state(self.batches()).where(~F.col("_gone")).drop("_gone")

    def apply(self, batch: DataFrame, number: int, gone: str) -> bool:
        """Merge a batch, deletes being the rows with ``gone``; False if the table has it already."""
        done = self.batches()
        if done and number <= done[-1]:
            return False
        old = self._state(done)
        new = batch.withColumnRenamed(gone, "_gone").select(*old.columns)
        others = [c for c in old.columns if c != self.key]
        latest = old.unionByName(new).groupBy(self.key).agg(F.max_by(F.struct(*others), F.struct(F.col(self.version), ~F.col("_gone"))).alias("r"))
        latest.select(self.key, "r.*").select(*old.columns).write.mode("overwrite").parquet(f"{self.path}/snapshot-{number}")
        self.fs.mkdirs(self._folder(f"marks/{number}"))
        for before in done[:-1]:  # readers may still be at the last one
            self.fs.delete(self._folder(f"snapshot-{before}"), True)
        return True


def run_into(stream: DataFrame, target: KeyedTable, gone: str, checkpoint: str, replay: bool = False) -> None:
    """All that is there now, batch by batch, into a keyed table; with ``replay`` every batch is delivered twice."""

    def merge(batch: DataFrame, number: int) -> None:
        for _ in range(2 if replay else 1):
            target.apply(batch, number, gone)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
