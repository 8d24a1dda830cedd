"""Intermediate tables in the folder that every executor shares.

Iterative jobs cut their lineage by writing Parquet below ``spark.checkpoint.dir`` and reading it
again: a lost executor costs a re-read, not a recomputation, and the planner gets true sizes for
its broadcast decisions.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only where none is set (tests, one machine)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lorewright-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_gathered: list[list[Scratch]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Tables of every ``Scratch`` made within are deleted at the end: for work whose result is written there."""
    _gathered.append([])
    try:
        yield
    finally:
        for scratch in _gathered.pop():
            scratch.drop()


class Scratch:
    """A folder of intermediate tables for one run of one operator."""

    def __init__(self, spark: SparkSession, label: str):
        if _gathered:
            _gathered[-1].append(self)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.saved: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as a scan of what was written."""
        df.write.mode("overwrite").parquet(self.path(name))
        self.saved.append(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep_only(self, *names: str) -> None:
        """Delete every table but the named ones: those that the returned plan still reads."""
        for name in self.saved:
            if name not in names:
                self.drop(name)
        self.saved = [x for x in self.saved if x in names]

    def drop(self, name: str = "") -> None:
        """Delete one table, or all; only for tables that no returned plan still reads."""
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
