"""Sinks (SNK1-SNK4, SNK16, SNK18)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """SNK1, SNK4: JSON lines; Spark's committer publishes whole files only."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """SNK16."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_pretty(df: DataFrame, path: str) -> None:
    """SNK2: each row as one indented JSON object in a file of its own."""
    df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def rewrite(df: DataFrame, path: str, staging: str, backup: str | None = None) -> None:
    """SNK3: a table is replaced only by a complete one: written beside it first, then read from there.

    What stood there before the first rewrite is kept at ``backup``, once.
    """
    spark = df.sparkSession
    if backup is not None:
        try:
            spark.read.parquet(path).write.mode("ignore").parquet(backup)
        except AnalysisException:
            pass  # nothing stood there yet
    df.write.mode("overwrite").parquet(staging)
    spark.read.schema(df.schema).parquet(staging).write.mode("overwrite").parquet(path)


def append_pending(df: DataFrame, done: DataFrame, keys: list[str], path: str) -> None:
    """SNK18: append what has no finished row yet."""
    df.join(done.select(*keys).distinct(), keys, "left_anti").write.mode("append").parquet(path)


def run_key(*fields: str):
    """ST10: SHA-256 of the fields as canonical JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)
