"""Upsert, delete and copy as rewrites of DataFrames (SNK5-SNK15, SUP6-SUP11, SET5, STR13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_if_absent(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(delta.join(base.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], partial: bool = False) -> DataFrame:
    """``delta`` replaces rows of ``base`` by key and adds the others; with ``partial``, null fields keep the old value."""
    if not partial:
        return base.join(delta.select(*keys), keys, "left_anti").unionByName(delta, allowMissingColumns=True)
    new = delta.select(*keys, *[F.col(c).alias(f"_{c}") for c in delta.columns if c not in keys])
    merged = base.join(new, keys, "full")
    others = [c for c in base.columns if c not in keys]
    return merged.select(*keys, *[F.coalesce(f"_{c}", c).alias(c) if c in delta.columns else F.col(c) for c in others])


def delete(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys), keys, "left_anti")


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Delete a key from every table."""
    return {name: delete(df, gone, [key]) for name, df in tables.items()}


def copy_missing(source: DataFrame, target: DataFrame, keys: list[str], batch: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Rows to append to ``target``, and one row of totals; rows that exist are skipped, never changed."""
    marked = source.join(target.select(*keys).distinct().withColumn("_there", F.lit(True)), keys, "left")
    absent = F.col("_there").isNull()
    stats = marked.agg(F.count(F.lit(1)).alias("total"), F.count_if(absent).alias("inserted"))
    stats = stats.select("total", "inserted", (F.col("total") - F.col("inserted")).alias("skipped"), F.ceil(F.col("total") / batch).cast("long").alias("batches"))
    return marked.where(absent).select(*source.columns), stats


def copy_all(tables: dict[str, tuple[DataFrame, DataFrame]], keys: list[str], exclude: set[str] = frozenset()) -> DataFrame:
    """Totals of copying several (source, target) tables, without those excluded."""
    stats = None
    for name, (source, target) in tables.items():
        if name not in exclude:
            row = copy_missing(source, target, keys)[1]
            stats = row if stats is None else stats.union(row)
    sums = [F.sum(c).alias(c) for c in ("total", "inserted", "skipped")]
    return stats.agg(F.count(F.lit(1)).cast("int").alias("n_tables"), *sums)


def vector_rows(rows: DataFrame, key: str, text: str, most: int = 500) -> DataFrame:
    """SNK12: what is put beside a vector: its id, and its text up to ``most`` characters."""
    return rows.select(key, F.substring(text, 1, most).alias("text"), F.concat(F.lit("q"), F.col(key).cast("string")).alias("vector_id"))


def push_bounded(array: Column, new: Column, limit: int) -> Column:
    """``new`` appended to ``array``, and only the last ``limit`` elements kept."""
    joined = F.concat(F.coalesce(array, F.slice(new, 1, 0)), new)
    return F.when(F.size(joined) <= limit, joined).otherwise(F.slice(joined, -limit, limit))


def needs_update(synced_at: Column, update_time: Column, as_written: bool = False) -> Column:
    """Re-index decision: never synced, no update time, or changed since. As written, it was always true."""
    if as_written:
        return F.lit(True)
    return synced_at.isNull() | update_time.isNull() | (update_time == "") | (update_time > synced_at)


def fan_out(rows: DataFrame, owners: str, words: str) -> DataFrame:
    """One row for each owner and word."""
    return rows.withColumn("owner", F.explode(owners)).withColumn("word", F.explode(words)).drop(owners, words)
