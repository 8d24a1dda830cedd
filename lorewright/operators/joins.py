"""Lookups as joins (JN1-JN8, JN12-JN20, JN22).

Left sides may be large everywhere. Range joins are cut into buckets so that they become equi-joins;
the planner chooses broadcasts from sizes it knows, none is forced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left outer equi-join."""
    return left.join(right, keys, "left")


def first_per_key(df: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """One row for each key: that with the least ``order`` (map-side combined, no window)."""
    rank = F.struct(*order)
    return df.groupBy(key).agg(*[F.min_by(c, rank).alias(c) for c in columns])


def top_keys(df: DataFrame, key: str, ts: str, n: int) -> DataFrame:
    """The n latest keys with their last time and row count."""
    return df.groupBy(key).agg(F.max(ts).alias("last_time"), F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("last_time"), key).limit(n)


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Resume: what has no finished row yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def points_in_ranges(points: DataFrame, ranges: DataFrame, key: list[str], at: str, start: str, end: str, bucket: int = 64) -> DataFrame:
    """Interval join ``start <= at <= end`` within ``key``.

    A range is listed under each bucket that it touches, a point under its own: an equi-join that
    splits a long document, where a plain range join would compare all of its points and ranges.
    """
    listed = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    placed = points.withColumn("_bucket", F.floor(F.col(at) / bucket))
    return placed.join(listed, [*key, "_bucket"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_bucket")


def asof(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The latest ``value`` of ``right`` at or before each row of ``left``, within ``key``.

    Both sides are put in one sequence and filled forward: one shuffle by key, no pairs.
    """
    both = left.select(*[F.col(c) for c in left.columns], F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(1).alias("_side")).unionByName(
        right.select(*[F.col(c) if c in (key, ts) else F.lit(None).cast(t).alias(c) for c, t in left.dtypes], F.col(value).alias("_v"), F.lit(0).alias("_side"))
    )
    w = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


def nearest_lower(df: DataFrame, key: str, at: str, level: str, max_level: int) -> DataFrame:
    """parent: the position of the nearest earlier row with a lower level (null at the top).

    One running maximum for each level, of which there are few.
    """
    w = Window.partitionBy(key).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)  # positions may repeat
    last = [F.max(F.when(F.col(level) == i, F.col(at))).over(w) for i in range(1, max_level)]
    lower = [F.when(F.col(level) > i + 1, last[i]) for i in range(max_level - 1)]
    return df.withColumn("parent", F.greatest(*lower) if len(lower) > 1 else lower[0])


def ancestors(df: DataFrame, key: str, at: str, title: str, max_level: int) -> DataFrame:
    """path: titles from the top to each row, by at most ``max_level`` joins to the parent."""
    out = df.withColumn("_up", F.col("parent")).withColumn("path", F.array(title))
    names = df.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.col(title).alias("_title"), F.col("parent").alias("_next"))
    for _ in range(max_level - 1):
        step = out.join(names, (F.col(key) == F.col("_key")) & (F.col("_up") == F.col("_at")), "left")
        longer = F.when(F.col("_title").isNotNull(), F.array_prepend("path", F.col("_title"))).otherwise(F.col("path"))
        out = step.select(*df.columns, longer.alias("path"), F.col("_next").alias("_up"))
    return out.drop("_up")


def next_boundary(df: DataFrame, key: str, at: str) -> DataFrame:
    """until: the line before the next anchor of the same key, null after the last one."""
    return df.withColumn("until", F.lead(at).over(Window.partitionBy(key).orderBy(at)) - 1)


def neighbours(edges: DataFrame, src: str, dst: str, start: DataFrame) -> DataFrame:
    """(start, node): nodes within two steps of each start node, itself left out; edges have no direction."""
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).union(edges.select(F.col(dst).alias("a"), F.col(src).alias("b"))).distinct()
    one = start.select(F.col("start")).join(both, F.col("start") == F.col("a")).select("start", F.col("b").alias("node"))
    two = one.join(both, F.col("node") == F.col("a")).select("start", F.col("b").alias("node"))
    return one.union(two).where("start <> node").distinct()
