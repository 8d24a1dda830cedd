"""Windows over sessions, lines and anchors (WIN8-WIN21, AGG45, SRC14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_n(df: DataFrame, key: str, order: Column, n: int) -> DataFrame:
    """The last n rows of each key (the engine keeps n rows a task before the shuffle)."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order.desc())))
    return ranked.where(F.col("_r") <= n).drop("_r")


def previous_of_role(df: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """previous: the last text of ``role`` before each row."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("previous", F.last(F.when(F.col("role") == role, F.col(text)), ignorenulls=True).over(w))


def batches(df: DataFrame, key: list[str], order: list[Column], size: int) -> DataFrame:
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1) / size).cast("long"))


def gaps_and_islands(lines: DataFrame, key: str, order: str, is_start: Column, text: str) -> DataFrame:
    """Records of several lines: a start line opens one, the following lines belong to it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("record", F.sum(is_start.cast("int")).over(w)).where("record > 0")
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return marked.groupBy(key, "record").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("entry"))


def fixed_windows(spans: DataFrame, key: str, last: str, size: int, overlap: int) -> DataFrame:
    """start, end of overlapping windows over the lines 1 to ``last`` of each key; the last one ends at the last line."""
    starts = F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.col(last) - F.lit(overlap)), F.lit(size - overlap).cast("long")))
    return spans.select(key, starts.alias("start"), last).select(key, "start", F.least(F.col("start") + size - 1, last).alias("end"))


def nearest_filled(lines: DataFrame, key: str, at: str, text: str, reach: int) -> DataFrame:
    """near: the nearest non-empty line within ``reach`` lines; the earlier one wins ties."""
    filled = F.when(F.trim(text) != "", F.col(at))
    w = Window.partitionBy(key).orderBy(at)
    before = F.last(filled, ignorenulls=True).over(w.rowsBetween(-reach, 0))
    after = F.first(filled, ignorenulls=True).over(w.rowsBetween(0, reach))
    near = F.when(before.isNull(), after).when(after.isNull(), before).when(F.col(at) - before <= after - F.col(at), before).otherwise(after)
    return lines.withColumn("near", near)


def one_per_line(candidates: DataFrame, key: str, at: str) -> DataFrame:
    """The candidate of highest priority on each line, with all reasons in priority order."""
    rank = F.struct(F.col("priority"), F.col("text"))
    reasons = F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("o"), F.col("reason").alias("r"))))
    return candidates.groupBy(key, at).agg(
        F.max("priority").alias("priority"), F.max_by("text", rank).alias("text"), F.array_join(F.array_distinct(F.transform(reasons, lambda x: x["r"])), "; ").alias("reasons")
    )


def gaps(records: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Uncovered line ranges: ``records`` (key, start, end) against ``spans`` (key, first, last)."""
    w = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = records.join(spans, key).withColumn("cursor", F.greatest(F.col("first"), F.coalesce(F.max("end").over(w) + 1, F.col("first"))))
    inner = reach.where("start > cursor").select(key, F.col("cursor").alias("gap_start"), (F.col("start") - 1).alias("gap_end"))
    ends = records.groupBy(key).agg(F.max("end").alias("covered"))
    tail = spans.join(ends, key, "left").withColumn("gap_start", F.greatest(F.col("first"), F.coalesce(F.col("covered") + 1, F.col("first"))))
    return inner.unionByName(tail.where("gap_start <= last").select(key, "gap_start", F.col("last").alias("gap_end")))
