"""Pieces of text that keep to one matter, by the vectors of its sentences (MX16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _mean_direction(vectors: Column) -> Column:
    """The sum of a few vectors: its direction is that of their mean."""
    first = F.transform(F.get(vectors, 0), lambda x: x.cast("double"))
    return F.aggregate(F.slice(vectors, 2, 1000), first, lambda total, v: F.zip_with(total, v, lambda a, b: a + b))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def semantic_pieces(
    sentences: DataFrame, key: str, at: str, vector: str, chars: str, least_similar: float = 0.75, window: int = 3, shortest: int = 100, longest: int = 500
) -> DataFrame:
    """``sentences`` with ``similarity``, ``piece`` and ``part``.

    A matter may change before a sentence where the mean vectors of the ``window`` sentences before it and
    of the ``window`` from it on have a cosine below ``least_similar`` and lower than beside it; it does if at least ``shortest``
    characters lie before the next such place. Pieces are numbered from 0; one of more than ``longest``
    characters falls into parts, by where its sentences begin. Windows hold a few vectors, never a document.
    Sentences of one document have different places; a missing vector changes nothing, a zero one neither.
    """
    along = Window.partitionBy(key).orderBy(at)
    before, behind = (F.collect_list(vector).over(along.rowsBetween(*b)) for b in ((-window, -1), (0, window - 1)))
    rows = sentences.withColumns({"_a": before, "_b": behind})
    rows = rows.withColumns({"_a": F.when(F.size("_a") > 0, _mean_direction(F.col("_a"))), "_b": F.when(F.size("_b") > 0, _mean_direction(F.col("_b")))})
    cosine = F.try_divide(_dot(F.col("_a"), F.col("_b")), F.sqrt(_dot(F.col("_a"), F.col("_a")) * _dot(F.col("_b"), F.col("_b"))))
    rows = rows.withColumn("similarity", cosine).drop("_a", "_b")
    beside = [F.coalesce(f("similarity").over(along), F.lit(2.0)) for f in (F.lag, F.lead)]
    changes = F.coalesce((F.col("similarity") < least_similar) & (F.col("similarity") <= beside[0]) & (F.col("similarity") < beside[1]), F.lit(False)).cast("int")
    rows = rows.withColumn("_changes", changes)
    changes = F.col("_changes")
    rows = rows.withColumn("_matter", F.sum(changes).over(along))
    long_enough = F.sum(chars).over(Window.partitionBy(key, "_matter")) >= shortest
    opens = (changes == 1) & long_enough
    rows = rows.withColumn("_opens", opens.cast("long"))
    rows = rows.withColumn("piece", F.sum("_opens").over(along))
    earlier = F.sum(chars).over(Window.partitionBy(key, "piece").orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("part", F.floor(F.coalesce(earlier, F.lit(0)) / longest)).drop("_changes", "_matter", "_opens")
