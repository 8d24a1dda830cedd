"""Word and shingle columns built from DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six ASCII white-space characters, and the two ASCII alphabets.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character untouched."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space, in order; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def window_hashes(tokens: Column, size: int) -> Column:
    """64-bit hash of every window of ``size`` consecutive words; empty when there are fewer words.

    ``tokens`` has to be a materialised column: the lambda reads it once for each word.
    """
    starts = F.when(
        F.size(tokens) >= size, F.sequence(F.lit(0), F.size(tokens) - size)
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(size)]))
