"""Filters and scans (FIL, SRC20-SRC22, WIN1-WIN7)."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equal_when_given(df: DataFrame, wanted: Mapping[str, object | None]) -> DataFrame:
    """Conjunction of equalities; parameters that are None don't filter."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def in_days(df: DataFrame, ts: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Half-open range: from the start day to before the day after the end day."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(ts) < F.date_add(F.lit(end), 1).cast("timestamp_ntz"))
    return df


def in_window(df: DataFrame, ts: str, now: datetime, days: int) -> DataFrame:
    """Both ends included: from ``days`` before ``now`` to ``now``, which the caller supplies."""
    until = F.lit(now).cast("timestamp_ntz")
    return df.where(F.col(ts).between(until - F.make_dt_interval(F.lit(days)), until))


def keyword(columns: list[str], word: str, literal: bool = False) -> Column:
    """Case-insensitive search of a regular expression (or a literal) in any of the columns."""
    if literal:
        found = [F.contains(F.lower(c), F.lower(F.lit(word))) for c in columns]
    else:
        found = [F.rlike(F.col(c), F.lit(f"(?i){word}")) for c in columns]
    out = found[0]
    for more in found[1:]:
        out = out | more
    return out


def review_state(column: str, state: str) -> Column:
    """all, unreviewed (null), or the state itself."""
    return {"all": F.lit(True), "unreviewed": F.col(column).isNull()}.get(state, F.col(column) == F.lit(state))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of one page. ``order`` has to be total; earlier pages are cut off, never collected."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    """total, total_pages, has_next and has_prev of a paged listing."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    pages = F.ceil(F.col("total") / size).cast("long")
    return total.select("total", pages.alias("total_pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_prev"))


def first_filled(*arrays: Column) -> Column:
    """The first array that has an element, else an empty one."""
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays], F.array().cast("array<string>"))


def keep_unless_all_dropped(parts: Column, keep, whole: Column, sep: str) -> Column:
    """``parts`` that satisfy ``keep`` joined by ``sep``; the whole text if none does."""
    return F.coalesce(F.nullif(F.array_join(F.filter(parts, keep), sep), F.lit("")), whole)


def exists(column: str) -> Column:
    """FIL6."""
    return F.col(column).isNotNull()


def equal_when_given_column(column: str, value: object) -> Column:
    """FIL8: rows whose flag has the value; nulls have none."""
    return F.coalesce(F.col(column) == F.lit(value), F.lit(False))


def usable_concepts(items: DataFrame, name: str, key: str, allowed: DataFrame) -> DataFrame:
    """FIL9: reviewed as correct, with a name, and on the whitelist."""
    rows = items.where((F.col("review_status") == "correct") & (F.trim(F.coalesce(F.col(name), F.lit(""))) != ""))
    return rows.join(allowed.select(key).distinct(), key, "left_semi")


def log_from(column: str, kind: str, start: str) -> Column:
    """FIL13: entries that hold the kind, not before a time, by their first 19 characters."""
    return F.contains(F.col(column), F.lit(kind)) & (F.substring(column, 1, 19) >= F.lit(start))
