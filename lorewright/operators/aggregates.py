"""Grouped metrics (AGG1-AGG47)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentage(n: Column, d: Column) -> Column:
    """n / d, zero where there is nothing to divide by."""
    return F.when(F.coalesce(d, F.lit(0)) == 0, F.lit(0.0)).otherwise(n / d)


def average(x: Column) -> Column:
    """The mean without nulls, zero of nothing."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def exact_mean(name: str) -> Column:
    """The mean of a column of up to six decimals, from an exact sum: the same in whatever order rows come."""
    return F.sum(F.col(name).cast("decimal(18,6)")).cast("double") / F.count(name)


def labelled(x: Column, name: str = "unknown") -> Column:
    """Applied after grouping: null and empty stay two groups, both shown as ``name``."""
    return F.when(x.isNull() | (x == ""), F.lit(name)).otherwise(x)


def joined_in_order(text: Column, *order: Column, sep: str = "") -> Column:
    """All texts of a group in order, as one aggregate expression."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], text.alias("t"))))
    return F.array_join(F.transform(rows, lambda x: x["t"]), sep)


def share(df: DataFrame, key: str) -> DataFrame:
    """key, n, ratio: distribution of a column, the commonest first."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    # The total is one row: a join without key of one row, not of two tables.
    return counted.join(F.broadcast(total)).select(key, "n", (F.col("n") / F.col("total")).alias("ratio")).orderBy(F.desc("n"), F.asc_nulls_first(key))


def keep_newest(df: DataFrame, keys: list[str], ts: str, tiebreak: str) -> DataFrame:
    """One row for each key, nulls equal: the newest, of equal times that with the least tiebreak."""
    rank = F.struct(F.col(ts), (-F.col(tiebreak)).alias("t"))
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("row")).select(*keys, "row.*")


def stratified_sample(df: DataFrame, stratum: str, key: str, seed: str, n: int, keep_all: list) -> DataFrame:
    """All rows of the strata ``keep_all``, and of the others the n with the least seeded hash."""
    whole = F.coalesce(F.col(stratum).isin(keep_all), F.lit(False))
    w = Window.partitionBy(stratum).orderBy(F.sha2(F.concat(F.col(key).cast("string"), F.lit(seed)), 256), key)
    ranked = df.where(~whole).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")  # cut by task before the shuffle
    return df.where(whole).union(ranked)


def uniformity(length: Column) -> list[Column]:
    """Chunk quality: count, mean, population deviation, short and long shares, 1 / (1 + sd / mean)."""
    mean, sd = F.avg(length), F.stddev_pop(length)
    return [
        F.count(F.lit(1)).alias("n_chunks"),
        F.round(mean, 6).alias("avg_length"),
        F.round(sd, 6).alias("std_dev"),
        F.round(F.avg((length < 50).cast("double")), 6).alias("short_share"),
        F.round(F.avg((length > 1000).cast("double")), 6).alias("long_share"),
        F.round(F.when(mean > 0, 1 / (1 + sd / mean)).otherwise(0.0), 6).alias("uniformity"),
    ]


def violations(df: DataFrame, key: str, position: str, required: list[str], allowed: dict[str, list]) -> DataFrame:
    """One row for each broken rule: missing fields, values outside an enumeration, repeated ids."""
    found = [df.where(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").select(position, F.lit(f"missing {c}").alias("problem")) for c in required]
    found += [df.where(F.col(c).isNotNull() & ~F.col(c).isin(values)).select(position, F.lit(f"bad {c}").alias("problem")) for c, values in allowed.items()]
    first = df.groupBy(key).agg(F.min(position).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found.append(df.join(first, key).where(F.col(position) > F.col("first")).select(position, F.concat(F.lit("repeats "), F.col("first").cast("string")).alias("problem")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


#: Weight and cap of each graph fault in the quality score.
SCORE_WEIGHTS = {
    "pure_figure": (0.2, 20), "image_path": (1, 20), "step": (0.5, 10), "numeric_only": (0.5, 10), "chapter_like": (0.2, 5), "unknown_type": (0.2, 10),
    "missing_source": (0.1, 10), "missing_path": (0.1, 10), "chunk_url": (1, 10), "chunk_image_path": (1, 10), "invalid_type": (1, 15),
    "forbidden_type": (1, 20), "invalid_relation": (0.5, 10), "error_pattern": (0.5, 20),
}


def quality_score(counts: dict[str, Column]) -> Column:
    """100 less capped penalties, never below 0, with two decimals."""
    lost = F.lit(0.0)
    for name, (weight, cap) in SCORE_WEIGHTS.items():
        if name in counts:
            lost = lost + F.least(counts[name] * F.lit(float(weight)), F.lit(float(cap)))
    return F.bround(F.greatest(F.lit(0.0), F.lit(100.0) - lost), 2)


def score_level(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 80, "good").when(score >= 70, "usable").when(score >= 60, "noisy").otherwise("poor")


def weighted_grade(parts: list[tuple[Column, float]]) -> tuple[Column, Column]:
    """Weighted score and its letter."""
    score = sum((c * F.lit(w) for c, w in parts), F.lit(0.0))
    letter = F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
    return score, letter


def presence(rows: DataFrame, checks: dict[str, Column], total: str) -> DataFrame:
    """AGG18: how many rows there are, how many pass each check, and the sum of a column."""
    return rows.agg(F.count(F.lit(1)).alias("n_chunks"), *[F.count_if(c).alias(n) for n, c in checks.items()], F.sum(total).alias(total))


def nested_sizes(chapters: str, sections: str, items: str) -> tuple[Column, Column, Column]:
    """AGG19: chapters, sections and items of an array of structs of arrays of structs."""
    inner = F.flatten(F.transform(chapters, lambda c: c[sections]))
    return F.size(chapters), F.size(inner), F.aggregate(inner, F.lit(0), lambda n, s: n + F.size(s[items]))


def advice(counts: DataFrame, rules: list[tuple[Column, str]], nothing: str) -> DataFrame:
    """AGG39: one row for each rule that a row of counts meets, or one that says there is none."""
    met = F.array_compact(F.array(*[F.when(rule, F.lit(text)) for rule, text in rules]))
    return counts.select(F.explode(F.when(F.size(met) > 0, met).otherwise(F.array(F.lit(nothing)))).alias("advice"))


def exact_percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float], splits: int = 64) -> DataFrame:
    """AGG29: linearly interpolated percentiles of each group, none of which has to fit into one task.

    Equal values are counted first, and all else reads the counts. A mergeable sketch cuts each group into ``splits`` buckets; only the
    buckets that hold a wanted rank are put in order, each by itself. Nulls are left out.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    cuts = counted.groupBy(group).agg(F.percentile_approx("v", F.array(*[F.lit(i / splits) for i in range(1, splits)]), F.lit(10_000)).alias("cuts"), F.sum("c").alias("n"))
    placed = counted.join(cuts, group).select(group, "v", "c", "n", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("bucket"))
    sizes = placed.groupBy(group, "bucket").agg(F.sum("c").alias("m"), F.max("n").alias("n"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = {name: (F.floor(F.lit(p) * (F.col("n") - 1)), F.ceil(F.lit(p) * (F.col("n") - 1)), F.lit(p) * (F.col("n") - 1)) for name, p in shares.items()}
    inside = lambda rank, a, b: (rank >= a) & (rank < b)
    wanted = F.lit(False)
    for low, high, _ in ranks.values():
        wanted = wanted | inside(low, F.col("before"), F.col("before") + F.col("m")) | inside(high, F.col("before"), F.col("before") + F.col("m"))
    kept = sizes.withColumn("before", before).where(wanted).select(group, "bucket", "before")
    end = F.col("before") + F.sum("c").over(Window.partitionBy(group, "bucket").orderBy("v"))
    ranked = placed.join(kept, [group, "bucket"]).withColumn("end", end).withColumn("start", F.col("end") - F.col("c"))
    at = lambda rank: F.max(F.when(inside(rank, F.col("start"), F.col("end")), F.col("v")))
    found = ranked.groupBy(group, "n").agg(*[e for name, (low, high, _) in ranks.items() for e in (at(low).alias(f"{name}_low"), at(high).alias(f"{name}_high"))])
    between = lambda name, exact: F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (exact - F.floor(exact))
    return found.select(group, *[between(name, exact).alias(name) for name, (_, _, exact) in ranks.items()])
