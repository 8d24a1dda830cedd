"""Knowledge-graph audits (AGG31-AGG40, FIL12, SUP43, SUP44)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """node, degree: incident edges of every node."""
    return edges.select(F.col(src).alias("node")).union(edges.select(F.col(dst).alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def evidence(nodes: DataFrame) -> DataFrame:
    """Nodes without source, path or description."""
    blank = lambda c: F.count_if(F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    return nodes.agg(
        F.count(F.lit(1)).alias("n_nodes"),
        blank("source_id").alias("missing_source"),
        blank("file_path").alias("missing_path"),
        blank("description").alias("missing_description"),
    )


def schema_audit(nodes: DataFrame, allowed: list[str], forbidden: list[str]) -> DataFrame:
    """state, n: nodes by whether their type is allowed, forbidden, unknown or invalid."""
    t = F.lower(F.trim(F.coalesce("entity_type", F.lit(""))))
    state = F.when((t == "") | (t == "unknown"), "unknown").when(t.isin(allowed), "allowed").when(t.isin(forbidden), "forbidden").otherwise("invalid")
    return nodes.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def name_faults(name: Column, patterns: list[tuple[str, str]]) -> Column:
    """Codes of the patterns that a name matches, in their order."""
    return F.array_compact(F.array(*[F.when(F.rlike(name, F.lit(f"(?i){p}")), F.lit(code)) for code, p in patterns]))


def matching_sample(nodes: DataFrame, wanted: Column, order: str, n: int) -> DataFrame:
    """Matches counted, and the first n of them."""
    hit = nodes.where(wanted)
    sample = hit.orderBy(order).limit(n)
    return hit.agg(F.count(F.lit(1)).alias("n_matching")).join(F.broadcast(sample.agg(F.array_sort(F.collect_list(order)).alias("sample"))))  # one row each


def select_book(nodes: DataFrame, edges: DataFrame, columns: list[str], stem: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a book by a substring of their fields; everything when no node matches."""
    own = lambda: F.array_contains(F.transform(F.array(*columns), lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(stem.lower()))), True)
    found = nodes.where(own())
    if found.isEmpty():
        return nodes, edges
    ids = found.select(F.col("node_id").alias("id"), F.lit(True).alias("hit"))
    near = edges.join(ids.select(F.col("id").alias("source"), F.col("hit").alias("s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.col("hit").alias("t")), "target", "left")
    return found, near.where(F.col("s") | F.col("t") | own()).select(*edges.columns)


def merge_extractions(rows: DataFrame) -> DataFrame:
    """One row for each entity, with the distinct sources of all of its mentions."""
    named = rows.select(F.lower("entity").alias("entity"), "sources")
    mentions = named.groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"))
    sources = named.select("entity", F.explode("sources").alias("source")).groupBy("entity").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return mentions.join(sources, "entity", "left").select("entity", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "mentions")


def relation_type(explicit: Column, keywords: Column, description: Column, allowed: list[str]) -> Column:
    """Explicit field, else the first allowed keyword, else the first keyword, else the longest allowed name in the description."""
    words = F.filter(F.transform(F.split(F.coalesce(keywords, F.lit("")), r"[,;|]"), lambda x: F.trim(x)), lambda x: x != "")
    good = F.filter(words, lambda x: F.array_contains(F.array(*map(F.lit, allowed)), x))
    ranked = sorted(allowed, key=lambda x: (-len(x), x))
    scan = F.coalesce(*[F.when(F.contains(F.coalesce(description, F.lit("")), F.lit(x)), F.lit(x)) for x in ranked], F.lit(""))
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), F.get(good, 0), F.get(words, 0), scan)


def with_degree(nodes: DataFrame, edges: DataFrame, key: str, src: str, dst: str) -> DataFrame:
    """PRJ5: nodes with the number of their edges, zero where there is none."""
    d = degrees(edges, src, dst).withColumnRenamed("node", key)
    return nodes.join(d, key, "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def image_audit(images: DataFrame, chunk: str) -> DataFrame:
    """AGG35: counters over image metadata (path, caption, exists, url)."""
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    remote = F.rlike(F.coalesce("url", F.lit("")), F.lit("^https?://"))
    return images.agg(
        F.countDistinct(chunk).alias("chunks_with_images"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(filled("caption")).alias("with_caption"),
        F.count_if(~filled("caption")).alias("missing_caption"),
        F.count_if(F.col("exists")).alias("exists_true"),
        F.count_if(~F.col("exists")).alias("exists_false"),
        F.count_if(F.col("exists").isNull()).alias("exists_none"),
        F.count_if(remote).alias("remote"),
        F.count_if(~remote).alias("local"),
    )


def merge_in_order(items: list[tuple]) -> list[tuple]:
    """JN21: items (path, line_no, *fields) merged into the first earlier one with their path or line; empty fields are filled."""
    out: list[list] = []
    for path, line, *rest in items:
        same = next((x for x in out if (path and x[-1] == path) or (line is not None and x[1] == line)), None)
        if same is None:
            out.append([path, line, *rest, path])
        else:
            for i, v in enumerate((path, line, *rest)):
                if same[i] in (None, "") and v not in (None, ""):
                    same[i] = v
    return [tuple(x[:-1]) for x in out]


def merged_images(images: DataFrame, chunk: str, order: list[str], columns: list[str]) -> DataFrame:
    """JN21 for every chunk; a chunk's images are what bounds a group."""
    from .books import by_document

    types = dict(images.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (chunk, *columns))
    return by_document(images.select(chunk, *order, *columns), chunk, order, columns, merge_in_order, schema)


def by_label(rows: DataFrame, label: str, nodes: DataFrame) -> DataFrame:
    """SUP44: rows with the least node_id of their label, without case, how many share it, and whether there is none."""
    known = nodes.groupBy(F.lower("label").alias("_label")).agg(F.min("node_id").alias("node_id"), F.count(F.lit(1)).alias("n_same"))
    out = rows.join(known, F.lower(label) == F.col("_label"), "left").drop("_label")
    return out.withColumn("failed", F.col("node_id").isNull()).withColumn("n_same", F.coalesce("n_same", F.lit(0).cast("long")))
