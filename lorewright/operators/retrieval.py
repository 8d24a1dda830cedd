"""Retrieval, ranking and fusion (RET1-RET20, JN9-JN11, AGG43).

Query vectors are a stated set that runs against all rows, block by block: a block of at most
``QUERY_BLOCK`` vectors goes to every task, and a task keeps its k best rows of each query, so only
those are shuffled. Blocks are read one after another, whatever their number. Terms of queries
select from the keyword index in a join. The keyword scores and the rank fusion are this engine's
own: BM25, and reciprocal ranks with k = 60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

QUERY_BLOCK = 2048
RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """RET3: guarded against zero vectors."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-10))


def l2_normalised(v: Column) -> Column:
    """RET4: a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: (x / n).cast("float")))


def top_k(scored: DataFrame, query: str, score: str, key: str, k: int) -> DataFrame:
    """The k best rows of each query with their rank."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best_of_block(held, key: str, vector: str, k: int, least: float | None):
    """Rows (key, vector) to (query_id, key, score): a task's k best rows of each query of the block."""

    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = held.value
        q = unit(np.frombuffer(vectors, np.float64).reshape(len(ids), -1))
        at, rows, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        bar = np.full(len(ids), -np.inf if least is None else least)  # what a row has to reach to be among the best
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                column = part.column(vector)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                score = np.round(q @ unit(flat.reshape(part.num_rows, -1)).T, 6)
                new_at, new = np.nonzero(score >= bar[:, None])
                at = np.concatenate([at, new_at])
                rows = np.concatenate([rows, part.column(key).to_numpy()[new]])
                scores = np.concatenate([scores, score[new_at, new]])
                order = np.lexsort((rows, -scores, at))
                at, rows, scores = at[order], rows[order], scores[order]
                first = np.searchsorted(at, at)
                kept = np.arange(len(at)) - first < k
                at, rows, scores = at[kept], rows[kept], scores[kept]
                last = np.arange(len(at)) - np.searchsorted(at, at) == k - 1
                bar[at[last]] = scores[last]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[at]), pa.array(rows), pa.array(scores)], ["query_id", key, "score"])

    return run


def similarity_top_k(rows: DataFrame, key: str, vector: str, queries: DataFrame, k: int, scratch: Scratch, least: float | None = None) -> DataFrame:
    """RET5, RET6: exact cosine top-k of the rows (key, vector) for each of ``queries`` (query_id, q).

    Scores are rounded to six places, equal ones ranked by key. Rows or queries without a vector are left out.
    """
    spark, slim = rows.sparkSession, rows.where(F.col(vector).isNotNull()).select(key, vector)
    out, block = None, []

    def search(block: list, n: int) -> DataFrame:
        held = spark.sparkContext.broadcast(([r.query_id for r in block], np.array([r.q for r in block], np.float64).tobytes()))
        best = slim.mapInArrow(_best_of_block(held, key, vector, k, least), f"query_id long, {key} long, score double")
        return scratch.save(top_k(best, "query_id", "score", key, k), f"block-{n}")

    n = 0
    for r in queries.where("q is not null").select("query_id", "q").toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            found, block, n = search(block, n), [], n + 1
            out = found if out is None else out.union(found)
    if block or out is None:
        found = search(block, n) if block else spark.createDataFrame([], f"query_id long, {key} long, score double, rank int")
        out = found if out is None else out.union(found)
    return out


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def token_table(docs: DataFrame, key: str, text: str, wanted: DataFrame | None = None) -> DataFrame:
    """term, key, tf and the document's length: the keyword index, of the terms ``wanted`` only if given.

    If the empty term is wanted, every document has it once: it counts documents and their lengths.
    """
    each = docs.select(key, F.coalesce(terms_of(F.col(text)), F.array().cast("array<string>")).alias("terms"))
    listed = F.col("terms") if wanted is None else F.concat(F.array(F.lit("")), "terms")
    each = each.select(key, F.size("terms").alias("dl"), F.explode_outer(listed).alias("term")).where("term is not null")
    if wanted is not None:
        each = each.join(wanted, "term", "left_semi")
    return each.groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, k: int, scratch: Scratch, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """RET10: query_id, key, score, rank over ``queries`` (query_id, term).

    Texts are read once; only terms of queries, and one row for each document, are counted and shuffled.
    """
    wanted = scratch.save(queries.select("query_id", "term").distinct(), "query-terms")
    asked = wanted.select("term").union(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
    counted = scratch.save(token_table(docs, key, text, asked), "hits")
    stats = counted.where("term = ''").agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avg_dl")).first()  # one row
    hits = counted.where("term <> ''")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(float(stats.n_docs or 0)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(float(stats.avg_dl or 1.0))))
    scored = wanted.join(hits, "term").join(df, "term").groupBy("query_id", key).agg(F.round(F.sum(idf * weight), 6).alias("score"))
    return top_k(scored, "query_id", "score", key, k)


def fuse(vector: DataFrame, keyword: DataFrame, key: str, k: int) -> DataFrame:
    """RET9: query_id, key, rrf_score, vector_score, keyword_score, score (0 to 1), rank."""
    lists = vector.select("query_id", key, "rank", F.col("score").alias("vector_score"), F.lit(None).cast("double").alias("keyword_score")).unionByName(
        keyword.select("query_id", key, "rank", F.lit(None).cast("double").alias("vector_score"), F.col("score").alias("keyword_score"))
    )
    fused = lists.groupBy("query_id", key).agg(
        F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("rrf_score"), F.max("vector_score").alias("vector_score"), F.max("keyword_score").alias("keyword_score")
    )
    shown = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("rrf_score") / F.lit(2 / RRF_K)))
    return top_k(fused.withColumn("score", F.round(shown, 6)), "query_id", "rrf_score", key, k)


def rerank(hits: DataFrame, scores: DataFrame, key: str, k: int, missing: float = -10.0) -> DataFrame:
    """RET7, RET8: external scores decide the order; a pair without one gets ``missing``."""
    joined = hits.drop("rank").join(scores.select("query_id", key, F.col("score").alias("rerank_score")), ["query_id", key], "left")
    return top_k(joined.withColumn("rerank_score", F.coalesce("rerank_score", F.lit(missing))), "query_id", "rerank_score", key, k)


def candidate_score(prior: Column, exact: Column, prefix: Column, ratio: Column, contained: Column, distance: Column) -> Column:
    """RET13: type prior, +120 same number, +10 prefix, 55 x similarity, +18 containment, up to 6 for position."""
    return (
        prior + F.when(exact, 120).otherwise(0) + F.when(prefix, 10).otherwise(0) + 55 * ratio + F.when(contained, 18).otherwise(0) + F.greatest(F.lit(0.0), 6 - distance)
    )


def keep_exact_and_top(scored: DataFrame, item: str, exact: str, score: str, at: str, k: int) -> DataFrame:
    """RET14: the k best candidates of an item, and every exact one."""
    w = Window.partitionBy(item).orderBy(F.desc(exact), F.desc(score), F.asc(at))
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked.where((F.col("rank") <= k) | F.col(exact))


def merge_lists(first: DataFrame, second: DataFrame, query: str) -> DataFrame:
    """RET16: two result lists (query, pos, url, ...) as one; a URL counts once, rows without one always stay."""
    both = first.withColumn("batch", F.lit(1)).unionByName(second.withColumn("batch", F.lit(2)))
    url = F.nullif(F.trim(F.coalesce("url", F.lit(""))), F.lit(""))
    key = F.coalesce(url, F.concat_ws(":", F.lit("row"), "batch", "pos"))
    w = Window.partitionBy(query, key).orderBy("batch", "pos")
    kept = both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("batch", "pos")))


def formatted(results: DataFrame, query: str, order: list[Column], n: int = 5, most: int = 2000) -> DataFrame:
    """RET17: rank from 1, contents cut, n rows a query."""
    ranked = results.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    return ranked.where(F.col("rank") <= n).withColumn("content", F.substring("content", 1, most))


def decayed(rank: Column) -> Column:
    """RET19: 0.9, falling by 0.1 to 0.5."""
    return F.greatest(F.lit(0.5), F.lit(0.9) - 0.1 * rank)


def answer_confidence(label: Column, web_mean: Column) -> Column:
    """AGG43."""
    return F.when(label == "greeting", 0.98).when(label == "noise", 0.99).when(web_mean.isNotNull(), F.greatest(F.lit(0.75), web_mean)).otherwise(0.8)


#: Days that a dated result may be off, and whether today's are preferred, by policy.
RECENCY = {"traffic": (2, True), "weather": (2, True), "news": (14, False), "market": (7, True), "time": (365, False), "general": (30, False)}


def recency(results: DataFrame, query: str, pos: str, found: str, now: Column, days: int, prefer_today: bool) -> DataFrame:
    """RET15, A1: drop what is too old, order the rest; a query without any dated row keeps its list.

    ``found`` is the date column (null: undated). Rows that are dated but too old still count as dated.
    """
    age = F.abs(F.datediff(now, F.col(found)))
    dated = F.max(F.col(found).isNotNull()).over(Window.partitionBy(query))
    score = F.when(F.col(found).isNull(), F.lit(-9999.0)).otherwise(-age + F.when(F.lit(prefer_today) & (age == 0), 1).otherwise(0))
    marked = results.withColumn("_dated", dated).withColumn("_age", age).withColumn("_score", F.when(dated, score).otherwise(F.lit(0.0)))
    keep = ~F.col("_dated") | (F.col(found).isNotNull() & (F.col("_age") <= days)) | (F.col(found).isNull() & F.lit(not prefer_today))
    kept = marked.where(keep)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("_score"), pos))).drop("_dated", "_age", "_score")


def context_text(hits: DataFrame, query: str, n: int = 3, most: int = 500) -> DataFrame:
    """RET20: the best n contents of each query, cut and joined in rank order."""
    rows = hits.where(F.col("rank") <= n)
    parts = F.array_sort(F.collect_list(F.struct("rank", F.substring("content", 1, most).alias("t"))))
    return rows.groupBy(query).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("context"))


def long_web_text(text: Column) -> Column:
    """RET20: 1200 characters, and 800 of the tail where there are more than 2400."""
    n = F.char_length(text)
    return F.when(n > 2400, F.concat(F.substring(text, 1, 1200), F.lit("\n...\n"), F.right(text, F.lit(800)))).otherwise(F.substring(text, 1, 1200))


def in_language(results: DataFrame, query: str, pos: str, language: Column, unwanted: str, n: int) -> DataFrame:
    """FIL14: results in the unwanted language left out, the first n kept."""
    kept = results.where(language != unwanted)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(pos))).where(F.col("rank") <= n)


TERM_BLOCK = 50_000


def _contained(held):
    """Rows (key, low) to (key, term): the distinct terms of the block that stand in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in held.value:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            for i, low in enumerate(batch.column(1).to_pylist()):
                terms = {t for _, t in automaton.iter(low or "")}
                at += [i] * len(terms)
                found += terms
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], [batch.schema.names[0], "term"])

    return run


def terms_in_text(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str, pos: str, scratch: Scratch) -> DataFrame:
    """JN9, JN11: every (key, term, pos) where the lower-cased term is a substring of the lower-cased text.

    Terms are looked for by an automaton that reads each text once, in blocks of ``TERM_BLOCK`` terms:
    no text is shuffled, and no list of terms is too long. Empty terms and null texts match nothing.
    """
    spark = texts.sparkSession
    filed = scratch.save(terms.select(F.lower(term).alias("term"), F.col(pos).alias("pos")).where("term <> ''").distinct(), "terms")
    low = texts.select(key, F.lower(text).alias("low"))
    schema = f"{key} {dict(texts.dtypes)[key]}, term string"
    out, block, n = spark.createDataFrame([], schema), [], 0
    for r in filed.select("term").distinct().toLocalIterator():
        block.append(r.term)
        if len(block) == TERM_BLOCK:
            out, block, n = out.union(scratch.save(low.mapInArrow(_contained(spark.sparkContext.broadcast(block)), schema), f"found-{n}")), [], n + 1
    if block:
        out = out.union(low.mapInArrow(_contained(spark.sparkContext.broadcast(block)), schema))
    return out.join(filed, "term").select(key, "term", "pos").distinct()


def first_concept(texts: DataFrame, key: str, text: str, concepts: DataFrame, scratch: Scratch) -> DataFrame:
    """JN9: the first concept of ``concepts`` (pos, name, alias or null) that a text names; names before aliases.

    Of concepts with the same term only the first one can be a text's first, so a term meets each text once.
    """
    rank = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col("pos"), F.col("name")).alias("_hit")
    names = concepts.select(rank(0), F.col("name").alias("term"))
    aliases = concepts.where("alias is not null").select(rank(1), F.col("alias").alias("term"))
    firsts = names.union(aliases).groupBy(F.lower("term").alias("term")).agg(F.min("_hit").alias("_hit"))
    hits = terms_in_text(texts, key, text, firsts, "term", "_hit", scratch)
    best = hits.groupBy(key).agg(F.min("pos").alias("_hit"))
    return best.select(key, "_hit.name", F.when(F.col("_hit.kind") == 0, "name").otherwise("alias").alias("by"))


def typed_entity(entities: DataFrame, concepts: DataFrame, types: list[str]) -> DataFrame:
    """JN10: query_id, name: the best ranked entity (query_id, rank, entity_name, entity_type) of a type that counts and with a concept."""
    hits = entities.where(F.col("entity_type").isin(types)).join(concepts.select(F.col("name").alias("entity_name")).distinct(), "entity_name", "left_semi")
    return hits.groupBy("query_id").agg(F.min_by("entity_name", "rank").alias("name"))


def concept_cascade(queries: DataFrame, key: str, text: str, concepts: DataFrame, entities: DataFrame, types: list[str], scratch: Scratch) -> DataFrame:
    """RET11: key, name, confidence, reason: a concept named in the question, else a retrieved one, else none."""
    named = first_concept(queries, key, text, concepts, scratch).select(key, F.col("name").alias("exact"), "by")
    found = typed_entity(entities.withColumnRenamed(key, "query_id") if key != "query_id" else entities, concepts, types).select(F.col("query_id").alias(key), F.col("name").alias("entity"))
    out = queries.select(key).join(named, key, "left").join(found, key, "left")
    reason = F.when(F.col("exact").isNotNull(), F.concat("by", F.lit("_in_query"))).when(F.col("entity").isNotNull(), "entity_hit").otherwise("not_found")
    confidence = F.when(F.col("exact").isNotNull(), 1.0).when(F.col("entity").isNotNull(), 0.9).otherwise(0.0)
    return out.select(key, F.coalesce("exact", "entity").alias("name"), confidence.alias("confidence"), reason.alias("reason"))


def assessment(tops: DataFrame, method: str, top: str, success: str) -> DataFrame:
    """RET12: by method, how often it succeeds, and its top scores."""
    mean = F.sum(F.col(top).cast("decimal(18,6)")).cast("double") / F.count(top)
    return tops.groupBy(method).agg(
        F.count(F.lit(1)).alias("n_queries"), F.round(F.avg(F.col(success).cast("int")), 6).alias("success_rate"), F.min(top).alias("min_top"), F.max(top).alias("max_top"), F.round(mean, 6).alias("avg_top")
    )


def low_relevance(results: DataFrame, query: str, score: str, least: float) -> DataFrame:
    """RET18: the best score of each query, and whether it is below what counts as relevant."""
    return results.groupBy(query).agg(F.max(score).alias("best")).withColumn("low", F.col("best") < least)
