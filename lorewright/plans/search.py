"""Vector and keyword retrieval over ``embeddings`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..scratch import Scratch
from ..session import table
from .registry import query

#: Queries are every row whose id is divisible by EVERY; K results are kept for each.
EVERY, K = 20, 10

_COSINE = """
with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 20 = 0),
s as (select query_id, vec_id, round(list_dot_product(q::double[], embedding::double[]) / greatest(sqrt(list_dot_product(q::double[], q::double[])) * sqrt(list_dot_product(embedding::double[], embedding::double[])), 1e-10), 6) as score
      from q, embeddings),
v as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
"""


def _vector(spark, sf_dir, least=None):
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.similarity_top_k(rows, "vec_id", "embedding", queries, K, Scratch(spark, "vectors"), least)


@query(_COSINE + "select query_id, vec_id, score, rank from v where rank <= 10")
def ret5_vector_top_k(spark, sf_dir):
    """Exact cosine top-k."""
    return _vector(spark, sf_dir)


@query(_COSINE + "select query_id, vec_id, score, rank from v where rank <= 10 and score >= 0.2")
def ret6_threshold(spark, sf_dir):
    """Top-k above a threshold."""
    return _vector(spark, sf_dir, least=0.2)


@query("""
with n as (select vec_id, embedding, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings),
e as (select vec_id, n, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as dim from n)
select vec_id, dim, round(case when n = 0 then x else (x / n)::float end::double, 5) as x from e
""")
def ret4_normalised(spark, sf_dir):
    """Unit vectors, by dimension; a zero vector stays."""
    unit = R.l2_normalised(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(unit).alias("dim", "x")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("x").cast("double"), 5).alias("x"))


_BM25 = r"""
with t as (select doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as terms from documents),
st as (select count(*) as n_docs, avg(len(terms)) as avg_dl from t),
i as (select doc_id, len(terms) as dl, unnest(terms) as term from t),
tf as (select term, doc_id, dl, count(*) as tf from i group by all),
q as (select distinct item_id as query_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as term from benchmark where item_id % 20 = 0),
df as (select term, count(*) as df from tf group by 1),
s as (select query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) as score
      from q join tf using (term) join df using (term), st group by 1, 2),
k as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s)
"""


def _keyword(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").where(F.col("item_id") % EVERY == 0)
    queries = items.select(F.col("item_id").alias("query_id"), F.explode(R.terms_of(F.col("text"))).alias("term"))
    return R.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", queries, K, Scratch(spark, "keywords"))


@query(_BM25 + "select query_id, doc_id, score, rank from k where rank <= 10")
def ret10_keyword_top_k(spark, sf_dir):
    """BM25 over the keyword index."""
    return _keyword(spark, sf_dir)


@query(
    _BM25.rstrip().removesuffix(")").replace("with t as", "with recursive t as") + """),
q2 as (select vec_id as query_id, embedding as q from embeddings where vec_id % 20 = 0),
s2 as (select query_id, vec_id as doc_id, round(list_dot_product(q::double[], embedding::double[]) / greatest(sqrt(list_dot_product(q::double[], q::double[])) * sqrt(list_dot_product(embedding::double[], embedding::double[])), 1e-10), 6) as score from q2, embeddings),
v2 as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s2),
u as (select query_id, doc_id, rank, score as vector_score, null::double as keyword_score from v2 where rank <= 10 union all select query_id, doc_id, rank, null, score from k where rank <= 10),
f as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 9) as rrf_score, max(vector_score) as vector_score, max(keyword_score) as keyword_score from u group by 1, 2),
r as (select *, round(least(1.0, greatest(0.0, rrf_score / (2.0::double / 60))), 6) as score, row_number() over (partition by query_id order by rrf_score desc, doc_id) as rank from f)
select query_id, doc_id, rrf_score, vector_score, keyword_score, score, rank from r where rank <= 10
"""
)
def ret9_fusion(spark, sf_dir):
    """Reciprocal rank fusion of vector and keyword hits (vec_id stands for doc_id)."""
    return R.fuse(_vector(spark, sf_dir).withColumnRenamed("vec_id", "doc_id"), _keyword(spark, sf_dir), "doc_id", K)


@query("""
with a as (select user_id as query_id, event_id as pos, event_type || (event_id % 5)::varchar as url, value from events where event_id % 2 = 0),
b as (select user_id as query_id, event_id as pos, case when event_id % 3 = 0 then '' else event_type || (event_id % 5)::varchar end as url, value from events where event_id % 2 = 1),
u as (select *, 1 as batch from a union all select *, 2 from b),
d as (select *, row_number() over (partition by query_id, case when url = '' then 'row:' || batch || ':' || pos else url end order by batch, pos) as r from u)
select query_id, pos, url, row_number() over (partition by query_id order by batch, pos) as rank from d where r = 1
""")
def ret16_merged_lists(spark, sf_dir):
    """Two result lists as one, by URL."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("pos"), F.concat("event_type", (F.col("event_id") % 5).cast("string")).alias("url"))
    second = rows.where("pos % 2 = 1").withColumn("url", F.when(F.col("pos") % 3 == 0, "").otherwise(F.col("url")))
    return R.merge_lists(rows.where("pos % 2 = 0"), second, "query_id").select("query_id", "pos", "url", "rank")


@query("""
with r as (select user_id as query_id, event_id as pos, case when event_id % 4 = 0 then null else ts::date end as found from events),
d as (select *, bool_or(found is not null) over (partition by query_id) as dated, abs(datediff('day', found, date '2024-01-10')) as age from r),
k as (select *, case when not dated then 0 when found is null then -9999 else -age + (age = 0)::int end as score from d
      where not dated or (found is not null and age <= 7))
select query_id, pos, row_number() over (partition by query_id order by score desc, pos) as rank from k
""")
def ret15_recency(spark, sf_dir):
    """Recency filter and order of the market policy."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 4 != 0, F.col("ts").cast("date")).alias("found")
    )
    return R.recency(rows, "query_id", "pos", "found", F.lit("2024-01-10").cast("date"), *R.RECENCY["market"]).select("query_id", "pos", "rank")


@query("""
with c as (select item_id as pos, lower(string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2]) as name from benchmark),
h as (select doc_id, min(pos) as pos from documents, c where contains(lower(text), name) and name <> '' group by 1)
select doc_id, name from h join c using (pos)
""")
def jn9_first_concept(spark, sf_dir):
    """The first concept that a text names."""
    words = F.split("text", " ")
    concepts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), F.lower(F.concat(F.get(words, 0), F.lit(" "), F.get(words, 1))).alias("name"), F.lit(None).cast("string").alias("alias"))
    return R.first_concept(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", concepts, Scratch(spark, "concepts")).select("doc_id", "name")


@query("""
with r as (select conv_id as query_id, text as content, row_number() over (partition by conv_id order by turn, role) as rank from conversations)
select query_id, string_agg(substring(content, 1, 500), chr(10) || chr(10) order by rank) as context from r where rank <= 3 group by 1
""")
def ret20_context(spark, sf_dir):
    """Context of the three best contents."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("text").alias("content"), "turn", "role")
    return R.context_text(R.formatted(rows, "query_id", [F.col("turn"), F.col("role")], 3), "query_id")
