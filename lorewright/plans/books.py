"""Book structure, image evidence, dialogue supplements and candidate ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import books as B
from ..operators import graph as G
from ..operators import joins as J
from ..operators import retrieval as R
from ..operators import windows as W
from ..session import table
from .registry import query


@query(r"""
with u as (select conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from conversations where role = 'user'),
r as (select *, row_number() over (partition by conv_id order by turn) as r from u where t <> ''),
d as (select *, row_number() over (partition by conv_id, t order by turn) as k from r where r <= 30)
select conv_id, turn, substring(t, 1, 800) as out from d where k = 1
""")
def win10_supplement(spark, sf_dir):
    """First user turns of a session, each whole utterance once; shown up to 800 characters."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", T.one_spaced(F.col("text")).alias("out")).where("out <> ''")
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("r <= 30")
    return first.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "out").orderBy("turn"))).where("k = 1").select("conv_id", "turn", F.substring("out", 1, 800).alias("out"))


@query("""
select l_orderkey as k, l_linenumber as i, coalesce(case when lead(l_returnflag, 1) over w = 'R' then 1 when lead(l_returnflag, 2) over w = 'R' then 2 when lead(l_returnflag, 3) over w = 'R' then 3 end, 0)::bigint as caption_at
from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate)
""")
def win17_caption_after(spark, sf_dir):
    """Which of the next three rows is a caption."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    at = F.coalesce(*[F.when(F.lead("l_returnflag", i).over(w) == "R", F.lit(i)) for i in (1, 2, 3)], F.lit(0))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), at.cast("long").alias("caption_at"))


@query("""
with o as (select o_custkey as k, o_orderkey as i from orders)
select k, i, array_to_string(list(i) over (partition by k order by i rows between 2 preceding and 1 preceding), ',') as before,
       array_to_string(list(i) over (partition by k order by i rows between 1 following and 2 following), ',') as after from o
""")
def win18_lines_around(spark, sf_dir):
    """Up to two rows before and after."""
    w = Window.partitionBy("k").orderBy("i")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i"))
    listed = lambda a, b: F.nullif(F.array_join(F.collect_list(F.col("i").cast("string")).over(w.rowsBetween(a, b)), ","), F.lit(""))
    return rows.select("k", "i", listed(-2, -1).alias("before"), listed(1, 2).alias("after"))


@query("""
with c as (select o_custkey as k, o_shippriority as line, 10 * (1 + o_orderkey % 4) as priority, o_orderkey::varchar as text, o_orderstatus as reason from (select *, o_orderkey % 3 as o_shippriority from orders))
select k, line, max(priority) as priority, arg_max(text, (priority, text)) as text from c group by 1, 2
""")
def win21_one_per_line(spark, sf_dir):
    """One candidate for each line, by priority."""
    o = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (o % 3).alias("line"), (10 * (1 + o % 4)).alias("priority"), o.cast("string").alias("text"), F.col("o_orderstatus").alias("reason"))
    return W.one_per_line(rows, "k", "line").select("k", "line", "priority", "text")


@query("""
select l_orderkey, l_linenumber, coalesce(p.p_name, s.s_name) as evidence from lineitem l left join (select * from part where p_size > 25) p on p_partkey = l_partkey left join supplier s on s_suppkey = l_suppkey
""")
def jn14_fallback_key(spark, sf_dir):
    """Evidence by the first key, else by the second."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    first = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    second = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return J.lookup(J.lookup(lines, first, ["l_partkey"]), second, ["l_suppkey"]).select("l_orderkey", "l_linenumber", F.coalesce("p_name", "s_name").alias("evidence"))


@query("""
with n as (select 'p' || p_partkey as id from part where contains(lower(p_name), 'a') and p_size < 10),
e as (select 'o' || l_orderkey as source, 'p' || l_partkey as target, l_linenumber as i from lineitem)
select source, target, i from e where source in (select id from n) or target in (select id from n)
""")
def jn17_edges_of_nodes(spark, sf_dir):
    """Edges that touch a matched node at either end."""
    nodes = table(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lit("a")) & (F.col("p_size") < 10)).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.col("l_linenumber").alias("i"))
    hit = F.lit(True).alias("hit")
    near = edges.join(nodes.select(F.col("id").alias("source"), hit).withColumnRenamed("hit", "s"), "source", "left").join(nodes.select(F.col("id").alias("target"), hit).withColumnRenamed("hit", "t"), "target", "left")
    return near.where("s or t").select("source", "target", "i")


@query("""
with recursive l as (select distinct on (l_orderkey, l_linenumber) l_orderkey as k, l_linenumber as i, case when l_linenumber = 1 then 1 else 2 + l_partkey % 2 end as level, l_partkey::varchar as title
  from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate),
p as (select *, (select max(i) from l q where q.k = l.k and q.i < l.i and q.level < l.level) as parent from l),
a as (select k, i, parent as up, title as path from p union all select a.k, a.i, p.parent, p.title || '/' || a.path from a join p on p.k = a.k and p.i = a.up)
select k, i, path from a where up is null
""")
def jn20_heading_paths(spark, sf_dir):
    """Heading paths from the top."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(w)).where("r = 1")
    level = F.when(F.col("l_linenumber") == 1, F.lit(1).cast("long")).otherwise(2 + F.col("l_partkey") % 2)
    rows = rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), level.alias("level"), F.col("l_partkey").cast("string").alias("title"))
    return J.ancestors(J.nearest_lower(rows, "k", "i", "level", 3), "k", "i", "title", 3).select("k", "i", F.array_join("path", "/").alias("path"))


@query("""
with s as (select l_orderkey as item, l_linenumber as line, l_partkey, l_suppkey, 22 + case when l_partkey % 5 = 0 then 120 else 0 end + 55 * l_discount + greatest(0, 6 - l_quantity) as score, l_partkey % 5 = 0 as exact from lineitem),
r as (select *, row_number() over (partition by item order by exact desc, score desc, line, l_partkey, l_suppkey) as rank from s)
select item, line, l_partkey, round(score, 6) as score from r where rank <= 2 or exact
""")
def ret14_exact_and_top(spark, sf_dir):
    """The two best candidates of each item, and every exact one."""
    exact = F.col("l_partkey") % 5 == 0
    score = R.candidate_score(F.lit(22.0), exact, F.lit(False), F.col("l_discount"), F.lit(False), F.col("l_quantity"))
    place = F.struct(F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("line"), "l_partkey", score.alias("score"), exact.alias("exact"), place.alias("place"))
    return R.keep_exact_and_top(rows, "item", "exact", "score", "place", 2).select("item", "line", "l_partkey", F.round("score", 6).alias("score"))


@query()
def ret13_title_ratio(spark, sf_dir):
    """Similarity of part names to their type, by sequence matching."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(B.title_ratio("p_name", "p_type"), 6).alias("ratio"))


@query("""
select count(*) as n_chunks, count(*) filter (where regexp_matches(text, 'https?://')) as with_url, count(*) filter (where regexp_matches(text, '!\\[[^\\]]*\\]\\(')) as with_image, count(*) filter (where regexp_matches(text, '\\b[\\w-]+\\.(?:png|jpe?g|gif|svg|webp|pdf)\\b')) as with_file from documents
""")
def agg36_chunk_noise(spark, sf_dir):
    """Chunks with addresses, images or file names."""
    has = lambda p: F.count_if(F.rlike("text", F.lit(p)))
    return table(spark, sf_dir, "documents").agg(
        F.count(F.lit(1)).alias("n_chunks"), has("https?://").alias("with_url"), has(r"!\[[^\]]*\]\(").alias("with_image"), has(r"\b[\w-]+\.(?:png|jpe?g|gif|svg|webp|pdf)\b").alias("with_file")
    )


@query("""
select count(*) filter (where regexp_matches(p_name, '(?i)e')) as n_matching, array_to_string(list_slice(list_sort(list(p_partkey) filter (where regexp_matches(p_name, '(?i)e'))), 1, 50), ',') as sample from part
""")
def agg32_predicate_audit(spark, sf_dir):
    """Nodes that match a predicate, counted, and the first fifty."""
    out = G.matching_sample(table(spark, sf_dir, "part"), F.rlike("p_name", F.lit("(?i)e")), "p_partkey", 50)
    return out.select("n_matching", F.nullif(F.array_join(F.col("sample").cast("array<string>"), ","), F.lit("")).alias("sample"))


@query(r"""
with k as (select distinct term, doc_id from (select doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as term from documents where doc_id not in (select doc_id from labels where quality = 0)))
select term, count(*) as n_docs from k group by 1
""")
def snk11_index_after_delete(spark, sf_dir):
    """Keyword index after deleting documents, by document frequency."""
    gone = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    index = R.token_table(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return index.join(gone, "doc_id", "left_anti").groupBy("term").agg(F.countDistinct("doc_id").alias("n_docs"))
