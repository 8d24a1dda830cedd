"""Book structure, graph audits, concept retrieval, pages and windows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import filters as L
from ..operators import graph as G
from ..operators import records as P
from ..operators import retrieval as R
from ..operators import structure as S
from ..scratch import Scratch
from ..session import table
from .registry import query

_LINES_SQL = """
with o as (select o_custkey as doc_id, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as line_no from orders),
l as (select doc_id, line_no, o_orderkey, case o_orderkey % 6 when 0 then '# Head ' || o_orderkey when 1 then '# CHAPTER ' || o_orderkey % 9 when 2 then '第 ' || o_orderkey % 7 || ' 章 x'
        when 3 then o_orderkey % 5 || '.' || o_orderkey % 3 || ' part' when 4 then repeat('long ', 12) else '' end as text from o)
"""


def lines(spark, sf_dir):
    """Orders of a customer as the lines of a book."""
    k = F.col("o_orderkey")
    kinds = [
        F.concat(F.lit("# Head "), k.cast("string")), F.concat(F.lit("# CHAPTER "), (k % 9).cast("string")), F.concat(F.lit("第 "), (k % 7).cast("string"), F.lit(" 章 x")),
        F.concat((k % 5).cast("string"), F.lit("."), (k % 3).cast("string"), F.lit(" part")), F.repeat(F.lit("long "), 12), F.lit(""),
    ]
    text = F.get(F.array(*kinds), (k % 6).cast("int"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.row_number().over(w).cast("long").alias("line_no"), text.alias("text"))


@query(_LINES_SQL + """,
m as (select *, starts_with(text, '#') as heading, contains(text, 'CHAPTER') as marker, contains(text, '章') as chapter, ltrim(regexp_extract(text, '\\d+(?:\\.\\d+)*'), '0') as key from l),
w as (select *, list({'line_no': line_no, 'text': trim(text, ' '), 'heading': heading, 'marker': marker}) over (partition by doc_id order by line_no rows between 6 preceding and 1 preceding) as b,
             list({'line_no': line_no, 'text': trim(text, ' '), 'heading': heading, 'marker': marker}) over (partition by doc_id order by line_no rows between 1 following and 6 following) as a from m),
k as (select *, case when regexp_extract(text, '\\d+(?:\\.\\d+)*') = '0' then '0' else key end as number_key from w where (marker or chapter) and regexp_extract(text, '\\d+') <> ''),
g as (select doc_id, number_key, list_concat(list_concat(case when marker then list_filter(b, lambda x: x.heading) else [] end, [{'line_no': line_no, 'text': trim(text, ' '), 'heading': heading, 'marker': marker}]),
        case when chapter then list_filter(a, lambda x: x.heading or x.marker) else [] end) as g from k)
select doc_id, g[1].line_no as line_no, g[len(g)].line_no as until, array_to_string(list_transform(list_filter(g, lambda x: x.text <> ''), lambda x: x.text), ' | ') as text, number_key from g
""")
def win19_chapter_groups(spark, sf_dir):
    """Chapter marks and titles with the headings around them."""
    return S.chapter_groups(lines(spark, sf_dir)).select("doc_id", "line_no", "until", "text", "number_key")


_SCORES_SQL = """
with s as (select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate) as i, count(*) over (partition by l_orderkey) as n, l_partkey as p, l_suppkey as u from lineitem),
t as (select *, 1 + p % 3 || '.' || repeat(chr((97 + p % 2)::int), (1 + p % 4)::int) as title, 1 + u % 3 || '.' || repeat(chr((97 + u % 2)::int), (1 + u % 5)::int) as line from s),
x as (select c.doc_id, c.i as catalog_index, l.i as line_no, c.n, 1 + c.p % 3 = 1 + l.u % 3 as same, c.p % 2 = l.u % 2 as letter, 1 + c.p % 4 as a, 1 + l.u % 5 as b, l.u % 4 as kind, c.title, l.line from t c join t l on l.doc_id = c.doc_id)
select doc_id, catalog_index, line_no, same as exact,
       round(([28.0, 22.0, 16.0, 5.0])[1 + kind]::double + case when same then 120 else 0 end + 55.0::double * 2 * (case when same then 2 else 1 end + case when letter then least(a, b) else 0 end) / (a + b + 4)
             + case when contains(title, line) or contains(line, title) then 18 else 0 end
             + greatest(0, 6 - abs((line_no - 1) / greatest(1, n - 1)::double - (catalog_index - 1) / greatest(1, n - 1)::double) * 6), 3) as score from x
"""


def _candidates(spark, sf_dir):
    """Lines of an order as the catalog of a book and as the candidates in it."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).cast("long").alias("i"), F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("u"))
    named = lambda c, m: F.concat((1 + F.col(c) % 3).cast("string"), F.lit("."), F.expr(f"repeat(chr(97 + {c} % 2), cast(1 + {c} % {m} as int))"))
    kind = F.get(F.array(*map(F.lit, ("chapter_group", "markdown_heading", "numbered_line", "short_title"))), (F.col("u") % 4).cast("int"))
    catalog = rows.select("doc_id", F.col("i").alias("catalog_index"), F.col("n").alias("n_items"), named("p", 4).alias("title"))
    found = rows.select("doc_id", F.col("i").alias("line_no"), kind.alias("kind"), named("u", 5).alias("text"))
    spans = rows.groupBy("doc_id").agg(F.lit(1).cast("long").alias("first"), F.max("i").alias("last"))
    return catalog, found, spans


@query(_SCORES_SQL)
def jn16_candidate_scores(spark, sf_dir):
    """Every catalog item of a book against every candidate line of it."""
    return S.candidate_scores(*_candidates(spark, sf_dir))


@query(f"select doc_id, catalog_index, line_no, score from (select *, row_number() over (partition by doc_id, catalog_index order by score desc, line_no) as r from ({_SCORES_SQL})) where exact or r <= 2")
def ret14_top_candidates(spark, sf_dir):
    """The two best candidates of every item and all of its number; similarities are worked out where they can count."""
    return S.top_candidates(*_candidates(spark, sf_dir), k=2).select("doc_id", "catalog_index", "line_no", "score")


_PLAN_SQL = """
with s as (select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate) as idx, l_partkey as p, l_suppkey as u from lineitem),
c as (select doc_id, idx, 1 + p % 3 as level, case when u % 4 <> 0 then idx * 10 end as start, 200 as last, p from s)
"""


def catalog(spark, sf_dir):
    """Lines of an order as the catalog of a book; every fourth item has no line."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).cast("long").alias("catalog_index"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("u"))
    return rows.select("doc_id", "catalog_index", (1 + F.col("p") % 3).alias("level"), F.when(F.col("u") % 4 != 0, F.col("catalog_index") * 10).alias("start"), F.lit(200).cast("long").alias("last"), "p", "u")


@query(_PLAN_SQL + """,
t as (select doc_id, idx * 10 + 1 as line_no, (['', '# h', 'body', '![x'])[1 + p % 4] as text from c),
b as (select c.*, (select min(idx) from c d where d.doc_id = c.doc_id and d.idx > c.idx and d.level <= c.level) as closing, lead(level) over (partition by doc_id order by idx) as next_level from c),
e as (select b.*, coalesce((select min(start) from c d where d.doc_id = b.doc_id and d.idx > b.idx and (closing is null or d.idx < closing)), (select min(start) from c d where d.doc_id = b.doc_id and d.idx >= closing and d.level <= b.level)) - 1 as bound from b),
r as (select doc_id, idx as catalog_index, start, coalesce(bound, last) as "end", coalesce(next_level, 0) > level as has_children from e where start is not null),
h as (select r.*, exists (select 1 from t where t.doc_id = r.doc_id and t.line_no between r.start and r."end" and text = 'body') as direct from r)
select doc_id, catalog_index, start, "end", case when not has_children then 'leaf' when direct then 'direct' else 'structural' end as scope, not has_children or direct as extract from h
""")
def mx13_structure_plan(spark, sf_dir):
    """Blocks of a catalog's matched items, with their scope."""
    c = catalog(spark, sf_dir)
    text = F.get(F.array(*map(F.lit, ("", "# h", "body", "![x"))), (F.col("p") % 4).cast("int"))
    return S.structure_plan(c, c.select("doc_id", (F.col("catalog_index") * 10 + 1).alias("line_no"), text.alias("text")))


_RECORDS_SQL = """
with r as (select l_orderkey, l_linenumber, case when l_partkey % 9 = 0 then '' else 'b' || l_partkey end as block_id, case when l_partkey % 7 > 0 then l_partkey % 60 end as start, l_partkey % 60 + l_quantity::bigint - 5 as "end",
             case when l_suppkey % 2 = 0 then l_suppkey % 20 end as ws, case when l_suppkey % 3 = 0 then 70 end as we, case when l_suppkey % 5 > 0 then l_discount * 15 end as confidence, (['concept', 'odd'])[1 + l_partkey % 2] as block_type from lineitem),
f as (select *, concat_ws(',', case when start is null then 'lines' end, case when start < 1 or (start is not null and "end" > 100) then 'bounds' end, case when start > "end" then 'order' end, case when start < ws then 'window start' end,
             case when start is not null and "end" > we then 'window end' end, case when block_id = '' then 'block_id' end, case when coalesce(confidence, 0) > 1 then 'confidence' end) as faults from r)
"""


def _records(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(p % 9 == 0, "").otherwise(F.concat(F.lit("b"), p.cast("string"))).alias("block_id"), F.when(p % 7 > 0, p % 60).alias("start"), (p % 60 + F.col("l_quantity").cast("long") - 5).alias("end"),
        F.when(s % 2 == 0, s % 20).alias("window_start"), F.when(s % 3 == 0, 70).alias("window_end"), F.when(s % 5 > 0, F.col("l_discount") * 15).alias("confidence"),
        F.get(F.array(F.lit("concept"), F.lit("odd")), (p % 2).cast("int")).alias("block_type"), F.array(p % 60, p % 60 + 100, p % 60 + 1).alias("image_lines"),
    )


@query(_RECORDS_SQL + "select l_orderkey, l_linenumber, block_id, faults from f")
def mx12_plan_faults(spark, sf_dir):
    """What is wrong with each plan record."""
    return _records(spark, sf_dir).select("l_orderkey", "l_linenumber", "block_id", F.array_join(S.plan_faults(F.lit(100)), ",").alias("faults"))


@query(_RECORDS_SQL + """
select l_orderkey, l_linenumber, case when block_type = 'odd' then 'unknown' else block_type end as block_type, start::varchar || case when start + 1 <= "end" then ',' || start + 1 else '' end as images from f where faults = ''
""")
def mx12_plan_records(spark, sf_dir):
    """Valid plan records with known types and the images that lie within."""
    out = S.plan_records(_records(spark, sf_dir), F.lit(100))
    return out.select("l_orderkey", "l_linenumber", "block_type", F.array_join(F.array_sort(F.col("image_lines")).cast("array<string>"), ",").alias("images"))


@query("""
with r as (select l_orderkey as k, l_returnflag as flag, l_discount as confidence, l_partkey % 50 as start, l_partkey % 50 + l_quantity::bigint as "end" from lineitem)
select k, flag, arg_max({'c': confidence, 's': start, 'e': "end"}, (confidence, "end" - start, -start)).c as confidence, arg_max(start, (confidence, "end" - start, -start)) as start, arg_max("end", (confidence, "end" - start, -start)) as "end" from r group by 1, 2
""")
def win12_preferred(spark, sf_dir):
    """Of duplicates the most confident, then the longest."""
    s = F.col("l_partkey") % 50
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("flag"), F.col("l_discount").alias("confidence"), s.alias("start"), (s + F.col("l_quantity").cast("long")).alias("end"))
    return S.preferred(rows, ["k", "flag"]).select("k", "flag", "confidence", "start", "end")


@query(_PLAN_SQL + """,
a as (select doc_id, idx, start from c where p % 3 > 0 union all select doc_id, idx, start from c where p % 3 = 2), g as (select doc_id, idx, count(*) as n, max(start) as start from a group by 1, 2)
select c.doc_id, c.idx as catalog_index, case when n is null then 'absent' when n > 1 then 'repeated' else 'revalidate' end as state, case when n = 1 then g.start end as start from c left join g on g.doc_id = c.doc_id and g.idx = c.idx
""")
def sup16_anchor_states(spark, sf_dir):
    """Stored anchors by catalog item: absent, repeated, or to be checked again."""
    c = catalog(spark, sf_dir)
    anchors = c.where("p % 3 > 0").union(c.where("p % 3 = 2")).select("doc_id", "catalog_index", "start")
    return S.anchor_states(anchors, c)


@query("""
select l_orderkey, l_linenumber, l_partkey % 4 = 0 or l_suppkey % 5 = 0 as missing, concat_ws(',', case when l_partkey % 3 = 0 then 'no reason' end, case when l_linenumber % 2 = 0 then 'has a line' end, case when l_suppkey % 2 = 0 then 'has a candidate' end) as faults from lineitem
""")
def sup17_source_missing(spark, sf_dir):
    """Items marked as missing in the source, and what contradicts the mark."""
    p, s, i = (F.col(x) for x in ("l_partkey", "l_suppkey", "l_linenumber"))
    missing = S.source_missing(F.when(p % 4 == 0, "source_missing").when(p % 4 == 1, "matched"), F.when(s % 5 == 0, True), F.lit(None).cast("boolean"))
    faults = S.missing_faults(F.when(p % 3 == 0, " ").otherwise("seen"), F.when(i % 2 == 0, i), F.when(s % 2 == 0, "L1"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", missing.alias("missing"), F.array_join(faults, ",").alias("faults"))


@query(_PLAN_SQL + """
select doc_id, idx as catalog_index from c where start is not null and p % 5 > 0 and (p % 7 = 0 or p % 7 = 1 or p % 11 = 0)
""")
def sup18_to_repair(spark, sf_dir):
    """Matched anchors that agree with their candidate but lack a usable confidence or reason."""
    c, p = catalog(spark, sf_dir), F.col("p")
    name = F.concat(F.lit("L"), F.col("catalog_index").cast("string"))
    anchors = c.select("doc_id", "catalog_index", name.alias("candidate_id"), "start", F.col("start").isNotNull().alias("matched"), F.when(p % 7 == 0, F.lit(None)).when(p % 7 == 1, 1.5).otherwise(0.5).cast("double").alias("confidence"), F.when(p % 11 == 0, "").otherwise("seen").alias("reason"))
    found = c.select("doc_id", name.alias("candidate_id"), F.when(p % 5 > 0, F.col("start")).otherwise(-1).alias("line_no"))
    return S.to_repair(anchors, found).select("doc_id", "catalog_index")


@query(_PLAN_SQL + "select doc_id, count(*) as n_items, count(start) as n_matched, count(*) - count(start) as n_unmatched, coalesce(string_agg(idx::varchar, ',' order by idx) filter (where start is null), '') as unmatched from c group by 1")
def sup19_unmatched_report(spark, sf_dir):
    """Matched and unmatched items of each catalog."""
    none = F.col("start").isNull()
    listed = F.array_join(F.array_sort(F.collect_list(F.when(none, F.col("catalog_index")))).cast("array<string>"), ",")
    return catalog(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.count("start").alias("n_matched"), F.count_if(none).alias("n_unmatched"), listed.alias("unmatched"))


# --- graph audits -------------------------------------------------------------------------------


@query("""
with d as (select n, count(*) as degree from (select 'o' || l_orderkey as n from lineitem union all select 'p' || l_partkey from lineitem) group by 1)
select 'p' || p_partkey as node_id, p_type as entity_type, substring(p_name, 1, 12) || case when length(p_name) > 12 then '...' else '' end as name, coalesce(degree, 0) as degree from part left join d on n = 'p' || p_partkey
""")
def prj5_node_samples(spark, sf_dir):
    """Nodes with their degree, names cut."""
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("s"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("t"))
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"), F.col("p_type").alias("entity_type"), "p_name")
    return G.with_degree(nodes, edges, "node_id", "s", "t").select("node_id", "entity_type", P.source_snippet(F.col("p_name"), 12).alias("name"), "degree")


_IMAGES_SQL = """
with i as (select l_orderkey as chunk, l_linenumber as at, case when l_partkey % 3 = 0 then '' else 'img' || l_partkey % 4 end as path, case when l_suppkey % 2 = 0 then l_suppkey % 5 end as line_no, case when l_partkey % 5 > 1 then 'c' || l_partkey % 5 else '' end as caption,
             case when l_suppkey % 3 = 0 then true when l_suppkey % 3 = 1 then false end as exists_, case when l_partkey % 2 = 0 then 'http://x/' else '' end || l_partkey as url, l_partkey, l_suppkey from lineitem)
"""


def _images(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("chunk"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("at"), F.when(p % 3 == 0, "").otherwise(F.concat(F.lit("img"), (p % 4).cast("string"))).alias("path"),
        F.when(s % 2 == 0, s % 5).alias("line_no"), F.when(p % 5 > 1, F.concat(F.lit("c"), (p % 5).cast("string"))).otherwise("").alias("caption"),
        F.when(s % 3 == 0, True).when(s % 3 == 1, False).alias("exists"), F.concat(F.when(p % 2 == 0, "http://x/").otherwise(""), p.cast("string")).alias("url"),
    )


@query(_IMAGES_SQL + """
select count(distinct chunk) as chunks_with_images, count(*) as total, count(*) filter (where caption <> '') as with_caption, count(*) filter (where caption = '') as missing_caption, count(*) filter (where exists_) as exists_true,
       count(*) filter (where not exists_) as exists_false, count(*) filter (where exists_ is null) as exists_none, count(*) filter (where starts_with(url, 'http')) as remote, count(*) filter (where not starts_with(url, 'http')) as local from i
""")
def agg35_image_audit(spark, sf_dir):
    """Counters of image metadata."""
    return G.image_audit(_images(spark, sf_dir), "chunk")


@query()
def jn21_merged_images(spark, sf_dir):
    """Images of a chunk merged by path or line, in order; empty fields are filled."""
    return G.merged_images(_images(spark, sf_dir), "chunk", ["at"], ["path", "line_no", "caption", "url"])


@query("select o_custkey, count(*) as n, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as items from orders where o_orderstatus = 'F' group by 1")
def agg37_source_missing(spark, sf_dir):
    """Catalog items missing in the source, by book."""
    status = F.when(F.col("o_orderstatus") == "F", "source_missing").otherwise("matched")
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("item"), status.alias("status"))
    items = F.array_join(F.array_sort(F.collect_list("item")).cast("array<string>"), ",").alias("items")
    return rows.where(S.source_missing(F.col("status"))).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), items)


@query("""
with c as (select count(*) filter (where p_size < 5) as pure, count(*) filter (where p_size > 100) as url, count(*) filter (where p_size > 25)::double / count(*) as covered, count(*) filter (where p_size = 7) as missing from part)
select unnest(list_filter([case when pure > 0 then 'no figure entities' end, case when url > 0 then 'addresses out of contents' end, case when covered < 0.5 then 'more captions' end, case when missing > 0 then 'complete the sources' end], lambda x: x is not null)) as advice from c
""")
def agg39_recommendations(spark, sf_dir):
    """Advice that follows from counts."""
    size = F.col("p_size")
    counts = table(spark, sf_dir, "part").agg(F.count_if(size < 5).alias("pure"), F.count_if(size > 100).alias("url"), (F.count_if(size > 25) / F.count(F.lit(1))).alias("covered"), F.count_if(size == 7).alias("missing"))
    rules = [(F.col("pure") > 0, "no figure entities"), (F.col("url") > 0, "addresses out of contents"), (F.col("covered") < 0.5, "more captions"), (F.col("missing") > 0, "complete the sources")]
    return A.advice(counts, rules, "nothing to do")


@query("select count(*) as n_chunks, sum(len(string_split(p_name, ' ')))::bigint as n_entities, sum(p_size % 3)::bigint as n_relations from part")
def agg41_mention_counts(spark, sf_dir):
    """Entities and relations mentioned in extractions."""
    rows = table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("entities"), F.filter(F.array(F.lit(1), F.lit(2)), lambda x: x <= F.col("p_size") % 3).alias("relations"))
    return rows.agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.size("entities")).alias("n_entities"), F.sum(F.size("relations")).alias("n_relations"))


@query("select p_partkey as chunk_id, substring(p_name, 1, 5) as head, length(p_name)::bigint as n_chars, 'E' || p_size % 7 as error from part where p_size % 4 = 0")
def agg42_failed_chunks(spark, sf_dir):
    """Rows of chunks that failed."""
    error = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("E"), (F.col("p_size") % 7).cast("string")))
    rows = table(spark, sf_dir, "part").withColumn("error", error).where("error is not null")
    return rows.select(F.col("p_partkey").alias("chunk_id"), F.substring("p_name", 1, 5).alias("head"), F.char_length("p_name").cast("long").alias("n_chars"), "error")


@query("""
with p as (select p_partkey as pos, case when p_size % 10 = 0 then '' else p_name end as content, case when p_size % 4 = 0 then null else p_brand end as brand, p_partkey // 2 as id from part)
select pos, 'missing content' as problem from p where trim(content) = '' union all select pos, 'missing brand' from p where brand is null
union all select pos, 'repeats ' || min(pos) over (partition by id) from p qualify pos > min(pos) over (partition by id)
""")
def agg22_chunk_contract(spark, sf_dir):
    """What breaks the contract of chunks: missing fields, repeated ids."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.when(F.col("p_size") % 10 == 0, "").otherwise(F.col("p_name")).alias("content"), F.when(F.col("p_size") % 4 > 0, F.col("p_brand")).alias("brand"), F.floor(F.col("p_partkey") / 2).alias("id"))
    return A.violations(p, "id", "pos", ["content", "brand"], {})


@query("""
select count(*) as n_chunks, count(*) filter (where length(text) > 0) as with_content, count(*) filter (where contains(text, 'the ')) as with_word, count(*) filter (where regexp_matches(text, '[0-9]')) as with_digits, sum(n_chars)::bigint as n_chars from documents
""")
def agg18_presence(spark, sf_dir):
    """Counters of what chunks have."""
    return A.presence(table(spark, sf_dir, "documents"), {"with_content": F.char_length("text") > 0, "with_word": F.contains("text", F.lit("the ")), "with_digits": F.rlike("text", F.lit("[0-9]"))}, "n_chars")


@query("""
select o_custkey as k, count(distinct o_orderstatus) as n_chapters, count(distinct o_orderstatus || '/' || o_orderpriority) as n_sections, count(*) as n_items from orders group by 1
""")
def agg19_nested_counts(spark, sf_dir):
    """Chapters, sections and items of nested books."""
    sections = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus", "o_orderpriority").agg(F.collect_list("o_orderkey").alias("items"))
    chapters = sections.groupBy("o_custkey", "o_orderstatus").agg(F.collect_list(F.struct("o_orderpriority", "items")).alias("sections"))
    books = chapters.groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list(F.struct("o_orderstatus", "sections")).alias("chapters"))
    return books.select("k", *[c.cast("long").alias(n) for n, c in zip(("n_chapters", "n_sections", "n_items"), A.nested_sizes("chapters", "sections", "items"), strict=True)])


@query("""
with q as (select p_partkey, lower(p_name) as label from part), n as (select lower(p_name) as label, min(p_partkey) as node_id, count(*) as n_same from part where p_size > 10 group by 1)
select p_partkey, n.node_id, coalesce(n_same, 0) as n_same, n.node_id is null as failed from q left join n using (label)
""")
def sup44_label_lookup(spark, sf_dir):
    """Labels looked up without case; those not found count as failed."""
    part = table(spark, sf_dir, "part")
    nodes = part.where("p_size > 10").select(F.upper("p_name").alias("label"), F.col("p_partkey").alias("node_id"))
    return G.by_label(part.select("p_partkey", "p_name"), "p_name", nodes).select("p_partkey", "node_id", "n_same", "failed")


@query("""
with e as (select 'p' || p_partkey as id, 'b' || p_brand as book, 'p' || (p_partkey + 1) as target from part)
select id, target from e where contains(lower(book), 'brand#1') or id in (select id from e where contains(lower(book), 'brand#1')) or target in (select id from e where contains(lower(book), 'brand#1'))
""")
def fil12_book_edges(spark, sf_dir):
    """Edges of a book, by a part of its name or at a node of it."""
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"), F.concat(F.lit("b"), "p_brand").alias("book"), F.concat(F.lit("p"), (F.col("p_partkey") + 1).cast("string")).alias("target"))
    return G.select_book(rows.select("node_id", "book"), rows.select(F.col("node_id").alias("source"), "target", "book"), ["book"], "Brand#1")[1].select(F.col("source").alias("id"), "target")


# --- retrieval ----------------------------------------------------------------------------------

_CONCEPTS_SQL = r"""
with c as (select p_partkey as pos, p_name as name, p_type as kind from part where p_partkey % 3 = 0),
q as (select p_partkey as query_id, case when p_partkey % 2 = 0 then 'tell me of ' || lower(p_name) else 'no such thing' end as q from part),
e as (select p_partkey as query_id, r as rank, p_partkey + r as of, case when r = 1 then 'OTHER' else 'CONCEPT' end as type from part, range(1, 5) t(r)),
x as (select query_id, min(pos) as pos from q, c where contains(q, lower(name)) group by 1),
g as (select query_id, arg_min(p_name, rank) as name from e join part on p_partkey = of where type = 'CONCEPT' and p_name in (select name from c) group by 1)
"""


@query(_CONCEPTS_SQL + "select query_id, name from g")
def jn10_typed_entities(spark, sf_dir):
    """The first retrieved entity of a type that counts and with a known concept."""
    return R.typed_entity(_entities(spark, sf_dir), _concepts(spark, sf_dir).select("name").distinct(), ["CONCEPT"]).select("query_id", "name")


def _concepts(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("alias"))


def _entities(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    hits = part.select(F.col("p_partkey").alias("query_id"), F.posexplode(F.array(*[F.col("p_partkey") + i for i in (1, 2, 3, 4)])).alias("p", "of"))
    named = hits.join(part.select(F.col("p_partkey").alias("of"), F.col("p_name").alias("entity_name")), "of")
    return named.select("query_id", (F.col("p") + 1).cast("long").alias("rank"), "entity_name", F.when(F.col("p") == 0, "OTHER").otherwise("CONCEPT").alias("entity_type"))


@query(_CONCEPTS_SQL + """
select q.query_id, coalesce(c.name, g.name) as name, case when c.name is not null then 1.0 when g.name is not null then 0.9 else 0.0 end::double as confidence,
       case when c.name is not null then 'name_in_query' when g.name is not null then 'entity_hit' else 'not_found' end as reason
from q left join x on x.query_id = q.query_id left join c on c.pos = x.pos left join g on g.query_id = q.query_id
""")
def ret11_concept_cascade(spark, sf_dir):
    """Concepts by name in the question, else by retrieved entity, else a miss."""
    k = F.col("p_partkey")
    queries = table(spark, sf_dir, "part").select(k.alias("query_id"), F.when(k % 2 == 0, F.concat(F.lit("tell me of "), F.lower("p_name"))).otherwise("no such thing").alias("q"))
    return R.concept_cascade(queries, "query_id", "q", _concepts(spark, sf_dir), _entities(spark, sf_dir), ["CONCEPT"], Scratch(spark, "ret11"))


@query("""
with t as (select user_id, event_type as method, max(value) as top, count(*) as n from events group by 1, 2)
select method, count(*) as n_queries, round(avg((n > 3)::int), 6) as success_rate, min(top) as min_top, max(top) as max_top, round(sum(top::decimal(18,6))::double / count(*), 6) as avg_top from t group by 1
""")
def ret12_score_assessment(spark, sf_dir):
    """Top scores and success of each method."""
    tops = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("method")).agg(F.max("value").alias("top"), (F.count(F.lit(1)) > 3).alias("success"))
    return R.assessment(tops, "method", "top", "success")


@query("select user_id as query_id, max(value) as best, max(value) < 120 as low from events group by 1")
def ret18_low_relevance(spark, sf_dir):
    """Questions whose best result is not relevant enough."""
    return R.low_relevance(table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("value").alias("score")), "query_id", "score", 120.0)


@query("""
with h as (select user_id as query_id, event_id as doc, row_number() over (partition by user_id order by event_id) as rank from events),
s as (select *, case when doc % 3 > 0 then round(doc % 17 * 0.1, 6) else -10.0 end as rerank_score from h where rank <= 10),
r as (select *, row_number() over (partition by query_id order by rerank_score desc, doc) as new_rank from s)
select query_id, doc, rerank_score::double as rerank_score, new_rank as rank from r where new_rank <= 3
""")
def ret7_reranked(spark, sf_dir):
    """Hits in the order of outside scores; a pair without one comes last (RET7, RET8)."""
    w = Window.partitionBy("query_id").orderBy("doc")
    hits = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("doc"))
    hits = hits.withColumn("rank", F.row_number().over(w)).where("rank <= 10")
    scores = hits.where("doc % 3 > 0").select("query_id", "doc", F.round(F.col("doc") % 17 * 0.1, 6).alias("score"))
    return R.rerank(hits, scores, "doc", 3).select("query_id", "doc", "rerank_score", "rank")


@query("""
with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as i from events)
select user_id, event_id, round(greatest(0.5, 0.9 - 0.1 * i)::double, 6) as score from r where i < 5
""")
def ret19_decayed(spark, sf_dir):
    """Scores that fall with the rank, of the first five."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.row_number().over(w) - 1).alias("i")).where("i < 5")
    return rows.select("user_id", "event_id", F.round(R.decayed(F.col("i")), 6).alias("score"))


@query("""
with w as (select user_id, event_type, sum(value::decimal(18,6))::double / count(*) / 100 as mean from events group by 1, 2)
select user_id, event_type, round(case event_type when 'click' then 0.98 when 'view' then 0.99 else case when user_id % 2 = 0 then greatest(0.75, mean) else 0.8 end end, 6) as confidence from w
""")
def agg43_confidence(spark, sf_dir):
    """The confidence of an answer by its kind and its web results."""
    means = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg((A.exact_mean("value") / 100).alias("mean"))
    label = F.when(F.col("event_type") == "click", "greeting").when(F.col("event_type") == "view", "noise").otherwise("web")
    return means.select("user_id", "event_type", F.round(R.answer_confidence(label, F.when(F.col("user_id") % 2 == 0, F.col("mean"))), 6).alias("confidence"))


# --- pages and windows --------------------------------------------------------------------------


@query("select conv_id, turn, role from conversations order by turn, conv_id, role limit 20 offset 20")
def win2_ascending_page(spark, sf_dir):
    """The second page of turns, the oldest first."""
    return L.page(table(spark, sf_dir, "conversations"), [F.col("turn"), F.col("conv_id"), F.col("role")], 2, 20).select("conv_id", "turn", "role")


@query("""
with c as (select doc_id, n_chars, row_number() over (order by doc_id) as r, count(*) over () as total, count(*) filter (where n_chars > 500) over () as n_long from documents)
select doc_id, total, n_long from c where r between 11 and 20
""")
def win5_page_with_summary(spark, sf_dir):
    """One page of chunks, with counts over all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    totals = docs.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n_chars") > 500).alias("n_long"))
    return L.page(docs, [F.col("doc_id")], 2, 10).join(F.broadcast(totals)).select("doc_id", "total", "n_long")  # totals are one row


@query("select event_id, ts from events order by ts desc, event_id desc limit 10")
def win6_newest(spark, sf_dir):
    """The ten newest rows (WIN6, WIN11)."""
    return L.page(table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], 1, 10).select("event_id", "ts")


@query("select doc_id, quality, case when doc_id % 2 = 0 then 'second' else 'first' end as source from labels union all select doc_id, quality, 'again' from labels where toxic = 1")
def set4_appended_windows(spark, sf_dir):
    """Records of overlapping windows appended, duplicates and all."""
    rows = table(spark, sf_dir, "labels")
    first = rows.where("doc_id % 2 = 1").select("doc_id", "quality", F.lit("first").alias("source"))
    second = rows.where("doc_id % 2 = 0").select("doc_id", "quality", F.lit("second").alias("source"))
    return first.unionByName(second).unionByName(rows.where("toxic = 1").select("doc_id", "quality", F.lit("again").alias("source")))


@query("select event_type, user_id, count(*) as n, sum(value::decimal(18,6))::double as total from events group by cube (event_type, user_id)")
def agg_cube(spark, sf_dir):
    """Counts over all combinations of two keys."""
    return table(spark, sf_dir, "events").cube("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total"))


@query("select o_orderstatus, o_orderpriority, grouping(o_orderpriority)::int as level, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")
def agg_rollup(spark, sf_dir):
    """Counts with subtotals."""
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderpriority").cast("int").alias("level"), F.count(F.lit(1)).alias("n"))


@query("select event_type, count(distinct user_id) > 0 as some, true as near from events group by 1")
def agg_approximate_distinct(spark, sf_dir):
    """Distinct users from a mergeable sketch, within 10 % of the exact count."""
    events = table(spark, sf_dir, "events").select("event_type", "user_id")
    # apart: beside an exact count of distinct values, Spark would keep a sketch for each user
    about = events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("about"))
    exact = events.distinct().groupBy(F.col("event_type").alias("of")).agg(F.count("user_id").alias("n"))
    rows = about.join(exact, F.col("event_type").eqNullSafe(F.col("of")))
    return rows.select("event_type", (F.col("about") > 0).alias("some"), (F.abs(F.col("about") - F.col("n")) <= F.greatest(F.lit(1), F.col("n") * 0.1)).alias("near"))


@query("""
select s_suppkey, ntile(4) over (partition by s_nationkey order by s_acctbal, s_suppkey)::int as quarter, round(percent_rank() over (partition by s_nationkey order by s_acctbal), 6) as share, round(cume_dist() over (partition by s_nationkey order by s_acctbal), 6) as below from supplier
""")
def win_ranking(spark, sf_dir):
    """Quarters, percent ranks and cumulative shares."""
    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.ntile(4).over(Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("share"), F.round(F.cume_dist().over(w), 6).alias("below"))


@query("select coalesce(s_nationkey, c_nationkey) as nation, n_suppliers, n_customers from (select s_nationkey, count(*) as n_suppliers from supplier where s_nationkey % 2 = 0 group by 1) full join (select c_nationkey, count(*) as n_customers from customer where c_nationkey % 3 = 0 group by 1) on s_nationkey = c_nationkey")
def jn_full_outer(spark, sf_dir):
    """Counts of two tables side by side, each nation of either."""
    s = table(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    c = table(spark, sf_dir, "customer").where("c_nationkey % 3 = 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n_customers"))
    return s.join(c, "nation", "full").select("nation", "n_suppliers", "n_customers")


@query("""
with w as (select ts, event_type, value, unnest([0, 1, 2, 3]) as i from events),
s as (select time_bucket(interval 15 minute, ts) - i * interval 15 minute as start, event_type, value from w)
select start, start + interval 1 hour as "end", event_type, count(*) as n, round(sum(value), 4) as total from s group by all
""")
def str_sliding_windows(spark, sf_dir):
    """Windows of an hour that start every quarter of one."""
    from ..streaming import streams

    out = streams.tumbling(table(spark, sf_dir, "events"), "ts", "event_type", "value", "1 hour", "10 minutes", "15 minutes")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))
