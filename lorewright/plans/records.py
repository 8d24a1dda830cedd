"""Projections, record rules, whitelists and graph audits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import graph as G
from ..operators import records as P
from ..operators import windows as W
from ..session import table
from .registry import query


@query("select c_custkey, case when c_nationkey % 2 = 0 then c_nationkey::varchar || ',' || c_custkey::varchar else c_custkey::varchar end as ids from customer")
def prj1_enabled_ids(spark, sf_dir):
    """Enabled dataset ids of a nested record."""
    entry = lambda i, e: F.struct(F.col(i).cast("long").alias("id"), e.cast("int").alias("enabled"))
    datasets = F.array(entry("c_nationkey", F.col("c_nationkey") % 2 == 0), entry("c_custkey", F.lit(True)))
    return table(spark, sf_dir, "customer").select("c_custkey", P.comma_joined(P.enabled_ids(datasets)).alias("ids"))


@query("select doc_id, substring(text, 1, 120) as head, length(text) as n from documents")
def prj3_preview(spark, sf_dir):
    """Beginning and length."""
    return table(spark, sf_dir, "documents").select("doc_id", P.preview(F.col("text")).alias("p")).select("doc_id", "p.head", F.col("p.n_chars").cast("long").alias("n"))


@query("select l_orderkey, l_linenumber, case when l_partkey % 3 > 0 then array_to_string(range(l_partkey % 3, l_partkey % 3 + 3), ',') else '' end as pages from lineitem")
def prj6_page_ranges(spark, sf_dir):
    """Page ranges as arrays."""
    start = F.col("l_partkey") % 3
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(P.page_range(start, start + 2).cast("array<string>"), ",").alias("pages"))


@query("""
with q as (select o_custkey as k, o_orderkey, o_orderpriority, o_orderstatus, row_number() over (partition by o_custkey order by o_orderstatus, o_orderpriority, o_orderkey) - 1 as i from orders)
select k, i as chunk_index, o_orderstatus || '/' || o_orderpriority as path, 'q' || o_orderkey || chr(10) || 'a' || o_orderkey as content from q
""")
def prj7_qa_chunks(spark, sf_dir):
    """Nested questions and answers as chunks with a running index."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("string").alias("o"), "o_orderkey")
    qa = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: F.struct(F.concat(F.lit("q"), x.cast("string")).alias("question"), F.concat(F.lit("a"), x.cast("string")).alias("answer")))
    sections = rows.groupBy("k", "o_orderstatus", "o_orderpriority").agg(qa.alias("qa"))
    chapters = sections.groupBy("k", "o_orderstatus").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderpriority").alias("title"), "qa"))).alias("sections"))
    books = chapters.groupBy("k").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderstatus").alias("title"), "sections"))).alias("chapters"))
    return P.qa_chunks(books, "k").select("k", "chunk_index", F.array_join("title_path", "/").alias("path"), "content")


@query("select doc_id, source || ' > ' || lang || chr(10) || chr(10) || text as out from documents")
def prj9_embedding_text(spark, sf_dir):
    """Title path before the content."""
    return table(spark, sf_dir, "documents").select("doc_id", P.embedding_text(F.array("source", "lang"), F.col("text")).alias("out"))


@query("select p_partkey, p_name || ' ' || p_brand || ' ' || p_type || ' x' as out from part")
def prj10_index_text(spark, sf_dir):
    """Text that is indexed for a word and its similar words."""
    return table(spark, sf_dir, "part").select("p_partkey", P.index_text(F.col("p_name"), F.col("p_brand"), F.array(F.col("p_type"), F.lit("x"))).alias("out"))


@query("select doc_id, case when length(text) > 200 then substring(text, 1, 200) || '...' else text end as out from documents")
def prj12_snippets(spark, sf_dir):
    """Snippets of sources."""
    return table(spark, sf_dir, "documents").select("doc_id", P.source_snippet(F.col("text")).alias("out"))


@query("select p_partkey, case when p_size % 2 = 0 then p_name else 'file' || p_partkey end as out from part")
def prj13_concept_names(spark, sf_dir):
    """Names by their fallback chain."""
    name = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(" ")
    file = F.concat(F.lit("a/b/file"), F.col("p_partkey").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "part").select("p_partkey", P.concept_name(name, F.lit(""), F.lit("no heading"), file).alias("out"))


@query("""
select doc_id from documents where doc_id % 2 = 0 and contains(lower(source || ' ' || lang), 'src1') order by doc_id limit 30 offset 5
""")
def fil10_selected_chunks(spark, sf_dir):
    """Chunk selection by flag, field and offset."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.col("doc_id") % 2 == 0).alias("extractable"))
    return P.selected_chunks(rows, ["source", "lang"], "SRC1", 5, 30, [F.col("doc_id")]).select("doc_id")


@query(r"""select distinct w from (select unnest(string_split(text, ' ')) as w from documents) where length(w) between 2 and 8 and not regexp_matches(w, '[0-9\s$\\/_=+*^<>(){}\[\]|#@&%~`.,;:!?''"-]')""")
def fil11_plain_entities(spark, sf_dir):
    """Names that may be entities."""
    words = table(spark, sf_dir, "documents").select(F.explode_outer(F.split("text", " ")).alias("w"))
    return words.where(P.plain_entity(F.col("w"))).distinct()


@query("select p_type as name, min(p_partkey) as pos from part group by 1")
def sup14_whitelist(spark, sf_dir):
    """Distinct names by first appearance."""
    return P.first_seen(table(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("pos")), "name", "pos")


@query("select event_id, 'wind ' || (event_id % 7)::varchar || case when event_id % 2 = 0 then ', rain 1' else '' end as out from events")
def sup4_weather_row(spark, sf_dir):
    """A record as text, without missing fields."""
    return table(spark, sf_dir, "events").select("event_id", P.weather_row(("wind", F.col("event_id") % 7), ("rain", F.when(F.col("event_id") % 2 == 0, F.lit(1))), ("snow", F.lit(None))).alias("out"))


@query("""
with s as (select o_custkey, count(*) as n_chunks, sum(length(o_orderpriority)) as n_content from orders group by 1)
select c_custkey as doc_id, n_name, coalesce(n_chunks, 0) as n_chunks, coalesce(n_content, 0)::bigint as n_content from customer left join nation on n_nationkey = c_nationkey left join s on o_custkey = c_custkey
""")
def sup5_document_detail(spark, sf_dir):
    """Documents with their base and chunk statistics."""
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("kb_id"))
    kb = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("kb_id"), "n_name")
    chunks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("content"))
    return P.document_detail(docs, kb, chunks).select("doc_id", "n_name", "n_chunks", "n_content")


@query("""
select p_partkey::varchar as file, p_brand || case when row_number() over (partition by p_brand, p_size order by p_partkey::varchar) > 1 then '_' || (row_number() over (partition by p_brand, p_size order by p_partkey::varchar) - 1)::varchar else '' end || '.' || p_size::varchar as new_name from part
""")
def sup31_numbered_names(spark, sf_dir):
    """File names made unique."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file"), F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("ext"))
    return P.numbered_names(rows, "name", "ext", "file")


@query("""
with m as (select conv_id, arg_max(text, (turn, role)) filter (where role = 'user') as u, arg_max(text, (turn, role)) as l from conversations group by 1)
select conv_id, coalesce(u, l, '') as message from m
""")
def sup33_last_user_message(spark, sf_dir):
    """The last user message of a list."""
    return P.last_user_messages(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role"], "role", "text")


@query("""
select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id from events where value > 20 group by 1, 2
""")
def sup26_latest_runs(spark, sf_dir):
    """The latest completed run of each key."""
    rows = table(spark, sf_dir, "events").withColumn("status", F.when(F.col("value") > 20, "completed").otherwise("failed"))
    return P.latest_runs(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], ["event_id"])


@query("select event_id, coalesce(json_extract_string(props, '$.k')::varchar, '') as k from events")
def sup32_payload_field(spark, sf_dir):
    """A field of a JSON payload."""
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"))


@query("""
select count(*) as n_nodes, count(*) filter (where trim(p_type) = '') as missing_source, count(*) filter (where p_size % 5 = 0) as missing_path, count(*) filter (where p_partkey % 7 = 0) as missing_description from part
""")
def agg34_evidence(spark, sf_dir):
    """Nodes without evidence."""
    rows = table(spark, sf_dir, "part").select(
        F.col("p_type").alias("source_id"), F.when(F.col("p_size") % 5 != 0, "path").alias("file_path"), F.when(F.col("p_partkey") % 7 == 0, " ").otherwise("text").alias("description")
    )
    return G.evidence(rows)


@query("""
with t as (select case when p_size % 4 = 0 then '' when p_size % 4 = 1 then 'concept' when p_size % 4 = 2 then 'figure' else 'other' end as t from part)
select case when t = '' then 'unknown' when t = 'concept' then 'allowed' when t = 'figure' then 'forbidden' else 'invalid' end as state, count(*) as n from t group by 1
""")
def agg33_schema_audit(spark, sf_dir):
    """Nodes by the state of their type."""
    m = F.col("p_size") % 4
    rows = table(spark, sf_dir, "part").select(F.when(m == 0, "").when(m == 1, " Concept").when(m == 2, "figure").otherwise("other").alias("entity_type"))
    return G.schema_audit(rows, ["concept"], ["figure"])


@query("""
select round_even(greatest(0, 100 - least(20, count(*) filter (where p_size < 5) * 0.2) - least(10, count(*) filter (where p_size > 45) * 0.5)), 2) as score from part
""")
def agg38_quality_score(spark, sf_dir):
    """Quality score from capped penalties."""
    counts = table(spark, sf_dir, "part").agg(F.count_if(F.col("p_size") < 5).alias("pure_figure"), F.count_if(F.col("p_size") > 45).alias("step"))
    return counts.select(A.quality_score({c: F.col(c) for c in counts.columns}).alias("score"))


@query("""
select lower(p_brand) as entity, array_to_string(list_sort(list_distinct(list(p_type))), ',') as sources, count(*) as mentions from part group by 1
""")
def sup43_merged_extractions(spark, sf_dir):
    """Entities merged over their mentions."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("entity"), F.array("p_type").alias("sources"))
    return G.merge_extractions(rows).select("entity", F.array_join("sources", ",").alias("sources"), "mentions")


@query("""
select p_partkey, case when p_size % 3 = 0 then 'explicit' when p_size % 3 = 1 then 'uses' else 'part_of' end as relation from part
""")
def st44_relation_type(spark, sf_dir):
    """Relation of an edge by its fallback chain."""
    m = F.col("p_size") % 3
    explicit, words = F.when(m == 0, "explicit").otherwise(""), F.when(m == 1, "odd, uses").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", G.relation_type(explicit, words, F.lit("it is part_of x"), ["uses", "part_of", "is"]).alias("relation"))


@query("""

select p_partkey, p_name from part where p_type in (select p_type from part group by 1 having count(*) > 1)
""")
def set5_whitelisted(spark, sf_dir):
    """Entities of a whitelist."""
    rows = table(spark, sf_dir, "part")
    allowed = rows.groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("p_type")
    return rows.join(allowed, "p_type", "left_semi").select("p_partkey", "p_name")


@query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents where doc_id < 100000000),
m as (select *, sum(case when regexp_matches(line, '^[A-Z]') then 1 else 0 end) over (partition by doc_id order by line_no) as record from l)
select doc_id, record, md5(string_agg(line, chr(10) order by line_no)) as entry_md5 from m where record > 0 group by 1, 2
""")
def src14_log_records(spark, sf_dir):
    """Lines put together to records."""
    from ..sources.readers import numbered_lines

    lines = numbered_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = W.gaps_and_islands(lines, "doc_id", "line_no", F.rlike("line", F.lit("^[A-Z]")), "line")
    return out.select("doc_id", "record", F.md5("entry").alias("entry_md5"))


@query("""
with n as (select conv_id, turn, case when turn % 3 = 0 then '' else 'x' end as t from conversations)
select conv_id, turn, (select turn from n p where p.conv_id = c.conv_id and p.t <> '' and abs(p.turn - c.turn) <= 5 order by abs(p.turn - c.turn), p.turn limit 1) as near from n c
""")
def win20_nearest_line(spark, sf_dir):
    """The nearest non-empty line."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "").otherwise("x").alias("t"))
    return W.nearest_filled(rows, "conv_id", "turn", "t", 5).select("conv_id", "turn", "near")
