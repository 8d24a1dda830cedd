"""Readers and sinks: tables written as files of each format in the shared scratch folder, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mutate as M
from ..scratch import Scratch
from ..session import table
from ..sources import readers as R
from ..sources import sinks as S
from .registry import query

TABLES = ("customer", "documents", "events", "labels", "lineitem", "nation", "orders", "part", "region", "supplier")


def put(files: DataFrame, scratch: Scratch, name: str) -> str:
    """(file, text): one text file for each row, in a folder named after it."""
    files.select("file", F.col("text").alias("value")).write.mode("overwrite").partitionBy("file").text(scratch.path(name))
    return scratch.path(name)


def by_nation(rows: DataFrame, line, sep: str = "\n", before: str = "", after: str = "") -> DataFrame:
    """(file, text): the customers of each nation (a fixed number of files), in order of their keys."""
    lines = F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line"))))
    text = F.concat(F.lit(before), F.array_join(F.transform(lines, lambda x: x["line"]), sep), F.lit(after))
    return rows.groupBy(F.col("c_nationkey").alias("file")).agg(text.alias("text"))


def customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def file_number(path: str = "file"):
    return F.regexp_extract(path, r"file=(\d+)", 1).cast("int")


def record():
    return F.to_json(F.struct("c_custkey", "c_name"))


@query("""
with l as (select c_nationkey as file, c_custkey, c_name, row_number() over (partition by c_nationkey order by c_custkey) as line_no from customer)
select file, line_no, case when c_custkey % 7 = 0 then 'no JSON' when c_custkey % 11 = 0 then 'no object' end as problem,
       case when c_custkey % 7 <> 0 and c_custkey % 11 <> 0 then c_name end as c_name from l where c_custkey % 13 <> 0 or c_custkey % 7 = 0 or c_custkey % 11 = 0
""")
def src1_jsonl_problems(spark, sf_dir):
    """JSON lines with what is wrong, by line; blank lines count but are left out."""
    k = F.col("c_custkey")
    line = F.when(k % 7 == 0, "{broken").when(k % 11 == 0, "[1, 2]").when(k % 13 == 0, "  ").otherwise(record())
    path = put(by_nation(customers(spark, sf_dir), line), Scratch(spark, "src1"), "files")
    rows = R.jsonl_problems(R.file_lines(spark, path), "c_custkey long, c_name string")
    return rows.select(file_number().alias("file"), F.col("line_no").cast("long").alias("line_no"), "problem", F.col("record.c_name").alias("c_name"))


@query("select c_custkey, c_name from customer where c_custkey % 5 <> 0")
def src2_tolerant_jsonl(spark, sf_dir):
    """JSON lines, bad ones skipped."""
    line = F.when(F.col("c_custkey") % 5 == 0, "{broken").otherwise(record())
    return R.jsonl(spark, put(by_nation(customers(spark, sf_dir), line), Scratch(spark, "src2"), "files"), "c_custkey long, c_name string").drop("file")


@query("select c_custkey, c_name from customer")
def src2_wrapped_lists(spark, sf_dir):
    """JSON files that are a list, or hold one under any of several keys."""
    files = by_nation(customers(spark, sf_dir), record(), ",\n", "[", "]")
    wrapper = F.get(F.array(*map(F.lit, R.WRAPPERS)), (F.col("file") % 5 - 1).cast("int"))
    text = F.when(F.col("file") % 5 == 0, F.col("text")).otherwise(F.concat(F.lit('{"'), wrapper, F.lit('": '), F.col("text"), F.lit("}")))
    return R.wrapped_json(spark, put(files.select("file", text.alias("text")), Scratch(spark, "src2w"), "files"), "c_custkey long, c_name string")


@query("select c_custkey, c_name, case when c_custkey % 3 = 0 then 'correct' end as review_status from customer")
def src3_review_rows(spark, sf_dir):
    """Records for review: the status defaults to null, a stored index goes."""
    status = F.when(F.col("c_custkey") % 3 == 0, "correct")
    line = F.to_json(F.struct("c_custkey", "c_name", status.alias("review_status"), F.lit(7).alias("index")))
    return R.review_rows(spark, put(by_nation(customers(spark, sf_dir), line), Scratch(spark, "src3"), "files"), "c_custkey long, c_name string").drop("file")


@query("""
with l as (select c_nationkey as file, c_custkey, c_name, row_number() over (partition by c_nationkey order by c_custkey) as line_no from customer)
select file, line_no, c_name as before, 'a' || c_custkey as after from l where c_custkey % 4 > 1
""")
def src4_samples(spark, sf_dir):
    """Samples with a text before, and their line."""
    k = F.col("c_custkey")
    before = F.when(k % 4 == 0, "  ").when(k % 4 == 1, F.lit(None)).otherwise(F.col("c_name"))
    line = F.to_json(F.struct(before.alias("before"), F.concat(F.lit("a"), k.cast("string")).alias("after")))
    rows = R.samples(R.file_lines(spark, put(by_nation(customers(spark, sf_dir), line), Scratch(spark, "src4"), "files")))
    return rows.select(file_number().alias("file"), F.col("line_no").cast("long").alias("line_no"), "before", "after")


@query("select n_nationkey::bigint as id, n_name as name, 'x,' || n_name as tags from nation")
def src5_json_files(spark, sf_dir):
    """One JSON object of several lines in each file."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.array(F.lit("x"), "n_name").alias("tags"))
    scratch = Scratch(spark, "src5")
    S.write_pretty(rows, scratch.path("files"))
    return spark.read.schema("id long, name string, tags array<string>").option("multiLine", True).json(scratch.path("files")).withColumn("tags", F.array_join("tags", ","))


@query("select 'there' as name, 1 as n union all select 'corrupt', 0 union all select 'missing', 0")
def src6_optional_json(spark, sf_dir):
    """A file that is missing or corrupt counts as missing."""
    scratch = Scratch(spark, "src6")
    spark.createDataFrame([("0", '{"a": 1}')], "file string, text string").coalesce(1).select("text").write.text(scratch.path("there"))
    spark.createDataFrame([("0", '{"a": ')], "file string, text string").coalesce(1).select("text").write.text(scratch.path("corrupt"))
    out = None
    for name in ("there", "corrupt", "missing"):
        names = [r.path for r in spark.read.format("binaryFile").load(scratch.path(name)).select("path").collect()] if name != "missing" else [scratch.path("there") + "/no.json"]  # one file each
        n = R.optional_json(spark, names[0], "a int").agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.union(n)
    return out


@query("select c_custkey::varchar as key, c_name, c_acctbal from customer")
def src7_keyed_records(spark, sf_dir):
    """Objects of objects as rows, below ``data`` or not (SRC7, SRC8)."""
    entry = F.concat(F.lit('"'), F.col("c_custkey").cast("string"), F.lit('": '), F.to_json(F.struct("c_name", "c_acctbal")))
    files = by_nation(customers(spark, sf_dir), entry, ",", "{", "}")
    text = F.when(F.col("file") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit('{"data": '), F.col("text"), F.lit("}")))
    path = put(files.select("file", text.alias("text")), Scratch(spark, "src7"), "files")
    return R.keyed_json(spark, path, "c_name string, c_acctbal double").select(F.col("_key").alias("key"), "c_name", "c_acctbal")


@query("select 'node' as kind, 'n' || n_nationkey as a, '' as b, n_name as label from nation union all select 'edge', 'n' || n_nationkey, 'r' || n_regionkey, 'in' from nation")
def src9_graphml(spark, sf_dir):
    """Nodes and edges of a GraphML file."""
    rows = table(spark, sf_dir, "nation")
    node = F.concat(F.lit('<node id="n'), F.col("n_nationkey").cast("string"), F.lit('"><data key="d0">'), F.col("n_name"), F.lit("</data></node>"))
    edge = F.concat(F.lit('<edge source="n'), F.col("n_nationkey").cast("string"), F.lit('" target="r'), F.col("n_regionkey").cast("string"), F.lit('"><data key="d0">in</data></edge>'))
    parts = rows.agg(F.array_join(F.collect_list(node), "\n").alias("n"), F.array_join(F.collect_list(edge), "\n").alias("e"))  # the nations of the world
    text = F.concat(F.lit('<?xml version="1.0"?>\n<graphml><graph>\n'), F.col("n"), F.lit("\n"), F.col("e"), F.lit("\n</graph></graphml>"))
    nodes, edges = R.graphml(spark, put(parts.select(F.lit(0).alias("file"), text.alias("text")), Scratch(spark, "src9"), "files"))
    label = F.try_element_at("attributes", F.lit("d0")).alias("label")
    return nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.lit("").alias("b"), label).union(edges.select(F.lit("edge"), "source", "target", label))


@query("""
with i as (select l_orderkey, case when l_partkey % 3 > 0 then 'image' else 'text' end as type, 'img' || l_partkey % 5 || '.png' as img_path, l_linenumber from lineitem),
n as (select *, row_number() over (partition by l_orderkey order by l_linenumber, type, img_path) - 1 as page from i)
select l_orderkey as doc, img_path, max(page)::bigint as page from n where type = 'image' group by 1, 2
""")
def src12_image_assets(spark, sf_dir):
    """Image assets of parser output; of several with one path the last counts."""
    rows = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_partkey") % 3 > 0, "image").otherwise("text").alias("type")
    element = F.struct(kind, F.concat(F.lit("img"), (F.col("l_partkey") % 5).cast("string"), F.lit(".png")).alias("img_path"))
    pages = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.array(element).alias("elements")))).alias("p"))
    pages = pages.select("l_orderkey", F.transform("p", lambda x: x["elements"]).alias("pages"))
    return R.image_assets(pages, "l_orderkey").select(F.col("l_orderkey").alias("doc"), "img_path", F.col("page").cast("long").alias("page"))


@query("select r_name as found from region where r_regionkey = 0")
def src13_one_content_list(spark, sf_dir):
    """The only file of a kind below a folder."""
    scratch = Scratch(spark, "src13")
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("file"), F.col("r_name").alias("text"))
    path = put(rows.withColumn("file", F.when(F.col("file") == 0, "a_content_list_v2.json").otherwise(F.col("file").cast("string"))), scratch, "files")
    one = R.the_one_file(spark, path, r"_content_list_v2\.json/part-[^/]*$")
    return spark.read.text(one).select(F.col("value").alias("found"))


def _list_file(spark, sf_dir, name: str) -> str:
    """Part types in a text file, with comments, blank and short lines among them."""
    words = table(spark, sf_dir, "part").select(F.col("p_partkey"), F.col("p_type")).agg(F.array_sort(F.collect_set("p_type")).alias("w"))  # a vocabulary
    text = F.concat(F.lit("# comment\n\n(note)\nx\n"), F.array_join("w", "\n"), F.lit("\n  "), F.get("w", 0), F.lit("  "))
    return put(words.select(F.lit(0).alias("file"), text.alias("text")), Scratch(spark, name), "files")


@query("""
with w as (select p_type, row_number() over (order by p_type) as r, count(*) over () as n from (select distinct p_type from part))
select 4 + r as index, p_type as query from w union all select 5 + n, p_type from w where r = 1 union all values (1, '# comment'), (3, '(note)'), (4, 'x')
""")
def src16_queries_file(spark, sf_dir):
    """One query a line, numbered by line."""
    return R.queries_file(spark, _list_file(spark, sf_dir, "src16")).select(F.col("index").cast("long").alias("index"), "query")


@query("select distinct p_type as word from part")
def src17_word_list(spark, sf_dir):
    """Word lists, whitelists and id files: no comments, no short or repeated lines (SRC17-SRC19)."""
    return R.word_list(spark, _list_file(spark, sf_dir, "src17")).select("word")


@query("""select event_id, '{"a":{"k":' || (event_id % 7)::varchar || ',"list":[{"x":1},"plain {"]},"b":"text"}' as out from events""")
def src23_nested_json(spark, sf_dir):
    """JSON in strings within JSON, parsed to the ground."""
    inner = F.concat(F.lit('{"list": ["{\\"x\\": 1}", "plain {"], "k": '), (F.col("event_id") % 7).cast("string"), F.lit("}"))
    text = F.to_json(F.struct(inner.alias("a"), F.lit("text").alias("b")))
    return table(spark, sf_dir, "events").select("event_id", R.nested_json(text).alias("out"))


@query(" union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in TABLES))
def src25_collections(spark, sf_dir):
    """Tables with their row counts."""
    return R.collections({t: table(spark, sf_dir, t) for t in TABLES})


@query("select n_nationkey as file, strlen(n_name) + 1 as length from nation")
def src26_file_sizes(spark, sf_dir):
    """Files with their sizes."""
    path = put(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file"), F.col("n_name").alias("text")), Scratch(spark, "src26"), "files")
    return R.file_sizes(spark, path + "/*").select(file_number("path").alias("file"), "length")


@query("select event_id, event_type, value from events")
def snk1_jsonl(spark, sf_dir):
    """JSON lines written and read again."""
    scratch = Scratch(spark, "snk1")
    S.write_jsonl(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), scratch.path("rows"))
    return R.jsonl(spark, scratch.path("rows"), "event_id long, event_type string, value double", strict=True)


@query("select 'backup' as state, r_regionkey, r_name from region union all select 'now', r_regionkey, r_name || '+' from region where r_regionkey > 1")
def snk3_rewrite_with_backup(spark, sf_dir):
    """A table replaced twice; the backup keeps what stood there first."""
    scratch, rows = Scratch(spark, "snk3"), table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    at, staging, backup = (scratch.path(x) for x in ("table", "staging", "backup"))
    S.rewrite(rows, at, staging, backup)
    for least in (0, 1):
        S.rewrite(rows.where(F.col("r_regionkey") > least).withColumn("r_name", F.concat("r_name", F.lit("+"))), at, staging, backup)
    read = lambda p, state: spark.read.parquet(p).select(F.lit(state).alias("state"), "r_regionkey", "r_name")
    return read(backup, "backup").union(read(at, "now"))


@query("select s_suppkey as key, s_name as name from supplier union all select c_custkey, c_name from customer union all select -1, 'one more'")
def snk4_appended(spark, sf_dir):
    """Lines and rows appended to what is there (SNK4, SNK5)."""
    scratch = Scratch(spark, "snk4")
    S.write_jsonl(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), scratch.path("rows"))
    S.write_jsonl(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")), scratch.path("rows"), append=True)
    S.write_jsonl(spark.createDataFrame([(-1, "one more")], "key long, name string"), scratch.path("rows"), append=True)
    return R.jsonl(spark, scratch.path("rows"), "key long, name string", strict=True)


@query("""
select 'customer' as name, count(*) as n from customer where c_nationkey % 5 <> 0 union all select 'nation', count(*) from nation where n_nationkey % 5 <> 0
union all select 'supplier', count(*) from supplier where s_nationkey % 5 <> 0
""")
def snk10_cascade(spark, sf_dir):
    """A key deleted from every table that has it."""
    own = {"nation": "n_nationkey", "customer": "c_nationkey", "supplier": "s_nationkey"}
    tables = {t: table(spark, sf_dir, t).withColumnRenamed(c, "key") for t, c in own.items()}
    gone = tables["nation"].where("key % 5 = 0").select("key")
    return R.collections(M.cascade(tables, gone, "key"))


@query("""
select doc_id, case when doc_id % 2 = 0 then 'new ' || substring(text, 1, 496) else substring(text, 1, 500) end as text, 'q' || doc_id as vector_id from documents
""")
def snk12_vector_put(spark, sf_dir):
    """Vectors replaced by id, their text cut to 500 characters."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = M.vector_rows(rows, "doc_id", "text")
    changed = M.vector_rows(rows.where("doc_id % 2 = 0").withColumn("text", F.concat(F.lit("new "), "text")), "doc_id", "text")
    return M.upsert(base, changed, ["doc_id"])


@query("""
with s as (select count(*) as total, count(*) filter (where doc_id not in (select doc_id from labels)) as inserted from documents
           union all select count(*), 0 from labels union all select count(*), count(*) from nation)
select count(*)::int as n_tables, sum(total)::bigint as total, sum(inserted)::bigint as inserted, (sum(total) - sum(inserted))::bigint as skipped from s
""")
def snk14_copy_all(spark, sf_dir):
    """All tables but the excluded ones copied, and the totals."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"))
    pairs = {"documents": (docs, labels), "labels": (labels, labels), "nation": (nation, nation.where("false")), "logs": (docs, docs)}
    return M.copy_all(pairs, ["doc_id"], exclude={"logs"})


@query("select event_id, event_type, value from events")
def snk16_csv(spark, sf_dir):
    """CSV written and read again."""
    scratch = Scratch(spark, "snk16")
    S.write_csv(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), scratch.path("rows"))
    return spark.read.schema("event_id long, event_type string, value double").option("header", True).csv(scratch.path("rows"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def jn6_migration(spark, sf_dir):
    """Rows of the source that the target lacks."""
    return M.copy_missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])[0]


@query("select s_suppkey, 'session' || s_suppkey as session_id, s_suppkey % 2 = 0 as existed, case when s_suppkey % 3 = 0 then 'ended' else 'active' end as status from supplier")
def sup6_sessions(spark, sf_dir):
    """Sessions created once, an existing one is returned; ends mark the status."""
    keys = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("session"), F.col("s_suppkey").cast("string")).alias("session_id"))
    there = keys.where("s_suppkey % 2 = 0").withColumn("status", F.lit("active"))
    made = M.insert_if_absent(there.withColumn("existed", F.lit(True)), keys.select("*", F.lit("active").alias("status"), F.lit(False).alias("existed")), ["session_id"])
    ended = keys.where("s_suppkey % 3 = 0").select("session_id", F.lit("ended").alias("status"))
    return M.upsert(made, ended, ["session_id"], partial=True).select("s_suppkey", "session_id", "existed", "status")
