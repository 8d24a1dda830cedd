"""Sources (SRC1-SRC26). Paths stay URIs that Spark opens."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Wrapper keys under which a JSON file may hold its list.
WRAPPERS = ("items", "concepts", "documents", "data")


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line: the lines of text files, numbered from 1 in each file.

    Lines are numbered within the block that a task reads; only the blocks' counts are added up by file.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("line"))
    counts = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("i"))
    return raw.withColumn("own", own).join(counts.select("file", "block", before.alias("before")), ["file", "block"]).select("file", (F.col("before") + F.col("own")).alias("line_no"), "line")


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """SRC2: one object a line; bad lines are left out, or fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def jsonl_problems(lines: DataFrame, schema: str) -> DataFrame:
    """SRC1: file_lines with the record, or what is wrong with the line: no JSON, or no object. Blank lines are left out."""
    line = F.trim("line")
    parsed = F.try_parse_json(line)
    problem = F.when(parsed.isNull(), "no JSON").when(~F.startswith(line, F.lit("{")), "no object")
    return lines.where(line != "").withColumn("problem", problem).withColumn("record", F.when(F.col("problem").isNull(), F.from_json(line, schema)))


def review_rows(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """SRC3: records for review; a missing status is null, a stored index is dropped."""
    return jsonl(spark, path, f"{fields}, review_status string")


def samples(lines: DataFrame) -> DataFrame:
    """SRC4: line_no, before, after of the lines whose ``before`` is not blank."""
    r = lines.select("file", "line_no", F.from_json("line", "before string, after string").alias("r")).select("file", "line_no", "r.before", "r.after")
    return r.where(F.trim(F.coalesce("before", F.lit(""))) != "")


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC6: the object in a file; a file that is missing or corrupt gives no row."""
    whole = spark.read.format("binaryFile").option("ignoreMissingFiles", "true")
    files = whole.load(path.rsplit("/", 1)[0]).where(F.endswith("path", F.lit("/" + path.rsplit("/", 1)[1])))
    return files.select(F.from_json(F.col("content").cast("string"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.try_parse_json(F.col("content").cast("string")).alias("v")).where("v is not null").select("r.*")


def the_one_file(spark: SparkSession, path: str, pattern: str) -> str:
    """SRC13: the only file below a folder whose path matches; any other number is an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.rlike("path", F.lit(pattern))).select("path").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} file matches {pattern}")
    return found[0].path


def unnested(value):
    """SRC23: JSON in strings, however deep, becomes JSON."""
    if isinstance(value, dict):
        return {k: unnested(v) for k, v in value.items()}
    if isinstance(value, list):
        return [unnested(v) for v in value]
    if isinstance(value, str) and value.strip()[:1] in ("{", "["):
        try:
            return unnested(json.loads(value))
        except ValueError:
            return value
    return value


@F.pandas_udf(T.StringType())
def nested_json(texts: pd.Series) -> pd.Series:
    """SRC23 as a column: JSON text to JSON text with sorted keys; what is no JSON stays."""
    def one(text: str) -> str:
        try:
            return json.dumps(unnested(json.loads(text)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return text

    return texts.map(one, na_action="ignore")


def collections(tables: dict[str, DataFrame]) -> DataFrame:
    """SRC25: name, n of each table."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.union(row)
    return out


def wrapped_json(spark: SparkSession, path: str, element: str) -> DataFrame:
    """SRC2, SRC5: a JSON list, or an object with the list under one of ``WRAPPERS``."""
    whole = spark.read.text(path, wholetext=True)
    as_list = F.from_json("value", f"array<struct<{element}>>")
    as_object = F.from_json("value", ", ".join(f"{k} array<struct<{element}>>" for k in WRAPPERS))
    is_list = F.startswith(F.trim("value"), F.lit("["))
    rows = F.when(is_list, as_list).otherwise(F.coalesce(*[as_object[k] for k in WRAPPERS]))
    return whole.select(F.explode(rows).alias("r")).select("r.*")


def keyed_json(spark: SparkSession, path: str, element: str) -> DataFrame:
    """SRC7, SRC8: an object of objects, each key as ``_key``; it may stand under ``data``."""
    whole = spark.read.text(path, wholetext=True)
    inner = F.coalesce(F.get_json_object("value", "$.data"), F.col("value"))
    return whole.select(F.explode(F.from_json(inner, f"map<string,struct<{element}>>")).alias("_key", "r")).select("_key", "r.*")


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC9: nodes and edges of a GraphML file, attributes as a map."""
    data = "data array<struct<_key:string,_VALUE:string>>"
    attributes = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(d["_key"], d["_VALUE"])))
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(path)
    return nodes.select(F.col("_id").alias("node_id"), attributes.alias("attributes")), edges.select(
        F.col("_source").alias("source"), F.col("_target").alias("target"), attributes.alias("attributes")
    )


def numbered_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """SRC10: key, line_no from 1, line."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n", -1)).alias("p", "line"))
    return lines.select(key, (F.col("p") + 1).cast("long").alias("line_no"), "line")


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: files as numbered lines."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return numbered_lines(whole, "file", "text")


def images(lines: DataFrame, key: str) -> DataFrame:
    """SRC10, SUP22: image references with their line."""
    found = F.regexp_extract_all("line", F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), 1)
    return lines.select(key, "line_no", F.explode(found).alias("image_path"))


def word_list(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """SRC17-SRC19: one word a line; blank lines, comments and short words are left out, each word stays once."""
    rows = spark.read.text(path).select(F.trim("value").alias("word"))
    return rows.where((F.char_length("word") >= least) & ~F.rlike("word", F.lit("^[#(]"))).distinct()


def queries_file(spark: SparkSession, path: str) -> DataFrame:
    """SRC16: index (line number from 1) and query; blank lines are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.lit(0).alias("f"), "value")
    rows = numbered_lines(whole, "f", "value")
    return rows.where(F.trim("line") != "").select(F.col("line_no").alias("index"), F.trim("line").alias("query"))


def image_assets(pages: DataFrame, *keys: str) -> DataFrame:
    """SRC12: pages -> elements -> images; of several with one path the last one counts."""
    elements = pages.select(*keys, F.posexplode("pages").alias("page", "elements")).select(*keys, "page", F.posexplode("elements").alias("at", "e"))
    return elements.where("e.type = 'image'").groupBy(*keys, F.col("e.img_path").alias("img_path")).agg(F.max_by("e", F.struct("page", "at")).alias("e"), F.max("page").alias("page"))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """SRC26: the names and sizes of files, without their contents."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def log_entries(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """SRC14: a line that starts with a date opens an entry, other lines continue it."""
    from ..operators.windows import gaps_and_islands

    return gaps_and_islands(lines, key, order, F.rlike(F.col(text), F.lit(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}")), text)


def html_text(html: Column) -> Column:
    """SRC11: tags, scripts and styles out, common entities decoded, white space collapsed."""
    out = F.regexp_replace(html, F.lit(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->"), F.lit(" "))
    out = F.regexp_replace(out, F.lit(r"(?s)<[^>]+>"), F.lit(" "))
    for name, by in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(by))
    return F.trim(F.regexp_replace(out, F.lit(r"\s+"), F.lit(" ")))
