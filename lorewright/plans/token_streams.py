"""Token streams of ``conversations`` run as streams with state and timers, and what segments are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..session import table
from ..streaming import stateful as X
from ..streaming import streams as S
from ..streaming.segments import segment_marks
from .registry import query


#: Batches of a stream over a table: each one opens and commits every partition's state, so they do not grow with the table.
BATCHES = 3


def _streamed(spark: SparkSession, tokens: DataFrame, name: str, make) -> DataFrame:
    """Tokens written as files, read as a stream of several batches whatever their order, and what it wrote."""
    scratch = Scratch(spark, name)
    tokens.write.parquet(scratch.path("in"))
    n_files = len(spark.read.schema(tokens.schema).parquet(scratch.path("in")).inputFiles())
    with X.timed_state(spark, ends=True):
        files = spark.readStream.schema(tokens.schema).option("maxFilesPerTrigger", max(2, -(-n_files // BATCHES)))
        out = make(files.parquet(scratch.path("in")))
        S.run_to_files(out, scratch.path("out"), scratch.path("checkpoint"))
    return spark.read.schema(out.schema).parquet(scratch.path("out"))


@query()
def str5_segments_of_a_stream(spark, sf_dir):
    """STR5, STR6: segments of every conversation's token stream, with state kept over batches; equal to ``str5_segments``."""
    tokens = X.placed_tokens(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text", "(?<= )")
    return _streamed(spark, tokens, "str5", lambda rows: X.timed_segments(rows, wait="1 day"))


@query(r"""
with t as (select conv_id, turn, coalesce(text, '') as text, (conv_id + turn) % 3 as k from conversations where conv_id is not null),
f as (select conv_id, turn, k, unnest([{'i': 1, 'f': 'x_' || turn}, {'i': 2, 'f': replace(replace(text, '$', ''), '\', '')}, {'i': 3, 'f': 'y'}], recursive := true) from t),
g as (select conv_id, turn, i, f as formula, case i when 1 then '$' when 2 then '\(' else '$$' end as delimiter, case when i = 3 then 'display' else 'inline' end as kind from f where k = 0 or i = 1)
select conv_id::varchar as chat_id, row_number() over (partition by conv_id order by turn, i) as n, md5(formula) as formula_md5, kind, delimiter,
    row_number() over (partition by conv_id, kind order by turn, i) as of_kind from g
""")
def tx11_streamed_formulas(spark, sf_dir):
    """TX11: every turn holds one formula, every third one its whole text as a second and one of display kind as third; tokens cut delimiters."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null")
    plain = F.translate(F.coalesce("text", F.lit("")), "$\\", "")
    more = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.concat(F.lit(r" then \("), plain, F.lit(r"\) or $$y$$"))).otherwise("")
    rows = c.select("conv_id", "turn", F.concat(F.lit("first $x_"), F.col("turn").cast("string"), F.lit("$"), more, F.lit(". ")).alias("text"))
    tokens = X.placed_tokens(rows, "conv_id", ["turn"], "text", r"(?<=[ \\$])")
    out = _streamed(spark, tokens, "tx11", lambda x: X.streamed_formulas(x, joined=True))
    return out.select("chat_id", "n", F.md5("formula").alias("formula_md5"), "kind", "delimiter", "of_kind")


@query(r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as s from documents),
p as (select doc_id, case doc_id % 6 when 0 then s || ' \(' when 1 then '$' || s when 2 then s || '$a_1$' when 3 then '12.' when 4 then '。!? ' else s || ' \boxed {3' end as s from l),
q as (select doc_id, s, replace(s, '\$', '') as t from p),
r as (select *, length(t) - length(replace(t, '$$', '')) as two, replace(t, '$$', '') as u from q)
select doc_id, count(*) as n_lines, count(*) filter (regexp_matches(s, '\$\$[\s\S]+?\$\$|\$[^$\n]+?\$|\\\([\s\S]+?\\\)|\\\[[\s\S]+?\\\]') or two // 2 % 2 = 1 or (length(u) - length(replace(u, '$', ''))) % 2 = 1
        or length(s) - length(replace(s, '\(', '')) <> length(s) - length(replace(s, '\)', '')) or length(s) - length(replace(s, '\[', '')) <> length(s) - length(replace(s, '\]', ''))
        or regexp_matches(s, '\\boxed\s*\{')) as n_formula,
    count(*) filter (length(s) >= 8 and regexp_matches(s, '[a-zA-Z一-龥]')) as n_meant, count(*) filter (s <> '' and regexp_full_match(s, '[\s。！？.,;:!?—*•-]+')) as n_marks,
    count(*) filter (length(s) < 5 and regexp_full_match(s, '[0-9a-zA-Z]+[.：:]')) as n_prefix from r group by doc_id
""")
def sup36_segment_predicates(spark, sf_dir):
    """SUP36: what the lines of every document are to the sentence buffer, with formulas, marks and prefixes put to them by doc_id."""
    line, k = F.col("line"), F.col("doc_id") % 6
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    put = (
        F.when(k == 0, F.concat(line, F.lit(r" \("))).when(k == 1, F.concat(F.lit("$"), line)).when(k == 2, F.concat(line, F.lit("$a_1$")))
        .when(k == 3, "12.").when(k == 4, "。!? ").otherwise(F.concat(line, F.lit(r" \boxed {3")))
    )
    marks = segment_marks(F.col("line"))
    counts = [F.count_if(marks[x]).alias(f"n_{x}") for x in ("formula", "meant", "marks", "prefix")]
    return lines.select("doc_id", put.alias("line")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), *counts)
