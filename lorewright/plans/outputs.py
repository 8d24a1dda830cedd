"""What becomes of a model's output and of a question on its way, over whole ``documents`` and ``conversations`` texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import tex
from ..functions import text as T
from ..operators import books as B
from ..operators import retrieval as R
from ..scratch import Scratch
from ..session import table
from ..streaming import streams as S
from ..streaming import upserts as U
from ..streaming.stateful import merged_segments
from .registry import query

_WORDS = r"b as (select doc_id, 'x ' || trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) as b from documents)"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text as words of letters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("x "), F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))).alias("b"))


def _by_id(n: int, *texts):
    """One of n texts by doc_id; strings are constants."""
    return F.coalesce(*[F.when(F.col("doc_id") % n == i, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in t])) for i, t in enumerate(texts)])


@query(rf"""
with {_WORDS}
select doc_id, md5(trim(case doc_id % 6 when 0 then '(1)' || b || '。' || chr(10) || chr(10) || '(2)完' when 1 then b when 2 then b when 3 then '说：' || b || '，(3)' || b
    when 4 then '选择题，则：' || chr(10) || 'A. ' || b || '。' || chr(10) || 'B. 二' else '没有选项' || b end)) as out_md5 from b
""")
def st16_clean_outputs(spark, sf_dir):
    """Model outputs with think blocks, fences, labels, quotes, spoken parts and options (ST16, ST17, ST18)."""
    b = F.col("b")
    raw = _by_id(
        6, ('<think>a\nb</think>```\n输出：结果: "第一问', b, '。第2小题，完"\n```'), ("结果: '", b, "' "), ("  ", b, "\n"), ("说：", b, "，问题三、", b),
        ("选择题，则选项A", b, "。选项$B$：二"), ("没有选项", b),
    )
    return _words(spark, sf_dir).select("doc_id", F.md5(T.clean_output(raw)).alias("out_md5"))


@query(rf"""
with {_WORDS}
select doc_id, md5(case doc_id % 4 when 0 then '第一章' || b when 1 then '(1)' || b || '；' || chr(10) || chr(10) || '(2)' || b when 2 then b || '，(3)好' else '问第一问' || b end) as out_md5 from b
""")
def st17_numbered_parts(spark, sf_dir):
    """Spoken marks of parts, at the start of a clause only (ST17)."""
    b = F.col("b")
    raw = _by_id(4, ("第一章", b), ("第 1 小问，", b, "；第２问", b), (b, "，问题3:好"), ("问第一问", b))
    return _words(spark, sf_dir).select("doc_id", F.md5(T.numbered_parts(raw)).alias("out_md5"))


@query(rf"""
with {_WORDS}
select doc_id, md5(case doc_id % 3 when 0 then '下列说法正确的是' || chr(10) || 'A. ' || b || '。' || chr(10) || trim('D. ' || b) when 1 then '选项A' || b else 'A. ' || b || '。' || chr(10) || 'B. 二。' || chr(10) || 'C. 三。' || chr(10) || 'D. 四' end) as out_md5 from b
""")
def st18_choice_lines(spark, sf_dir):
    """Options on lines of their own: in a choice question, or where all four are named (ST18)."""
    b = F.col("b")
    raw = _by_id(3, ("下列说法正确的是a选项：", b, "。选项d", b), ("选项A", b), ("选项A", b, "。选项B，二。选项 C 三。D选项四"))
    return _words(spark, sf_dir).select("doc_id", F.md5(T.choice_lines(raw)).alias("out_md5"))


@query(r"""
with t as (select doc_id, replace(replace(coalesce(text, ''), '\', ''), '^', '') as t from documents)
select doc_id, md5(case doc_id % 4 when 0 then t || '$90\circ{}^{-}$' || t when 1 then t || '\circ{}^{+} and 30\circ{}^{-}' when 2 then t || '\circ^2 \circ{}^{+}' else t || '\circ ^ - ' end) as out_md5 from t
""")
def tx6_degree_limits(spark, sf_dir):
    """One-sided limits at a degree sign get a base of their own (TX6)."""
    t = F.translate(F.coalesce("text", F.lit("")), "\\^", "")
    raw = _by_id(4, (t, r"$90\circ^-$", t), (t, r"\circ^{ + } and 30\circ ^{-}"), (t, r"\circ^2 \circ^{+}"), (t, r"\circ ^ - "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tex.degree_limits(raw)).alias("out_md5"))


@query(r"""
with t as (select doc_id, trim(regexp_replace(coalesce(text, ''), '[^a-z ]+', '', 'g')) as t from documents)
select doc_id, case doc_id % 8 when 0 then '成都' when 1 then '北京' when 2 then '上海' when 3 then 'New York' when 4 then '广州' when 5 then 'Paris' when 6 then '晴雨' end as place from t
""")
def st35_weather_places(spark, sf_dir):
    """Places in questions about the weather that have a whole text before or behind them (ST35)."""
    t = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z ]+", ""))
    raw = _by_id(
        8, ("请问成都今天天气怎么样？", t), ("我想了解一下北京的气温 ", t), (t, " 。上海明天 ", t), (t, " how is it in New York today? ", t), ("麻烦问下广州现在下雨吗 ", t), (t, ". Near Paris? near Paris Tonight "), (t, "晴", t, "雨"), (t, " no place"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", T.weather_place(raw).alias("place"))


@query("""
with e as (select *, (['greeting', 'noise', 'question', null])[1 + event_id % 4] as intent, (['MATH_LLM', 'rag_with_fallback', 'general_llm', 'other', null])[1 + user_id % 5] as mode from events)
select event_id, case when intent in ('greeting', 'noise') then 'greeting' when coalesce(value > 50, false) then 'realtime' when mode = 'MATH_LLM' then 'math' when mode = 'rag_with_fallback' then 'rag' else 'general' end as branch,
    case when user_id % 2 = 0 and event_type <> 'click' then 'concept_hit' else 'concept_miss' end as concept from e
""")
def mx8_routes(spark, sf_dir):
    """The branch of every event after classification and after concept retrieval (MX8)."""
    intent = F.get(F.array(*map(F.lit, ("greeting", "noise", "question", None))), (F.col("event_id") % 4).cast("int"))
    mode = F.get(F.array(*map(F.lit, ("MATH_LLM", "rag_with_fallback", "general_llm", "other", None))), (F.col("user_id") % 5).cast("int"))
    context = F.when(F.col("event_type") != "click", F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        "event_id", N.route_after_classification(intent, F.col("value") > 50, mode).alias("branch"), N.route_after_concepts(F.col("user_id") % 2 == 0, context).alias("concept")
    )


@query("""
select conv_id, turn, (row_number() over (partition by conv_id order by turn, role, text) - 1) as sequence, count(*) over (partition by conv_id) as n_chunks from conversations
""")
def str9_sequences(spark, sf_dir):
    """Chunks numbered from 0 within their chat, with the chat's count (STR9)."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(w) - 1).cast("long").alias("sequence"))
    counts = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return rows.join(counts, "conv_id").select("conv_id", "turn", "sequence", "n_chunks")


@query("""
with e as (select user_id as id, event_id, event_type, value, (event_id % 7 = 0) as gone from events),
l as (select id, arg_max(struct_pack(t := event_type, v := value, g := gone), event_id) as x, max(event_id) as version from e group by id)
select id, x.t as status, x.v as value, version from l where not x.g
""")
def snk6_streamed_upserts(spark, sf_dir):
    """Events as a stream of upserts and deletes by user, each batch applied twice (SNK6, SNK11, STR13)."""
    scratch, events = Scratch(spark, "snk6"), table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.col("event_type").alias("status"), "value", (F.col("event_id") % 7 == 0).alias("gone"))
    rows.repartition(4, "version").write.parquet(scratch.path("in"))
    target = U.KeyedTable(spark, scratch.path("table"), "id long, version long, status string, value double", "id", "version")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(scratch.path("in"))
    U.run_into(stream, target, "gone", scratch.path("checkpoint"), replay=True)
    return target.rows().select("id", "status", "value", "version")


@query("""
with e as (select vec_id, embedding::double[] as v, lead(embedding::double[]) over (partition by vec_id // 50 order by vec_id) as w from embeddings)
select vec_id, round(case when vec_id % 10 = 0 then 0 else list_cosine_similarity(v, w) end, 6) as similarity from e where w is not null
""")
def ret3_cosine(spark, sf_dir):
    """Cosine of each vector and the next one of its block of fifty; a zero vector is similar to nothing (RET3)."""
    w = Window.partitionBy(F.floor(F.col("vec_id") / 50)).orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.lead("embedding").over(w).alias("next")).where("next is not null")
    vector = F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return rows.select("vec_id", F.round(R.cosine(vector, F.col("next")), 6).alias("similarity"))


@query("""
with t as (select p_partkey, p_name || ' of ' || p_type as t from part)
select p_partkey, case p_partkey % 5 when 0 then true when 1 then true when 2 then (length(t) - 2) / length(t) >= 0.78 when 3 then false else false end as similar from t
""")
def st39_similar_titles(spark, sf_dir):
    """Titles that are equal, hold each other, differ in two characters, share none, or are empty (ST39)."""
    t, k = F.concat("p_name", F.lit(" of "), "p_type"), F.col("p_partkey") % 5
    other = F.when(k == 0, t).when(k == 1, F.concat(F.lit("1 "), t, F.lit("!"))).when(k == 2, F.concat(F.lit("##"), F.substring(t, 3, 1000))).when(k == 3, "#####").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", B.are_similar_titles(t, other).alias("similar"))


@query(rf"""
with {_WORDS}
select doc_id, md5(case doc_id % 5 when 0 then '。' || b || '!|1.' || b when 1 then b || '|a.' || chr(10) || 'b.' || b || '?' when 2 then b || ' ...|9.' when 3 then '?!' else '2：。|' || b end) as merged_md5 from b
""")
def str6_merged_segments(spark, sf_dir):
    """Segments that are marks or short prefixes joined with their neighbours (STR6)."""
    b = F.col("b")
    lists = (("。", b, "!", "1.", b), (b, "a.", "\n", "b.", b, "?"), (b, " ...", "9."), ("?", "!"), ("2：", "。", b))
    arrays = [F.array(*[F.lit(x) if isinstance(x, str) else x for x in parts]) for parts in lists]
    segments = F.coalesce(*[F.when(F.col("doc_id") % len(lists) == i, x) for i, x in enumerate(arrays)])
    return _words(spark, sf_dir).select("doc_id", F.md5(F.array_join(merged_segments(segments), "|")).alias("merged_md5"))


@query(rf"""
with {_WORDS}
select doc_id, (['outside', 'opening', 'inside', 'closing', 'outside'])[1 + doc_id % 5] as mode, (['', '<thin', '', '</think', ''])[1 + doc_id % 5] as held, ([1, 0, 0, 1, 0])[1 + doc_id % 5]::bigint as n_blocks,
    md5(case doc_id % 5 when 0 then b || b when 1 then b when 2 then b when 3 then '' else b || '<b <thinker>' end) as shown_md5 from b
""")
def sup37_think_states(spark, sf_dir):
    """Where the think filter stands after every text: what it shows, holds back and has closed (SUP37)."""
    b = F.col("b")
    text = _by_id(5, (b, "<think a='1'>no", b, "</THINK >", b), (b, "<thin"), (b, "<think\n>", b), ("<think>x</think><think>", b, "</think"), (b, "<b <thinker>"))
    return _words(spark, sf_dir).select("doc_id", S.think_states(text).alias("s")).select("doc_id", "s.mode", "s.held", "s.n_blocks", F.md5("s.shown").alias("shown_md5"))
