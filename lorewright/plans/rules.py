"""Text, calendar and decision rules over ``documents``, ``events`` and ``orders``.

Most rules look for words of another script than the documents have, so a phrase is put before each
text, and stands alone in every second one.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import numeric as N
from ..functions import tex
from ..functions import text as T
from ..operators import filters as L
from ..operators import records as P
from ..operators import retrieval as R
from ..session import table
from .registry import query

#: What is put before the texts, by doc_id.
PHRASES = (
    "什么是导数", "请讲解一下数列的推导方法", "我们学习了圆，求它的面积", "第二问怎么做", "已知函数，求最大值", "3加5等于几",
    "再算一下这个结果？", "Big Apple 这个", "比较两种方法", "今天天气不错", "it is plain", "设x=1，证明",
)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


PHRASE_SQL = "with s as (select doc_id, lang, text, ([" + ", ".join(map(_quoted, PHRASES)) + f"])[1 + doc_id % {len(PHRASES)}] || case when doc_id % 2 = 0 then '' else ' ' || text end as t from documents)"


def said(spark, sf_dir):
    phrase = F.get(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % len(PHRASES)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.concat(phrase, F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit(" "), "text"))).alias("t"))


def phrase_query(name: str, doc: str, column, sql: str | None) -> None:
    def f(spark, sf_dir):
        return said(spark, sf_dir).select("doc_id", column(F.col("t")).alias("out"))

    f.__name__, f.__doc__ = name, doc
    query(sql and f"{PHRASE_SQL} select doc_id, {sql} as out from s")(f)


def matches(pattern: str, of: str = "t") -> str:
    return f"regexp_matches({of}, {_quoted(pattern)})"


def any_of(words, of: str = "t") -> str:
    return matches("|".join(words), of)


_ZH = "case when regexp_matches({0}, '[一-鿿]') then 'zh' when regexp_matches({0}, '[A-Za-z]') then 'en' else '' end"
_Q = "trim(t, ' ')"

phrase_query("st3_drift", "Two texts in different languages.", lambda t: T.language_drift(t, F.col("text")), f"(({_ZH.format('t')}) <> '' and ({_ZH.format('text')}) <> '' and ({_ZH.format('t')}) <> ({_ZH.format('text')}))")
phrase_query("st14_think", "Think blocks go, closed ones and an open tail.", lambda t: T.strip_think_tail(F.concat(F.lit("a<think x>no</think >"), t, F.lit(" <THINK>tail")))[0], "'a' || t || ' '")
phrase_query("st24_verbs", "Verbs translated in Chinese texts with a formula.", lambda t: T.translated_verbs(F.concat(F.lit("Obtain $x$ obtained "), t)), f"case when {matches('[一-鿿]')} then '得到' else 'Obtain' end || ' $x$ obtained ' || t")
phrase_query("st26_dependent", "Short questions that point backwards.", T.depends_on_context, f"({_Q} <> '' and length({_Q}) <= 24 and {any_of(('它', '这个', '那个', '这些', '那些', '上面', '前面', '刚才', '再算'), _Q)} and not {matches('(?:^|[\\s，,。.;；:：、])(?:什么是|介绍一下|定义|定理|公式)', _Q)} and not {matches('\\b[A-Z][a-z]+\\s+[A-Z][a-z]+\\b', _Q)})")
phrase_query("st27_math_problem", "Problems of mathematics.", T.is_math_problem, any_of(("三角形", "正方体", "圆锥", "圆的", "函数", "方程", "不等式", "数列", "集合", "向量", "导数", "积分", "面积", "体积", "周长", "最大值", "最小值", "求解", "求证", "求值", "证明", "化简", "等于多少", "平方"), _Q))
phrase_query("st28_concept", "Two of: a concept, a class, 25 characters.", T.explains_concept, f"({any_of(('什么是', '是什么', '定义', '概念', '推导', '证明过程', '异同', '区别'))}::int + {any_of(('教材', '课本', '课程', '学习了', '学过'))}::int + (length(t) >= 25)::int) >= 2")
phrase_query("st29_realtime", "The category of a question about the present: none is told yet.", lambda t: F.lit(None).cast("string"), "null::varchar")
phrase_query("st30_follow_up", "Follow-up questions.", T.is_follow_up, f"(length({_Q}) > 0 and not (length({_Q}) >= 80 and {any_of(T.COMPLETE_WORDS, _Q)}) and length({_Q}) <= 80 and {any_of(T.FOLLOW_UP_WORDS, _Q)})")
phrase_query("st31_arithmetic", "Simple sums.", T.is_simple_arithmetic, f"(length({_Q}) between 1 and 28 and not {any_of(T.NOT_SIMPLE_WORDS, _Q)} and {matches('[0-9一二三四五六七八九十百千万两零]', _Q)} and {matches('[-+*/加减乘除×÷]|等于', _Q)} and {matches('等于几|多少|=|＝', _Q)})")
phrase_query("st33_reason", "The class of a score's reason.", T.reason_class, "case " + " ".join(f"when {any_of(w)} then '{n}'" for n, w in T.REASONS) + " else 'heuristic' end")
phrase_query("st43_chunk_text", "Chunk texts with their header lines.", lambda t: T.chunk_text({"领域": F.col("lang"), "书名": F.lit(None)}, t, F.when(F.col("doc_id") % 3 == 0, "1/2")), "'【领域】' || lang || chr(10) || '【书名】' || case when doc_id % 3 = 0 then chr(10) || '【分片】1/2' else '' end || chr(10) || chr(10) || '【正文】' || chr(10) || t")
phrase_query("st45_log_payload", "Values of a conversion's log entry.", lambda t: T.conversion_log(F.concat(F.lit("x ASR→LaTeX: duration=1.5s, before='b', after='"), F.translate(t, "'", ""), F.lit("'")))["after"], "trim(replace(t, '''', ''), ' ')")
phrase_query("st47_first_line", "The first line of an answer, unquoted.", lambda t: T.first_line(F.concat(F.lit('"'), F.translate(t, "\"'“”‘’", ""), F.lit('"\nmore'))), "trim(split_part(trim(translate(t, '\"''“”‘’', ''), ' '), chr(10), 1), ' ')")
phrase_query("st49_calendar_text", "Spaces between ideographs, wide spaces and curly quotes.", lambda t: T.calendar_text(F.concat(F.lit("今 天　是“x” "), t)), "'今天是\"x\" ' || translate(t, '　“”‘’', ' \"\"''''')")
phrase_query("tx1_delimiters", "Formula delimiters made one.", lambda t: tex.unified_delimiters(F.concat(F.lit(r"\(x\) \\[y\\] "), t)), "'$x$ $$y$$ ' || t")
phrase_query("tx12_has_formula", "Texts with a formula.", lambda t: tex.has_formula(F.when(F.col("doc_id") % 3 == 0, F.concat(t, F.lit(r" \(x\)"))).otherwise(t)), "case when doc_id % 3 = 0 then true else " + matches(r"\$[^$]+\$|\\\(.+?\\\)|\\\[.+?\\\]|\\boxed\s*\{|\\begin\{") + " end")
phrase_query("tx10_unwrapped", "Delimiters and boxes stripped, however nested.", lambda t: tex.unwrapped(F.concat(F.lit(r"$$\boxed{ "), F.translate(t, "{}$\\", ""), F.lit(" }$$"))), r"regexp_replace(translate(t, '{}$\', ''), '^\s+|\s+$', '', 'g')")
phrase_query("tx4_tables", "Tables become arrays.", lambda t: tex.tabled(F.concat(F.lit(r"\begin{tabular}{c} $a$ & "), F.translate(t, "$", ""), F.lit(r" \end{tabular} $x$"))), r"'\begin{array}{c} a & ' || translate(t, '$', '') || ' \end{array} $x$'")
phrase_query("tx5_environments", "Bare environments become formulas.", lambda t: tex.displayed(F.concat(F.lit(r"\begin{cases} a \end{cases} "), F.translate(t, "$\\", ""))), r"'$$\begin{cases} a \end{cases}$$ ' || translate(t, '$\', '')")
phrase_query("tx3_boxes", "Bare boxes become formulas.", lambda t: tex.boxed(F.concat(F.lit(r"so \boxed{a{b}} "), F.translate(t, "$\\{}", ""))), r"'so $\boxed{a{b}}$ ' || translate(t, '$\{}', '')")
phrase_query("tx2_trimmed", "White space inside delimiters.", lambda t: tex.trimmed(F.concat(F.lit("$ a $ and $$ b $$ "), F.translate(t, "$\\", ""))), r"'$a$ and $$b$$ ' || translate(t, '$\', '')")
phrase_query("tx11_restored", "Formulas put aside and put back.", lambda t: tex.put_back(F.concat(F.lit("$a$ "), t)), "'$a$ ' || t")


#: The white space of SQL's patterns, and the spaces that its trim takes from the ends of a text.
SQL_WHITE, SQL_ENDS = r"\t\n\f\r ", " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


@query(r"""
with t as (select doc_id, 'x ' || trim(regexp_replace(coalesce(text, ''), '[()（）\s]+', ' ', 'g')) as b from documents)
select doc_id, md5(case doc_id % 4 when 0 then 'stem' when 1 then '' else b end) as stem_md5, md5(case doc_id % 4 when 0 then b when 1 then b || '|' || b when 2 then b || '|two|' || b else '' end) as parts_md5,
    (['fallback', 'two_part', 'fallback', 'single'])[1 + doc_id % 4] as status from t
""")
def st19_split_question(spark, sf_dir):
    """Stem, sub-questions and status of questions made of whole texts."""
    b, kind = F.concat(F.lit("x "), F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), rf"[()（）{SQL_WHITE}]+", " "), F.lit(SQL_ENDS))), F.col("doc_id") % 4
    q = F.when(kind == 0, F.concat(F.lit(" stem (1) "), b)).when(kind == 1, F.concat(F.lit("(1)"), b, F.lit(" （ 2 ）"), b)).when(kind == 2, F.concat(b, F.lit("(1)"), b, F.lit("(2) two (3)"), b)).otherwise(b)
    parts = table(spark, sf_dir, "documents").select("doc_id", T.split_question(q).alias("r"))
    return parts.select("doc_id", F.md5("r.stem").alias("stem_md5"), F.md5(F.array_join("r.parts", "|")).alias("parts_md5"), "r.status")


@query(f"""
{PHRASE_SQL}
select doc_id, case doc_id % 4 when 0 then '抱歉。' when 1 then '抱歉。 ' || t when 2 then t || ' 抱歉。' else t end as out from s
""")
def st23_mapped_reply(spark, sf_dir):
    """Fixed replies mapped, alone, at the beginning or at the end."""
    kind, t, fixed = F.col("doc_id") % 4, F.col("t"), F.lit("I cannot answer that.")
    text = F.when(kind == 0, fixed).when(kind == 1, F.concat(fixed, F.lit(" "), t)).when(kind == 2, F.concat(t, F.lit(" "), fixed)).otherwise(t)
    return said(spark, sf_dir).select("doc_id", T.mapped_reply(text, {"I cannot answer that.": "抱歉。", "I don't know.": "我不知道。"}).alias("out"))


@query("select p_partkey, case p_size % 4 when 0 then 'n' || p_partkey || '.json' when 1 then 'n' || p_partkey || '.md' when 2 then 'n' || p_partkey || '.md' end as out from part")
def st46_parsed_names(spark, sf_dir):
    """Names of a parser's exports."""
    name, kind = F.concat(F.lit("n"), F.col("p_partkey").cast("string")), F.col("p_size") % 4
    file = F.when(kind == 0, F.concat(F.lit("MinerU_"), name, F.lit("__20260124090252.json"))).when(kind == 1, F.concat(F.lit("MinerU_markdown_"), name, F.lit("_20260124170709.md")))
    file = file.when(kind == 2, F.concat(F.lit("MinerU_markdown_"), name, F.lit("_2026012417270799_2014.md"))).otherwise(F.concat(name, F.lit(".md")))
    return table(spark, sf_dir, "part").select("p_partkey", T.parsed_name(file).alias("out"))


@query("select p_partkey, 'a b/c' || p_partkey || '.png' as local, p_size % 2 = 0 as remote, '3-' || p_size as figure from part")
def st42_image_paths(spark, sf_dir):
    """Image paths made plain, remote ones told apart, figure numbers of captions (ST40, ST42)."""
    k = F.col("p_partkey").cast("string")
    path = F.concat(F.lit(".\\a%20b\\c"), k, F.lit(".png"))
    url = F.when(F.col("p_size") % 2 == 0, F.lit("HTTPS://x/y.png")).otherwise("images/y.png")
    caption = F.concat(F.lit(" 图 3-"), F.col("p_size").cast("string"), F.lit(" wheel"))
    return table(spark, sf_dir, "part").select("p_partkey", T.local_path(path).alias("local"), T.is_remote(url).alias("remote"), T.caption_number(caption).alias("figure"))


@query("""
with s as (select event_id, value, 'q' || repeat('x', (event_id % 120)::int) || case when event_id % 3 = 0 then '分析？' else '' end as q from events)
select event_id, least(10, greatest(0, 3 + case when length(q) > 100 then 2 when length(q) > 50 then 1 else 0 end + case when contains(q, '分析') then 2 else 0 end + case when contains(q, '？') then 1 else 0 end))::int as score from s
""")
def st32_complexity(spark, sf_dir):
    """Complexity from length, keywords and punctuation."""
    k = F.col("event_id")
    q = F.concat(F.lit("q"), F.repeat(F.lit("x"), (k % 120).cast("int")), F.when(k % 3 == 0, "分析？").otherwise(""))
    score = T.complexity(q, ["为什么", "如何", "比较", "分析", "总结", "原因", "关系"], ["是什么", "多少", "几个", "天气"], (["现任"], ["谁"], ["总统"]))
    return table(spark, sf_dir, "events").select("event_id", score.cast("int").alias("score"))


# --- calendar -----------------------------------------------------------------------------------


@query("""
with d as (select o_orderkey, o_orderdate::date as d, o_orderkey % 5 as k from orders)
select o_orderkey, case k when 0 then d - 1 when 1 then d + 2 when 2 then d - 3 when 3 then d + 2 end as day from d
""")
def dt1_relative_days(spark, sf_dir):
    """Relative day words, the longest first."""
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, "Yesterday it was").when(k == 1, "the day after tomorrow").when(k == 2, "大前天的事").when(k == 3, "后天见").otherwise("no day")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.relative_day(text, F.col("o_orderdate").cast("date")).alias("day"))


@query("""
with d as (select o_orderkey, 2000 + o_orderkey % 100 as y, o_orderkey % 100 as yy from orders)
select o_orderkey, make_date(y::int, 4, (floor(yy * 0.2422 + 4.81) - floor(yy / 4))::int) as qingming, make_date(y::int, 1, (floor(yy * 0.2422 + 5.4055) - floor((yy - 1) / 4.0))::int) as xiaohan from d
""")
def dt4_solar_terms(spark, sf_dir):
    """Days of solar terms."""
    year = (2000 + F.col("o_orderkey") % 100).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.solar_term(year, *C.SOLAR_TERMS["清明"]).alias("qingming"), C.solar_term(year, *C.SOLAR_TERMS["小寒"]).alias("xiaohan"))


@query("""
with d as (select o_orderkey, o_orderkey % 5 as k, year(o_orderdate)::int as y from orders)
select o_orderkey, case k when 0 then 2031 when 1 then y - 1 when 2 then y + 1 when 3 then y - 3 else y end as year from d
""")
def dt6_target_years(spark, sf_dir):
    """The year that a question means."""
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, "in 2031").when(k == 1, "去年").when(k == 2, "next year").when(k == 3, "3年前").otherwise("some time")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.target_year(text, F.lit(None).cast("date"), F.col("o_orderdate")).alias("year"))


@query("""
with n as (select o_orderkey, (o_orderkey % 103)::int as n from orders) select o_orderkey, case when n < 100 then n end as value from n
""")
def dt7_numerals(spark, sf_dir):
    """Numerals from 0 to 99."""
    names = F.array(*[F.lit(C.small_numeral(n)) for n in range(100)])
    n = (F.col("o_orderkey") % 103).cast("int")
    text = F.when(n < 100, F.when(n % 2 == 0, F.get(names, n)).otherwise(n.cast("string"))).otherwise("百")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.numeral_value(text).alias("value"))


@query("""
with d as (select o_orderkey, o_orderdate::date as d, (o_orderkey % 31 + 1)::int as day, (o_orderkey % 12 + 1)::int as m from orders)
select o_orderkey, try_cast(year(d) || '-' || lpad(m::varchar, 2, '0') || '-' || lpad(day::varchar, 2, '0') as date) as day from d
""")
def dt8_month_days(spark, sf_dir):
    """Explicit months and days; impossible ones are null."""
    text = F.concat(F.lit("在"), (F.col("o_orderkey") % 12 + 1).cast("string"), F.lit("月"), (F.col("o_orderkey") % 31 + 1).cast("string"), F.lit("日"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.month_day(text, F.year("o_orderdate")).alias("day"))


@query("select o_orderkey, o_orderkey % 4 < 2 as asks from orders")
def dt14_clock_questions(spark, sf_dir):
    """Questions for the time of day."""
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "现在几点了").when(k == 1, "What time is it").when(k == 2, "what time zone is it").otherwise("农历现在几点")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.is_clock_question(text).alias("asks"))


@query("""
with d as (select o_orderkey, year(o_orderdate)::int as y, o_orderkey % 4 as k from orders),
m as (select *, make_date(y, 5, 1) as may, make_date(y, 11, 1) as nov from d)
select o_orderkey, case k when 0 then may + ((6 - (isodow(may) - 1) + 7) % 7 + 7)::int when 1 then nov + ((3 - (isodow(nov) - 1) + 7) % 7 + 21)::int end as day from m
""")
def sup1_festivals(spark, sf_dir):
    """Festivals by weekday, by name."""
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "when is Mother's Day").when(k == 1, "感恩节是哪天").otherwise("a plain day")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.festival(text, F.year("o_orderdate")).alias("day"))


# --- decisions ----------------------------------------------------------------------------------


@query("select event_id, least(0.9, greatest(0.1, value / 50)) as clamped, ceil(event_id / 7.0)::bigint as batches from events")
def mx4_clamped(spark, sf_dir):
    """Clamped values and whole divisions rounded up."""
    return table(spark, sf_dir, "events").select("event_id", N.clamp(F.col("value") / 50, 0.1, 0.9).alias("clamped"), F.ceil(F.col("event_id") / 7).cast("long").alias("batches"))


@query("""
with e as (select event_id, case when event_id % 2 = 0 then 'noise' else event_type end as label, case event_id % 3 when 0 then 'low' when 1 then 'high' end as confidence,
             case event_id % 5 when 0 then '嗯嗯' when 1 then '这是什么' when 2 then repeat('啊', 13) else '好' end as q from events),
r as (select *, case when label <> 'noise' then null when confidence is null or confidence = 'low' then 'low_confidence' when length(q) > 12 then 'query_too_long' when contains(q, '什么') then 'heuristic_legit_query' end as reason from e)
select event_id, case when reason is null then label else 'other' end as label, reason from r
""")
def mx6_noise_gate(spark, sf_dir):
    """Noise is examined by four checks, in order."""
    k = F.col("event_id")
    label, confidence = F.when(k % 2 == 0, "noise").otherwise(F.col("event_type")), F.when(k % 3 == 0, "low").when(k % 3 == 1, "high")
    q = F.when(k % 5 == 0, "嗯嗯").when(k % 5 == 1, "这是什么").when(k % 5 == 2, F.repeat(F.lit("啊"), 13)).otherwise("好")
    return table(spark, sf_dir, "events").select("event_id", N.noise_gate(label, confidence, q).alias("r")).select("event_id", "r.label", "r.reason")


@query("""
with e as (select event_id, (['greeting', 'realtime_query', 'general_knowledge', 'chit_chat'])[1 + event_id % 4] as raw, case when event_id % 3 = 0 then 'high' else 'low' end as rc,
             repeat('问', (event_id % 11)::int) as q, (['realtime_query', 'general_knowledge', 'other'])[1 + event_id % 3] as second, case when event_id % 5 = 0 then 'high' else 'medium' end as c,
             event_id % 7 = 0 as rt, event_id % 2 = 0 as math, event_id % 6 = 1 as concept from events),
a as (select *, case when second <> 'realtime_query' and raw = 'realtime_query' and rc = 'high' and length(q) < 8 then raw when second = 'realtime_query' and raw <> 'realtime_query' and rc = 'high' then raw else second end as l1 from e),
b as (select *, case when rt and l1 not in ('greeting', 'noise', 'math_problem', 'realtime_query') and c <> 'high' and not (raw <> 'realtime_query' and rc = 'high' and length(q) >= 8) then 'realtime_query' else l1 end as l2 from a)
select event_id, case when l2 in ('general_knowledge', 'chit_chat', 'other') and math then 'math_problem' when l2 in ('general_knowledge', 'chit_chat', 'other') and concept then 'concept_explain' else l2 end as label from b
""")
def mx7_final_labels(spark, sf_dir):
    """The cascade from two classifiers' labels to the final one."""
    k = F.col("event_id")
    pick = lambda names: F.get(F.array(*map(F.lit, names)), (k % len(names)).cast("int"))
    label = N.final_label(
        pick(["greeting", "realtime_query", "general_knowledge", "chit_chat"]), F.when(k % 3 == 0, "high").otherwise("low"), F.repeat(F.lit("问"), (k % 11).cast("int")),
        pick(["realtime_query", "general_knowledge", "other"]), F.when(k % 5 == 0, "high").otherwise("medium"), k % 7 == 0, F.repeat(F.lit("问"), (k % 11).cast("int")), k % 2 == 0, k % 6 == 1,
    )
    return table(spark, sf_dir, "events").select("event_id", label["label"].alias("label"))


@query("""
select event_id, event_id % 2 = 0 and event_id % 3 = 0 as keep, concat_ws(',', case when event_id % 2 <> 0 then 'not_a_concept' end, case when event_id % 3 <> 0 then 'incomplete' end) as issues from events
""")
def mx10_keep_decision(spark, sf_dir):
    """Keep or drop, with the issues."""
    r = N.keep_decision(F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0)
    return table(spark, sf_dir, "events").select("event_id", r.alias("r")).select("event_id", "r.keep", F.array_join("r.issues", ",").alias("issues"))


@query("""
select event_id, case when event_id % 5 = 0 then 'missing' when value < 0 or value > 90 then 'out_of_range' when event_id % 7 = 0 then 'no_reason' end as fault from events
""")
def mx11_confidence_faults(spark, sf_dir):
    """The first fault of an anchor's confidence and reason."""
    k, v = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select("event_id", N.first_fault((k % 5 == 0, "missing"), (~v.between(0, 90), "out_of_range"), (k % 7 == 0, "no_reason")).alias("fault"))


@query(r"""
with t as (select doc_id, replace(replace(replace(replace(replace(coalesce(text, ''), '{', ''), '}', ''), '"', ''), '\', ''), chr(10), ' ') as t from documents)
select doc_id, ([1, 1, 2, 3, 0, 1])[1 + doc_id % 6]::bigint as n, md5(case doc_id % 6 when 0 then '{"a": "' || t || '"}' when 1 then '{"a": {"b": [1, "' || t || '"]}}' when 2 then '{"a": 1}{"b": "' || t || '}"}'
    when 3 then '{"k": "' || t || '"}' || '{}' || '{"l": 2}' when 4 then '' else '{"in": 3}' end) as objects_md5 from t
""")
def mx9_json_objects(spark, sf_dir):
    """JSON objects in whole texts: alone, among words, one after the other, a line each, none, within a broken one."""
    t = F.translate(F.coalesce("text", F.lit("")), '\n{}"\\', " ")
    a = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    texts = (a('{"a": "', t, '"}'), a(t, ' {"a": {"b": [1, "', t, '"]}} ', t), a('{"a": 1}{"b": "', t, '}"}'), a('{"k": "', t, '"}\n', t, '{}\n{"l": 2}'), t, a('{"open": ', t, '{"in": 3} ', t))
    text = F.coalesce(*[F.when(F.col("doc_id") % len(texts) == i, x) for i, x in enumerate(texts)])
    found = table(spark, sf_dir, "documents").select("doc_id", P.json_objects(text).alias("o"))
    return found.select("doc_id", F.size("o").cast("long").alias("n"), F.md5(F.array_join("o", "")).alias("objects_md5"))


@query("""
select event_id, case when value < 10 then 'paragraph' when event_id % 3 = 0 and event_id % 2 = 0 then 'invalid' when event_id % 3 = 0 then 'newline' when event_id % 2 = 0 then 'length' else 'paragraph' end as mode,
       case when event_id % 2 = 0 and value >= 10 then 300 end as size from events
""")
def mx15_segment_settings(spark, sf_dir):
    """How texts are cut, from settings that exclude each other."""
    k, off = F.col("event_id"), F.col("value") < 10
    mode, size = N.segment_mode(~off & (k % 3 == 0), F.when(~off & (k % 2 == 0), 300))
    return table(spark, sf_dir, "events").select("event_id", mode.alias("mode"), size.alias("size"))


@query("""
with d as (select doc_id, text, unnest(range(0, greatest(1, length(text) - 50), 206)) as start from documents)
select doc_id, start // 206 + 1 as piece, md5(substring(text, (start + 1)::int, 256)) as text_md5 from d
""")
def mx16_fixed_pieces(spark, sf_dir):
    """Every text in pieces of 256 characters that overlap by 50."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.fixed_pieces(F.col("text"), 256, 50)).alias("p", "piece_text"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("piece"), F.md5("piece_text").alias("text_md5"))


@query(r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') as t from documents)
select doc_id, case doc_id % 4 when 0 then '成都' when 1 then '上海' when 2 then '广州' else case when length(t) between 2 and 20 then t end end as out from t
""")
def st35_traffic_place(spark, sf_dir):
    """Places in questions about traffic that have a whole text before or behind them."""
    t, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 4
    letters = F.regexp_replace(t, "[^A-Za-z]", "")
    q = F.when(k == 0, F.concat(F.lit("请问成都今天堵不堵 "), t)).when(k == 1, F.concat(t, F.lit("。上海路况如何"))).when(k == 2, F.concat(t, F.lit("。查一下广州现在拥堵吗"))).otherwise(F.concat(letters, F.lit("？")))
    return table(spark, sf_dir, "documents").select("doc_id", T.traffic_place(q).alias("out"))


@query(r"""
with t as (select doc_id, 'x' || replace(replace(replace(coalesce(text, ''), '$', ''), '\', ''), chr(10), ' ') as t from documents)
select doc_id, (2 + doc_id % 2)::bigint as n, case when doc_id % 2 = 1 then 'inline' else 'display' end as last_kind, md5(t || '|b' || case when doc_id % 2 = 1 then '|' || t else '' end) as bodies_md5 from t
""")
def tx9_formulas(spark, sf_dir):
    """Formulas that hold whole texts, with their kinds and bodies."""
    t = F.concat(F.lit("x"), F.translate(F.coalesce("text", F.lit("")), "\n$\\", " "))
    q = F.concat(F.lit("a $"), t, F.lit("$ and $$b$$ "), F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("or $"), t, F.lit("$."))).otherwise(""))
    found = table(spark, sf_dir, "documents").select("doc_id", tex.formulas(q).alias("f"))
    return found.select("doc_id", F.size("f").cast("long").alias("n"), F.element_at("f", -1)["kind"].alias("last_kind"), F.md5(F.array_join(F.transform("f", lambda x: x["body"]), "|")).alias("bodies_md5"))


# --- filters, projections -----------------------------------------------------------------------


@query("select event_id from events where case when event_id % 3 = 0 then value end is not null")
def fil6_exists(spark, sf_dir):
    """Rows that have a field."""
    return table(spark, sf_dir, "events").withColumn("field", F.when(F.col("event_id") % 3 == 0, F.col("value"))).where(L.exists("field")).select("event_id")


@query("select p_partkey from part where p_size % 2 = 1")
def fil8_enabled(spark, sf_dir):
    """Enabled rows."""
    return table(spark, sf_dir, "part").withColumn("is_enable", F.col("p_size") % 2).where(L.equal_when_given_column("is_enable", 1)).select("p_partkey")


@query("select p_partkey, p_name from part where p_size % 3 = 0 and p_type in (select p_type from part where p_partkey % 2 = 0) and p_partkey % 5 <> 0")
def fil9_reviewed_concepts(spark, sf_dir):
    """Concepts reviewed as correct, on a whitelist, with a name."""
    rows = table(spark, sf_dir, "part")
    status, name = F.when(F.col("p_size") % 3 == 0, "correct").when(F.col("p_size") % 3 == 1, "incorrect"), F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_name"))
    items = rows.select("p_partkey", "p_type", name.alias("p_name"), status.alias("review_status"))
    return L.usable_concepts(items, "p_name", "p_type", rows.where("p_partkey % 2 = 0").select("p_type")).select("p_partkey", "p_name")


@query("""
select event_id from events where event_type = 'click' and strftime(ts, '%Y-%m-%d %H:%M:%S') >= '2024-01-10 06:00:00'
""")
def fil13_log_filter(spark, sf_dir):
    """Log entries of a type, from a time on, compared as text."""
    entry = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.col("event_type"))
    return table(spark, sf_dir, "events").withColumn("entry", entry).where(L.log_from("entry", " click", "2024-01-10 06:00:00")).select("event_id")


@query("""
with r as (select user_id, event_id, case when event_id % 3 = 0 then '中文' || event_type else event_type end as content, row_number() over (partition by user_id order by event_id) as pos from events),
k as (select *, row_number() over (partition by user_id order by pos) as rank from r where not regexp_matches(content, '[一-鿿]'))
select user_id, event_id, rank from k where rank <= 3
""")
def fil14_web_language(spark, sf_dir):
    """Web results in another script left out, three kept."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("中文"), "event_type")).otherwise(F.col("event_type")).alias("content"))
    return R.in_language(rows, "user_id", "event_id", T.dominant_language(F.col("content")), "zh", 3).select("user_id", "event_id", "rank")


@query("""
with r as (select conv_id, turn, role, case turn % 3 when 0 then '你好' when 1 then text else '123' end as t from conversations)
select conv_id, turn, role from r where not regexp_matches(t, '[一-鿿]')
""")
def fil15_history_language(spark, sf_dir):
    """History in the other language left out, undetermined rows kept."""
    t = F.when(F.col("turn") % 3 == 0, "你好").when(F.col("turn") % 3 == 1, F.col("text")).otherwise("123")
    return table(spark, sf_dir, "conversations").where(P.cross_language(T.dominant_language(t), F.lit("en"))).select("conv_id", "turn", "role")


@query("select c_custkey, case when c_custkey % 4 = 0 then 'a' when c_custkey % 4 = 1 then 'b,c' else '' end as ids, c_custkey % 6 = 0 or c_custkey % 5 = 0 as disabled from customer")
def fil17_nested_paths(spark, sf_dir):
    """The first list of several places that has an element, and a flag that is true in any (FIL17, FIL18)."""
    k, none = F.col("c_custkey"), F.array().cast("array<string>")
    a, b = F.when(k % 4 == 0, F.array(F.lit("a"))).otherwise(none), F.when(k % 4 == 1, F.array(F.lit("b"), F.lit("c")))
    flags = P.any_true(F.when(k % 6 == 0, True), F.lit(None).cast("boolean"), k % 5 == 0)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(L.first_filled(none, a, b), ",").alias("ids"), flags.alias("disabled"))


@query("select c_custkey, c_custkey::varchar || case when c_custkey % 2 = 0 then ',' || c_nationkey else '' end as bank_ids, 'p' || c_custkey as plugins from customer")
def prj2_plugins(spark, sf_dir):
    """Struct arrays projected, nulls dropped, ids as strings."""
    k = F.col("c_custkey")
    plugins = F.array(F.struct(F.concat(F.lit("p"), k.cast("string")).alias("name"), F.lit(1).alias("x")), F.lit(None).cast("struct<name:string,x:int>"))
    banks = F.array(k.cast("long"), F.when(k % 2 == 0, F.col("c_nationkey").cast("long")))
    return table(spark, sf_dir, "customer").select("c_custkey", P.comma_joined(P.id_strings(banks)).alias("bank_ids"), P.comma_joined(P.field_of(plugins, "name")).alias("plugins"))


@query("""
with q as (select p_partkey, unnest(case when p_size % 3 = 0 then ['section ' || p_partkey] else list_transform(range(p_size % 3), lambda i: 'q' || i || ' ' || p_partkey) end) as title from part)
select p_partkey, title, title || chr(10) || 'script ' || p_partkey as content from q
""")
def prj8_script_chunks(spark, sf_dir):
    """A teaching script as one chunk for each natural question, or one of its section."""
    k = F.col("p_partkey").cast("string")
    questions = F.filter(F.array(*[F.when(F.col("p_size") % 3 > i, F.concat(F.lit(f"q{i} "), k)) for i in (0, 1)]), lambda x: x.isNotNull())
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("section "), k).alias("section"), questions.alias("questions"), F.concat(F.lit("script "), k).alias("script"))
    return P.script_chunks(rows, "section", "questions", "script").select("p_partkey", "title", "content")


@query("select p_partkey, p_name || case when p_size % 2 = 0 then p_brand else '' end || 'x' as markdown, p_type || ',' || p_brand as attribute from part")
def prj11_job_markdown(spark, sf_dir):
    """A job's content items as one text, lists as comma strings (PRJ11, PRJ14)."""
    item = lambda text, content: F.struct(text.alias("text"), content.alias("content"))
    items = F.array(item(F.col("p_name"), F.lit("no")), item(F.lit(""), F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))), item(F.lit(None).cast("string"), F.lit("x")))
    return table(spark, sf_dir, "part").select("p_partkey", P.job_markdown(items).alias("markdown"), P.comma_joined(F.array("p_type", "p_brand")).alias("attribute"))


@query("""
select p_brand as entity, count(*) as n_chunks, count(distinct p_type)::bigint as n_sources, min(p_partkey) as first from part group by 1
""")
def prj15_custom_kg(spark, sf_dir):
    """Records as one chunk and one entity each, merged by entity."""
    chunks, entities = P.custom_kg(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.col("p_type").alias("source")))
    n = chunks.groupBy("entity").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("id").alias("first"))
    return n.join(entities, "entity").select("entity", "n_chunks", F.size("sources").cast("long").alias("n_sources"), "first")


@query("""
select c_custkey, case c_custkey % 5 when 0 then 'md' when 1 then 'content' when 2 then 'text' when 3 then 'body' else 'file ' || c_custkey end as content from customer
""")
def sup13_content(spark, sf_dir):
    """Content from the first of several fields that has one, else from the record's file."""
    k = F.col("c_custkey")
    field = lambda i, v: F.when(k % 5 == i, v).otherwise(F.when(k % 2 == 0, " "))
    rows = table(spark, sf_dir, "customer").select("c_custkey", k.alias("file"), *[field(i, v).alias(v) for i, v in enumerate(("md", "content", "text", "body"))])
    files = table(spark, sf_dir, "customer").select(k.alias("file"), F.concat(F.lit("file "), k.cast("string")).alias("file_text"))
    return P.with_content(rows, ["md", "content", "text", "body"], files, "file", "file_text").select("c_custkey", F.col("resolved").alias("content"))


@query("select p_partkey, coalesce(nullif(trim(case when p_size % 2 = 0 then '  ' else p_name end), ''), p_brand) as name, lower(trim(p_type)) as type from part")
def sup23_entity_fields(spark, sf_dir):
    """Names and types of entities made plain."""
    name = F.when(F.col("p_size") % 2 == 0, "  ").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", P.first_text(name, F.col("p_brand")).alias("name"), P.plain_type(F.concat(F.lit(" "), F.upper("p_type"))).alias("type"))


@query("select p_partkey, p_brand || '_' || p_size as document_id, case when p_size % 3 = 0 then p_type else p_name end as title from part")
def sup20_document_ids(spark, sf_dir):
    """Document ids from book and subject, block titles with their fallback."""
    title = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name"))
    path = F.array("p_brand", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("_", "p_brand", F.col("p_size").cast("string")).alias("document_id"), P.first_text(title, F.element_at(path, -1)).alias("title"))


@query(r"""
select doc_id, md5(trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || ' y z') as out_md5 from (select doc_id, 'x ' || coalesce(text, '') as t from documents)
""")
def sup21_flat_text(spark, sf_dir):
    """Nested contents, whole texts among them, as one text."""
    inner = F.to_json(F.struct(F.concat(F.lit("x "), F.coalesce("text", F.lit(""))).alias("content")))
    nested = F.concat(F.lit('{"content": ['), inner, F.lit(', {"type": "t", "content": {"content": [" y ", "z"]}}, 5]}'))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(P.flat_text(nested)).alias("out_md5"))


@query("""
select c_custkey, c_name, case when c_custkey % 2 = 0 then 'new' else c_mktsegment end as rule, c_acctbal from customer where c_custkey % 3 <> 0 union all select c_custkey, c_name, 'default', 0.0 from customer where c_custkey % 3 = 0
""")
def sup8_settings(spark, sf_dir):
    """Employees created where absent, one section of their settings replaced."""
    from ..operators import mutate as M

    c = table(spark, sf_dir, "customer")
    base = c.where("c_custkey % 3 <> 0").select("c_custkey", "c_name", F.struct(F.col("c_mktsegment").alias("rule"), F.col("c_acctbal").alias("balance")).alias("setting"))
    made = M.insert_if_absent(base, c.select("c_custkey", "c_name", F.struct(F.lit("default").alias("rule"), F.lit(0.0).alias("balance")).alias("setting")), ["c_custkey"])
    changed = F.when((F.col("c_custkey") % 2 == 0) & (F.col("c_custkey") % 3 != 0), F.col("setting").withField("rule", F.lit("new"))).otherwise(F.col("setting"))
    return made.withColumn("setting", changed).select("c_custkey", "c_name", "setting.rule", F.col("setting.balance").alias("c_acctbal"))


@query("select 'keywords' as name, count(*) as n from (select distinct doc_id, unnest(string_split(text, ' ')) as w from documents where doc_id not in (select doc_id from labels where toxic = 1)) union all select 'vectors', count(*) from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def sup10_removed_from_stores(spark, sf_dir):
    """Documents removed from the vector and the keyword store."""
    from ..operators import mutate as M
    from ..sources.readers import collections

    docs, gone = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    words = docs.select("doc_id", F.explode_outer(F.split("text", " ")).alias("w")).where("w is not null").distinct()
    return collections(M.cascade({"vectors": docs.select("doc_id"), "keywords": words}, gone, "doc_id"))


@query("""
with r as (select doc_id, quality, doc_id // 64 as list, row_number() over (partition by doc_id // 64 order by doc_id) - 1 as index from labels)
select doc_id, list, index, case when index % 4 = 0 then 'correct' when quality = 0 then 'incorrect' end as review_status from r
""")
def sup24_review_updates(spark, sf_dir):
    """Reviews updated by the place that a record had in its list (SUP24, SUP25)."""
    from ..operators import mutate as M

    list_ = F.floor(F.col("doc_id") / 64).alias("list")
    w = Window.partitionBy("list").orderBy("doc_id")  # a list's own order, as it is shown
    rows = table(spark, sf_dir, "labels").select("doc_id", list_, "quality")
    rows = rows.select("doc_id", "list", (F.row_number().over(w) - 1).cast("long").alias("index"), F.when(F.col("quality") == 0, "incorrect").alias("review_status"))
    updates = rows.where("index % 4 = 0").select("list", "index", F.lit("correct").alias("review_status"))
    return M.upsert(rows, updates, ["list", "index"], partial=True).select("doc_id", "list", "index", "review_status")


@query("""
with m as (select doc_id, n_chars, (['clean', 'query', 'sample'])[1 + doc_id % 3] as mode from documents) select mode, count(*) filter (where mode <> 'query') as n_imported, max(case when mode = 'sample' then least(n_chars, 100) else n_chars end) as longest, mode = 'clean' as wiped from m group by 1
""")
def sup30_import_modes(spark, sf_dir):
    """What each import mode does: wipe first, only ask, or take a sample of each text."""
    mode = F.get(F.array(*map(F.lit, ("clean", "query", "sample"))), (F.col("doc_id") % 3).cast("int"))
    rows = table(spark, sf_dir, "documents").select("n_chars", mode.alias("mode"))
    longest = F.when(F.col("mode") == "sample", F.least(F.col("n_chars"), F.lit(100))).otherwise(F.col("n_chars"))
    return rows.groupBy("mode").agg(F.count_if(F.col("mode") != "query").alias("n_imported"), F.max(longest).alias("longest")).withColumn("wiped", F.col("mode") == "clean")


@query("""
with q as (select o_orderkey, o_orderkey % 4 as k, o_orderdate::date as d from orders)
select o_orderkey, case k when 0 then 2 when 1 then 1 else 0 end as n_answers, case k when 0 then strftime(d + 1, '%Y-%m-%d') || ';' || strftime(d - 1, '%Y-%m-%d') when 1 then strftime(d, '%Y-%m-%d') else '' end as days from q
""")
def dt9_calendar_answers(spark, sf_dir):
    """Questions of several parts answered only if every part names a day (DT9, SUP3)."""
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "明天是几号？昨天呢？").when(k == 1, "今天几号").when(k == 2, "明天是几号？为什么下雨？").otherwise("no question")
    days = C.answered_days(T.sentences(text), F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(days).alias("n_answers"), F.array_join(days, ";").alias("days"))
