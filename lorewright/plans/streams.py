"""Books, formulas, dates and streams over ``documents``, ``conversations`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import tex
from ..operators import books
from ..operators import windows as W
from ..session import table
from ..sources import readers
from ..streaming import streams as S
from .registry import query


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each conversation's texts as a token stream."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "(?<= )", -1)).alias("p", "token_text"))
    return rows.select(F.col("conv_id").cast("string").alias("chat_id"), (F.shiftleft("turn", 32) + F.col("p")).alias("token_index"), "token_text")


@query()
def str5_segments(spark, sf_dir):
    """Sentence segments of every conversation's token stream."""
    return S.segments_of_batch(tokens(spark, sf_dir))


@query()
def str11_rate_limit(spark, sf_dir):
    """Decisions of one token bucket for each user."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("request_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return S.rate_limited_batch(rows, 1)


@query("""
select time_bucket(interval 1 hour, ts) as start, time_bucket(interval 1 hour, ts) + interval 1 hour as "end", event_type, count(*) as n, round(sum(value), 4) as total from events group by all
""")
def str_tumbling_windows(spark, sf_dir):
    """Hourly windows."""
    out = S.tumbling(table(spark, sf_dir, "events"), "ts", "event_type", "value", "1 hour", "10 minutes")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as first from events),
s as (select user_id, ts, sum(first) over (partition by user_id order by ts rows unbounded preceding) as s from e)
select min(ts) as start, max(ts) + interval 30 minute as "end", user_id, count(*) as n from s group by user_id, s
""")
def str14_sessions(spark, sf_dir):
    """Sessions with a gap of half an hour."""
    out = S.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "30 minutes", "10 minutes")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


@query("select user_id, arg_max(event_type, (ts, event_type)) as status, max(ts) as at from events group by 1")
def str12_latest_status(spark, sf_dir):
    """Latest status of each task."""
    return S.latest_status(table(spark, sf_dir, "events").withColumnRenamed("event_type", "status"), "user_id", "ts", "status")


@query()
def mx14_chunks(spark, sf_dir):
    """Documents packed to chunks."""
    return books.chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "part", "n_parts", F.md5("content").alias("content_md5"))


def _cut(mark: str, n: int) -> str:
    at = f"(3001 - {n} - strpos(reverse(seg), {mark}))"
    return f"case when strpos(reverse(seg), {mark}) > 0 and {at} >= 1500 then start + {at} + {n} end"


_CUTS = ", ".join([*[_cut(f"'{m}'", 1) for m in "。！？"], _cut("chr(10) || chr(10)", 2), _cut("'；'", 1)])


@query(f"""
with recursive p as (
  select doc_id, text, length(text) as len, 0 as start from documents
  union all
  select doc_id, text, len, greatest(e - 300, start + 1) from (select *, coalesce({_CUTS}, start + 3000) as e from (select *, substring(text, (start + 1)::int, 3000) as seg from p where len > 3000 and start + 3000 < len)) where e < len),
q as (select *, case when len > 3000 and start + 3000 < len then coalesce({_CUTS}, start + 3000) else len end as e from (select *, substring(text, (start + 1)::int, 3000) as seg from p))
select doc_id, row_number() over (partition by doc_id order by start) as piece, md5(substring(text, (start + 1)::int, (e - start)::int)) as text_md5 from q
""")
def win15_pieces(spark, sf_dir):
    """The overlapping pieces of every text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(books.pieces(F.col("text"))).alias("p", "piece_text"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("piece"), F.md5("piece_text").alias("text_md5"))


@query("""
with l as (select doc_id, length(text) - length(replace(text, chr(10), '')) + 1 as last from documents)
select doc_id, s.s as start, least(s.s + 19, last) as "end" from l, lateral (select unnest(range(1, greatest(1, last - 5) + 1, 15)) as s) s
""")
def win14_line_windows(spark, sf_dir):
    """Overlapping windows of twenty lines."""
    spans = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("last"))
    return W.fixed_windows(spans, "doc_id", "last", 20, 5)


@query()
def win13_consistent_anchors(spark, sf_dir):
    """The best increasing chain of each order's lines."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("pos"), F.col("l_partkey").alias("line"), F.col("l_discount").alias("confidence"))
    return books.consistent_anchors(rows)


@query()
def s15_unique_blocks(spark, sf_dir):
    """Greedy deduplication of each order's ranges."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("block_id"), F.col("l_returnflag").alias("title"),
        (F.col("l_partkey") % 50).alias("start"), (F.col("l_partkey") % 50 + F.col("l_quantity").cast("long")).alias("end"), F.col("l_discount").alias("confidence"),
    )
    return books.unique_blocks(rows)


@query("""
with r as (select l_orderkey as doc_id, l_partkey % 50 as start, l_partkey % 50 + l_quantity::bigint as "end" from lineitem),
c as (select *, greatest(1, coalesce(max("end") over (partition by doc_id order by start, "end" rows between unbounded preceding and 1 preceding) + 1, 1)) as cur from r),
e as (select doc_id, max("end") as covered from r group by 1)
select doc_id, cur as gap_start, start - 1 as gap_end from c where start > cur
union all select doc_id, greatest(1, covered + 1), 120 from e where greatest(1, covered + 1) <= 120
""")
def agg45_gaps(spark, sf_dir):
    """Uncovered line ranges."""
    s = F.col("l_partkey") % 50
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), s.alias("start"), (s + F.col("l_quantity").cast("long")).alias("end"))
    spans = rows.select("doc_id").distinct().select("doc_id", F.lit(1).cast("long").alias("first"), F.lit(120).cast("long").alias("last"))
    return W.gaps(rows, spans, "doc_id")


@query("""
with p as (select l_orderkey as k, l_linenumber * 15 as "at" from lineitem), r as (select l_orderkey as k, l_linenumber as id, l_partkey % 50 as s, l_partkey % 50 + l_quantity::bigint as e from lineitem)
select p.k, p."at", id from p join r on p.k = r.k and p."at" between s and e
""")
def jn12_points_in_ranges(spark, sf_dir):
    """Interval join within each order."""
    from ..operators.joins import points_in_ranges

    rows = table(spark, sf_dir, "lineitem")
    points = rows.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 15).alias("at"))
    ranges = rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id"), (F.col("l_partkey") % 50).alias("s"), (F.col("l_partkey") % 50 + F.col("l_quantity").cast("long")).alias("e"))
    return points_in_ranges(points, ranges, ["k"], "at", "s", "e", 16).select("k", "at", "id")


@query("""
with l as (select l_orderkey as k, l_linenumber as i, 1 + l_partkey % 4 as level from lineitem)
select k, i, level, (select max(i) from l p where p.k = l.k and p.i < l.i and p.level < l.level) as parent from l
""")
def jn19_parents(spark, sf_dir):
    """The nearest earlier row of a lower level."""
    from ..operators.joins import nearest_lower

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (1 + F.col("l_partkey") % 4).alias("level"))
    return nearest_lower(rows, "k", "i", "level", 4).select("k", "i", "level", "parent")


@query("""
select o_orderkey, (o_orderdate::date - (isodow(o_orderdate)::int - 1)) + 7 + 4 as next_friday,
       case when month(date_trunc('month', o_orderdate)::date + ((4 - (isodow(date_trunc('month', o_orderdate)) - 1) + 7) % 7 + 28)::int) = month(o_orderdate)
         then date_trunc('month', o_orderdate)::date + ((4 - (isodow(date_trunc('month', o_orderdate)) - 1) + 7) % 7 + 28)::int end as fifth_friday,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as iso from orders
""")
def dt2_weekdays(spark, sf_dir):
    """Weekday expressions, n-th weekdays and ISO dates (DT2, DT3, DT12)."""
    day = F.col("o_orderdate").cast("date")
    fifth = C.nth_weekday(F.year(day), F.month(day), F.lit(5), F.lit(4))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.weekday_expression(F.lit("next friday"), day).alias("next_friday"), fifth.alias("fifth_friday"), C.iso_z(F.col("o_orderdate")).alias("iso"))


_DATED = """
with t as (select o_orderkey, 'on ' || case o_orderkey % 7 when 0 then strftime(o_orderdate + interval 9 year, '%Y-%m-%d') when 1 then strftime(o_orderdate + interval 9 year, '%Y/%m/%d')
             when 2 then '2024年02月30日' when 3 then strftime(o_orderdate + interval 9 year, '%Y%m%d') when 4 then strftime(o_orderdate + interval 9 year, '%Y/%m%d')
             when 5 then strftime(o_orderdate, '%m月%d日') else 'no day' end || ' or so' as s from orders),
"""

def _date_sql() -> str:
    cases = " ".join(
        f"when regexp_matches(s, '{p}') then " + "try_cast(" + (f"regexp_extract(s, '{p}', {y})" if y else "'2024'") + "".join(f" || '-' || lpad(regexp_extract(s, '{p}', {i}), 2, '0')" for i in (m, d)) + " as date)"
        for p, (y, m, d) in C.DATE_PATTERNS
    )
    return _DATED.rstrip().rstrip(",") + f" select o_orderkey, case {cases} end as found from t"


@query(_date_sql())
def dt10_found_dates(spark, sf_dir):
    """The first date pattern that matches decides, even if its date is impossible."""
    day, r = F.col("o_orderdate") + F.expr("interval 9 years"), F.col("o_orderkey") % 7
    forms = {0: F.date_format(day, "yyyy-MM-dd"), 1: F.date_format(day, "yyyy/MM/dd"), 2: F.lit("2024年02月30日"), 3: F.date_format(day, "yyyyMMdd"), 4: F.date_format(day, "yyyy/MMdd"), 5: F.date_format("o_orderdate", "MM月dd日")}
    form = F.lit("no day")
    for k, v in forms.items():
        form = F.when(r == k, v).otherwise(form)
    s = F.concat(F.lit("on "), form, F.lit(" or so"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.found_in(F.lit("2024-06-01").cast("date"), s).alias("found"))


@query()
def tx7_normalised(spark, sf_dir):
    """Formula text normalised."""
    t = F.concat(F.lit(r"\( x "), F.col("text"), F.lit(r" \) and \boxed{y}"))
    return table(spark, sf_dir, "documents").select("doc_id", tex.normalised(t).alias("out"))


@query(r"""
with t as (select page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script[ \t\n\x0B\f\r]*>|<style\b.*?</style[ \t\n\x0B\f\r]*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') as t from pages)
select page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')) as text_md5 from t
""")
def src11_html_text(spark, sf_dir):
    """Plain text of pages by tag stripping."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(readers.html_text(F.col("html"))).alias("text_md5"))


def _streamed(spark, sf_dir, name: str, make, slices: int = 0):
    """Events read as a stream of files, what ``make`` does with them, written by the stream and read back.

    With ``slices``, events come in that many spans of time, earlier ones first: one run of the stream takes each up,
    and state and watermark outlive it. Then no event is late, in whatever order the table's files hold them.
    """
    from ..scratch import Scratch

    scratch, path = Scratch(spark, name), f"{sf_dir}/events.parquet"
    rows, folder = spark.read.parquet(path), scratch.path("in")  # a stream reads folders
    source = spark.readStream.schema(rows.schema)
    if slices:
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        ends = rows.agg(F.min(at).alias("first"), F.max(at).alias("last")).first()  # one row
        first, span = ends.first or 0, (ends.last or 0) - (ends.first or 0) + 1
        cuts = [first + span * i // slices for i in range(1, slices)]
        number = F.coalesce(sum((at >= F.lit(c)).cast("int") for c in cuts), F.lit(0)) if cuts else F.lit(0)
        for i in range(slices):
            rows.where(number == i).write.mode("append").parquet(folder)
            out = make(source.parquet(folder))
            S.run_to_files(out, scratch.path("out"), scratch.path("checkpoint"))
    else:
        rows.write.parquet(folder)
        out = make(source.option("maxFilesPerTrigger", 1).parquet(folder))
        S.run_to_files(out, scratch.path("out"), scratch.path("checkpoint"))
    return spark.read.schema(out.schema).parquet(scratch.path("out"))


@query("select event_id, user_id from events where ts >= timestamp '2024-01-05'")
def str1_tail(spark, sf_dir):
    """A tailed stream: rows after a time, each id once though it comes twice (STR1-STR3)."""

    def twice(rows):
        again = rows.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
        return S.tail(again, "event_id", "ts", "3000 days", "2024-01-05 00:00:00").select("event_id", "user_id")

    return _streamed(spark, sf_dir, "str1", twice)


@query("""
with w as (select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by 1, 2)
select start, event_type, n from w where start + interval 1 hour <= (select max(ts) - interval 10 minute from events)
""")
def str_windows_stream(spark, sf_dir):
    """Hourly windows of a stream, each written once the watermark has passed its end."""

    def hourly(rows):
        return S.tumbling(rows, "ts", "event_type", "value", "1 hour", "10 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")

    return _streamed(spark, sf_dir, "str-windows", hourly, slices=4)


@query("select conv_id, turn, 'a' || 'b' || replace(text, '<', '') as out from conversations where text is not null")
def str7_think_filter(spark, sf_dir):
    """Think blocks out of texts, a tag's attributes and case do not matter."""
    text = F.concat(F.lit("a<THINK k='v'>no <b></think >b"), F.translate("text", "<", ""))
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", S.without_thinking(text).alias("out"))


@query("""
select user_id, date_diff('microsecond', min(case when event_type = 'click' then ts end), min(case when event_type = 'view' then ts end)) / 1000000 as seconds from events group by 1
""")
def str8_think_seconds(spark, sf_dir):
    """Seconds from the first opening to the first closing tag."""
    text = F.when(F.col("event_type") == "click", "x <think a>").when(F.col("event_type") == "view", "</think>").otherwise("plain")
    return S.think_seconds(table(spark, sf_dir, "events").withColumn("text", text), "user_id", "ts", "text")


@query("select event_id, case when event_id % 2 = 0 then 'direct' else 'buffered' end as streaming_source from events")
def str10_tagged_tokens(spark, sf_dir):
    """Tokens kept with the stream that they came from."""
    rows = table(spark, sf_dir, "events").select("event_id")
    return S.tagged(rows.where("event_id % 2 = 0"), "direct").union(S.tagged(rows.where("event_id % 2 = 1"), "buffered"))


@query("""
with q as (select conv_id, coalesce(arg_min(text, (turn, role)), '') as q, coalesce(arg_max(text, (turn, role)), '') as a from conversations group by 1)
select conv_id, length(q) as prompt, length(a) as completion, length(q) + length(a) as total, case when a = '' then 'empty' else 'stop' end as finish_reason from q
""")
def sup34_usage(spark, sf_dir):
    """Usage as lengths, and why an answer ended."""
    at = F.struct("turn", "role")
    chats = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", at).alias("q"), F.max_by("text", at).alias("a"))
    return S.usage(chats, "conv_id", "q", "a")


@query("select p_partkey, '$' || p_partkey || '$' as question, '$x$ ' || p_name as answer, '$a$|$$b$$' as steps from part")
def tx8_repaired_records(spark, sf_dir):
    """Formulas of a record's fields and steps repaired."""
    step = lambda t: F.struct(F.lit(t).alias("text"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(r"\( "), F.col("p_partkey").cast("string"), F.lit(r" \)")).alias("question"), F.concat(F.lit("$ x $ "), "p_name").alias("answer"), F.array(step(r"\(a\)"), step(r"\[b\]")).alias("steps"))
    done = tex.repaired(["question", "answer"], "steps")
    return rows.select("p_partkey", done["question"].alias("question"), done["answer"].alias("answer"), F.array_join(done["steps"], "|").alias("steps"))


@query("select p_partkey, '⟦F0⟧ and ⟦F1⟧ ' || p_name as text, 2::bigint as n, '$' || p_partkey || '$' as first from part")
def sup29_placeholders(spark, sf_dir):
    """Formulas set aside, how many, and the first one."""
    t = F.concat(F.lit("$"), F.col("p_partkey").cast("string"), F.lit("$ and $$b$$ "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", tex.set_aside(t).alias("r")).select("p_partkey", "r.text", "r.n", "r.first")


@query("select p_partkey, '抱歉。 ' || p_name as out from part")
def sup35_shown_segments(spark, sf_dir):
    """Segments as they are shown: formulas normalised, fixed replies mapped, verbs translated."""
    from ..functions import text as T

    t = tex.normalised(F.concat(F.lit("I don't know. "), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.translated_verbs(T.mapped_reply(t, {"I don't know.": "抱歉。"})).alias("out"))
