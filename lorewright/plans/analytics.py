"""Conversation analytics: metrics, filters, pages, lookups and sets over the star and event tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as L
from ..operators import joins as J
from ..operators import mutate as M
from ..operators import windows as W
from ..session import table
from .registry import query


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("""
select strftime(ts, '%Y-%m-%d') as day, count(*) as n, count(distinct user_id) as n_users,
       round(sum(value::decimal(18,6))::double / count(value), 6) as avg_value
from events group by 1
""")
def agg2_daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by day, in date order."""
    return (
        events(spark, sf_dir)
        .groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"), F.round(A.exact_mean("value"), 6).alias("avg_value"))
        .orderBy("day")
    )


@query("""
select count(*) as n, round(coalesce(sum(value::decimal(18,6))::double / count(value), 0), 6) as avg_value,
       count(*) filter (where event_type = 'click') as n_click,
       count(*) filter (where value >= 50) as n_high, trunc(coalesce(avg(value), 0))::bigint as whole_avg
from events
""")
def agg1_overall(spark, sf_dir):
    """Global averages and conditional counts."""
    return events(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.coalesce(A.exact_mean("value"), F.lit(0.0)), 6).alias("avg_value"),
        F.count_if(F.col("event_type") == "click").alias("n_click"),
        F.count_if(F.col("value") >= 50).alias("n_high"),
        A.average(F.col("value")).cast("long").alias("whole_avg"),
    )


@query("""
select user_id, count(*) as n, round(sum(value::decimal(18,6))::double / count(value), 6) as avg_value
from events group by 1 order by n desc, user_id limit 50
""")
def agg3_top_users(spark, sf_dir):
    """The 50 users with most conversations."""
    grouped = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(A.exact_mean("value"), 6).alias("avg_value"))
    return grouped.orderBy(F.desc("n"), "user_id").limit(50)


@query("""
select user_id, count(*) as n, round(sum(value::decimal(18,6))::double / count(value), 6) as avg_value, arg_min(event_type, (ts, event_id)) as first_type
from events group by 1
""")
def agg4_first_name(spark, sf_dir):
    """By owner, with the earliest name rather than any."""
    rank = F.struct("ts", "event_id")
    return events(spark, sf_dir).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(A.exact_mean("value"), 6).alias("avg_value"), F.min_by("event_type", rank).alias("first_type")
    )


@query("""
with g as (select case when value > 90 then null when value > 80 then '' else event_type end as intent, count(*) as n from events group by 1)
select case when intent is null or intent = '' then 'unknown' else intent end as intent, n from g
""")
def agg5_intents(spark, sf_dir):
    """By intent; null and empty intents are grouped apart and both shown as unknown."""
    intent = F.when(F.col("value") > 90, F.lit(None)).when(F.col("value") > 80, "").otherwise(F.col("event_type"))
    grouped = events(spark, sf_dir).groupBy(intent.alias("intent")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(A.labelled(F.col("intent")).alias("intent"), "n")


@query("""
with k as (select event_id, value, case when event_id % 7 = 0 then [] when event_id % 11 = 0 then null
             else [event_type, 'kb' || (event_id % 3)::varchar] end as kbs from events),
u as (select value, unnest(kbs) as kb from k where len(kbs) > 0 union all select value, null from k where kbs is null or len(kbs) = 0)
select coalesce(kb, 'none') as kb, count(*) as n, round(sum(value::decimal(18,6))::double / count(value), 6) as avg_value from u group by 1
""")
def agg6_unwound(spark, sf_dir):
    """By knowledge base after unwinding; rows without one are shown as none."""
    kbs = F.when(F.col("event_id") % 7 == 0, F.array().cast("array<string>")).when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(
        F.array("event_type", F.concat(F.lit("kb"), (F.col("event_id") % 3).cast("string")))
    )
    unwound = events(spark, sf_dir).select("value", F.explode_outer(kbs).alias("kb"))
    return unwound.groupBy(F.coalesce("kb", F.lit("none")).alias("kb")).agg(F.count(F.lit(1)).alias("n"), F.round(A.exact_mean("value"), 6).alias("avg_value"))


@query("""
select count(*) as total, count(*) filter (where event_type <> 'error') as n_answered,
       round(case when count(*) filter (where event_type = 'click') = 0 then 0
         else count(*) filter (where event_type = 'click' and value >= 60)::double / count(*) filter (where event_type = 'click') end, 6) as hit_rate,
       round(coalesce(avg(case when event_type = 'click' then value end), 0), 6) as avg_hit_value,
       round(count(*) filter (where value < 10)::double / count(*), 6) as low_rate
from events where ts between timestamp '2024-01-15' - interval 30 day and timestamp '2024-01-15'
""")
def agg7_retrieval_metrics(spark, sf_dir):
    """Hit and failure rates in a window that includes both of its ends."""
    rows = L.in_window(events(spark, sf_dir), "ts", datetime(2024, 1, 15), 30)
    click = F.col("event_type") == "click"
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("event_type") != "error").alias("n_answered"),
        F.round(A.percentage(F.count_if(click & (F.col("value") >= 60)), F.count_if(click)), 6).alias("hit_rate"),
        F.round(A.average(F.when(click, F.col("value"))), 6).alias("avg_hit_value"),
        F.round(F.count_if(F.col("value") < 10) / F.count(F.lit(1)), 6).alias("low_rate"),
    )


@query("""
with k as (select *, [event_type, 'kb' || (event_id % 3)::varchar] as kbs from events)
select count(*) as n, round(avg(case when value >= 60 then 1.0 else 0.0 end), 6) as hit_rate from k where list_contains(kbs, 'kb1')
""")
def agg8_kb_hit_rate(spark, sf_dir):
    """Hit rate of one knowledge base."""
    kbs = F.array("event_type", F.concat(F.lit("kb"), (F.col("event_id") % 3).cast("string")))
    rows = events(spark, sf_dir).where(F.array_contains(kbs, "kb1"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("value") >= 60).cast("double")), 6).alias("hit_rate"))


@query("""
select event_type as intent, strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by grouping sets ((event_type), (strftime(ts, '%Y-%m-%d')))
""")
def agg9_intents_and_days(spark, sf_dir):
    """Intent distribution and daily trend in one pass."""
    rows = events(spark, sf_dir).select(F.col("event_type").alias("intent"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return rows.groupingSets([["intent"], ["day"]], "intent", "day").agg(F.count(F.lit(1)).alias("n")).select("intent", "day", "n")


@query("""
select count(*) as n_errors, case when count(*) < 10 then 'healthy' else 'degraded' end as status from events
where event_type = 'error' and ts >= timestamp '2024-01-15' - interval 1 hour and ts <= timestamp '2024-01-15'
""")
def agg10_health(spark, sf_dir):
    """Errors of the last hour before a given moment."""
    now = F.lit(datetime(2024, 1, 15)).cast("timestamp_ntz")
    rows = events(spark, sf_dir).where((F.col("event_type") == "error") & F.col("ts").between(now - F.expr("interval 1 hour"), now))
    return rows.agg(F.count(F.lit(1)).alias("n_errors")).select("n_errors", F.when(F.col("n_errors") < 10, "healthy").otherwise("degraded").alias("status"))


@query("""
select user_id, max(ts) as last_time, count(*) as n_rows from events group by 1 order by last_time desc, user_id limit 20
""")
def agg12_latest_chats(spark, sf_dir):
    """The chats with the latest tokens."""
    return J.top_keys(events(spark, sf_dir), "user_id", "ts", 20)


@query("""
select conv_id, count(*) as n_turns, sum(length(coalesce(text, ''))) as n_chars,
       regexp_replace(string_agg(coalesce(text, ''), chr(10) order by turn, role), '(?is)<think\\b[^>]*>.*?</think\\s*>', '', 'g') as whole
from conversations group by 1
""")
def agg13_ordered_text(spark, sf_dir):
    """Texts of a session in order, without think blocks."""
    from ..functions.text import strip_think

    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("n_chars"),
        A.joined_in_order(F.coalesce("text", F.lit("")), F.col("turn"), F.col("role"), sep="\n").alias("whole"),
    )
    return grouped.select("conv_id", "n_turns", "n_chars", strip_think(F.col("whole")).alias("whole"))


@query("""
select string_agg(text, '' order by conv_id, turn) as whole from (select * from conversations where role = 'assistant' order by conv_id, turn limit 100)
""")
def agg14_first_chunks_joined(spark, sf_dir):
    """The first 100 chunks of one type as one text: the limit is the feature, and bounds the text."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").orderBy("conv_id", "turn").limit(100)
    return rows.agg(A.joined_in_order(F.col("text"), F.col("conv_id"), F.col("turn")).alias("whole"))


@query("select distinct event_type as value from events where trim(event_type) <> ''")
def agg15_distinct_values(spark, sf_dir):
    """Distinct non-blank values."""
    return events(spark, sf_dir).where(F.trim("event_type") != "").select(F.col("event_type").alias("value")).distinct()


@query("""
select o_custkey, o_orderstatus, o_orderkey from (select *, row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate desc, o_orderkey) as r from orders) where r = 1
""")
def agg16_keep_newest(spark, sf_dir):
    """One row for each key, the newest."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_orderdate")
    return A.keep_newest(rows, ["o_custkey", "o_orderstatus"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderstatus", "o_orderkey")


@query("""
select source, count(*) as n_chunks, sum(length(text)) as total_chars, sum(length(text)) // count(*) as avg_chars,
       count(*) filter (where text like '%' || chr(10) || '%') as n_multiline
from documents group by 1
""")
def agg17_chunk_statistics(spark, sf_dir):
    """Chunk counts, characters and floor average by source."""
    n = F.char_length("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(n).alias("total_chars"), F.expr("sum(char_length(text)) div count(*)").alias("avg_chars"),
        F.count_if(F.contains("text", F.lit("\n"))).alias("n_multiline"),
    )


@query("""
select count(*) as total, count(*) filter (where quality is null) as unreviewed, count(*) filter (where quality = 1) as correct,
       count(*) filter (where quality = 0) as incorrect from labels
""")
def agg20_review_counters(spark, sf_dir):
    """Counts by review state."""
    q = F.col("quality")
    return table(spark, sf_dir, "labels").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(q.isNull()).alias("unreviewed"), F.count_if(q == 1).alias("correct"), F.count_if(q == 0).alias("incorrect")
    )


@query("""
with l as (select *, l_orderkey * 10 + l_linenumber as pos, l_partkey as id from lineitem),
f as (select id, min(pos) as first from l group by 1 having count(*) > 1)
select pos, 'bad l_returnflag' as problem from l where l_returnflag not in ('A', 'N')
union all select pos, 'repeats ' || first::varchar from l join f using (id) where pos > first
""")
def agg21_violations(spark, sf_dir):
    """Broken rules: enumerations and repeated ids with their first position."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_partkey").alias("id"), "l_returnflag")
    return A.violations(rows, "id", "pos", ["l_returnflag"], {"l_returnflag": ["A", "N"]})


@query("""
select lang, count(*) as n_chunks, round(avg(n), 6) as avg_length, round(stddev_pop(n), 6) as std_dev,
       round(avg((n < 50)::int), 6) as short_share, round(avg((n > 1000)::int), 6) as long_share,
       round(case when avg(n) > 0 then 1 / (1 + stddev_pop(n) / avg(n)) else 0 end, 6) as uniformity
from (select lang, length(text) as n from documents) group by 1
""")
def agg23_chunk_quality(spark, sf_dir):
    """Spread of chunk lengths."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(*A.uniformity(F.char_length("text")))


@query("""
with c as (select doc_id, case when length(text) < 500 then 'short' when length(text) < 3000 then 'medium' else 'long' end as length_category,
             case when doc_id % 3 = 0 then 'left' when doc_id % 3 = 1 then 'right' else 'tie' end as winner from documents)
select length_category, count(*) filter (where winner = 'left') as left_wins, count(*) filter (where winner = 'right') as right_wins,
       count(*) filter (where winner = 'tie') as ties from c group by 1
""")
def agg24_winner_counts(spark, sf_dir):
    """Winners by length class, pivoted."""
    n, r = F.char_length("text"), F.col("doc_id") % 3
    rows = table(spark, sf_dir, "documents").select(
        F.when(n < 500, "short").when(n < 3000, "medium").otherwise("long").alias("length_category"), F.when(r == 0, "left").when(r == 1, "right").otherwise("tie").alias("winner")
    )
    out = rows.groupBy("length_category").pivot("winner", ["left", "right", "tie"]).count()
    return out.select("length_category", *[F.coalesce(a, F.lit(0)).alias(b) for a, b in (("left", "left_wins"), ("right", "right_wins"), ("tie", "ties"))])


@query("""
select event_type as label, count(*) as n, round(min(value), 6) as min_s, round(max(value), 6) as max_s, round(sum(value::decimal(18,6))::double / count(value), 6) as avg_s, round(sum(value), 3) as sum_s from events group by 1
""")
def agg25_label_timing(spark, sf_dir):
    """Label distribution with timing."""
    v = F.col("value")
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min(v), 6).alias("min_s"), F.round(F.max(v), 6).alias("max_s"), F.round(F.avg(v), 6).alias("avg_s"), F.round(F.sum(v), 3).alias("sum_s")
    )


@query("""
select count(*) as n, round(avg((quality = 1)::int), 6) as success_rate, round(avg(case when quality = 1 then n_chars end), 6) as avg_chars
from labels join documents using (doc_id)
""")
def agg26_success_summary(spark, sf_dir):
    """Success rate and averages over successes."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    good = F.col("quality") == 1
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(good.cast("double")), 6).alias("success_rate"), F.round(F.avg(F.when(good, F.col("n_chars"))), 6).alias("avg_chars"))


@query("""
with s as (select event_id, (value + (event_id % 100) + 100 - value) / 300 as overall from events)
select case when overall >= .8 then 'excellent' when overall >= .6 then 'good' when overall >= .4 then 'fair' else 'poor' end as grade,
       count(*) as n from s group by 1
""")
def agg27_grade_bands(spark, sf_dir):
    """Bands of the mean of three scores."""
    overall = (F.col("value") + (F.col("event_id") % 100) + 100 - F.col("value")) / 300
    grade = F.when(overall >= 0.8, "excellent").when(overall >= 0.6, "good").when(overall >= 0.4, "fair").otherwise("poor")
    return events(spark, sf_dir).groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with s as (select p_partkey, p_size * 2.0 * .2 + (p_partkey % 101) * .3 + 80 * .2 + p_size * 1.0 * .3 as score from part)
select case when score >= 90 then 'A' when score >= 80 then 'B' when score >= 70 then 'C' when score >= 60 then 'D' else 'F' end as letter, count(*) as n, round(avg(score), 4) as avg_score from s group by 1
""")
def agg28_weighted_grade(spark, sf_dir):
    """Weighted score and letter grade."""
    parts = [(F.col("p_size") * 2.0, 0.2), ((F.col("p_partkey") % 101).cast("double"), 0.3), (F.lit(80.0), 0.2), (F.col("p_size") * 1.0, 0.3)]
    score, _ = A.weighted_grade(parts)
    letter = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 80, "B").when(F.col("score") >= 70, "C").when(F.col("score") >= 60, "D").otherwise("F")
    return table(spark, sf_dir, "part").select(score.alias("score")).groupBy(letter.alias("letter")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("avg_score"))


@query("""
select event_type, round(quantile_cont(value, .5), 6) as p50, round(quantile_cont(value, .9), 6) as p90, round(quantile_cont(value, .95), 6) as p95,
       round(quantile_cont(value, .99), 6) as p99, round(sum(value::decimal(18,6))::double / count(value), 6) as mean from events group by 1
""")
def agg29_percentiles(spark, sf_dir):
    """Linearly interpolated percentiles."""
    rows = events(spark, sf_dir)
    found = A.exact_percentiles(rows, "event_type", "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    mean = rows.groupBy("event_type").agg(F.round(A.exact_mean("value"), 6).alias("mean"))
    return found.join(mean, "event_type").select("event_type", *[F.round(n, 6).alias(n) for n in ("p50", "p90", "p95", "p99")], "mean")


@query("""
with r as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as r,
             lead(value) over (partition by user_id order by ts, event_id) as nxt from events)
select user_id, (r - 1) // 2 as pair, round((1 - nxt / value) * 100, 6) as improvement from r where r % 2 = 1 and nxt is not null and value <> 0
""")
def agg30_pair_improvement(spark, sf_dir):
    """Improvement within each consecutive pair of runs."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events(spark, sf_dir).select("user_id", "value", F.row_number().over(w).alias("r"), F.lead("value").over(w).alias("nxt"))
    rows = rows.where("r % 2 = 1 and nxt is not null and value <> 0")
    return rows.select("user_id", F.floor((F.col("r") - 1) / 2).cast("long").alias("pair"), F.round((1 - F.col("nxt") / F.col("value")) * 100, 6).alias("improvement"))


@query("select p_type, count(*) as n, count(*) / (select count(*) from part)::double as ratio from part group by 1")
def agg31_type_distribution(spark, sf_dir):
    """Distribution of entity types."""
    return A.share(table(spark, sf_dir, "part"), "p_type")


@query("""
with d as (select e.k as k, count(*) as degree from (select 'o' || l_orderkey as k from lineitem union all select 'p' || l_partkey from lineitem) e group by 1)
select k as node, degree from d order by degree desc, k limit 50
""")
def agg40_degrees(spark, sf_dir):
    """Nodes of highest degree in the order-part graph."""
    from ..operators.graph import degrees

    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return degrees(edges, "src", "dst").orderBy(F.desc("degree"), "node").limit(50)


@query("""
select c_mktsegment, count(*) as n, count(*) filter (where c_acctbal > 0) as n_enabled, count(*) filter (where c_acctbal <= 0) as n_disabled from customer group by 1
""")
def agg47_owner_counts(spark, sf_dir):
    """Enabled and disabled rows of each owner (AGG44, AGG47)."""
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if(b > 0).alias("n_enabled"), F.count_if(b <= 0).alias("n_disabled"))


@query("""
with r as (select doc_id, lang, row_number() over (partition by lang order by sha256(doc_id::varchar || 'seed-1'), doc_id) as r from documents)
select doc_id, lang from r where lang = 'es' or r <= 20
""")
def agg46_stratified_sample(spark, sf_dir):
    """All of one stratum, a seeded sample of the others."""
    return A.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", "seed-1", 20, ["es"])


# Filters and pages.


@query("""
select event_id, user_id, event_type, value from events where event_type = 'click' and user_id = 7
""")
def fil1_optional_equalities(spark, sf_dir):
    """Equality filters that apply when given."""
    rows = L.equal_when_given(events(spark, sf_dir), {"event_type": "click", "user_id": 7, "value": None})
    return rows.select("event_id", "user_id", "event_type", "value")


@query("select event_id from events where ts >= '2024-01-05' and ts < '2024-01-10'")
def fil2_day_range(spark, sf_dir):
    """Half-open day range."""
    return L.in_days(events(spark, sf_dir), "ts", date(2024, 1, 5), date(2024, 1, 9)).select("event_id")


@query("select doc_id from documents where regexp_matches(text, '(?i)licen[cs]e') or regexp_matches(source, '(?i)licen[cs]e')")
def fil3_keyword(spark, sf_dir):
    """Case-insensitive keyword in two columns."""
    return table(spark, sf_dir, "documents").where(L.keyword(["text", "source"], "licen[cs]e")).select("doc_id")


@query("select doc_id from documents where contains(lower(text), 'mit license')")
def fil3b_literal_keyword(spark, sf_dir):
    """The same with a literal."""
    return table(spark, sf_dir, "documents").where(L.keyword(["text"], "MIT License", literal=True)).select("doc_id")


@query("select doc_id, quality from labels where quality = 0")
def fil7_review_state(spark, sf_dir):
    """Rows of one review state."""
    rows = table(spark, sf_dir, "labels")
    return rows.where(L.review_state("quality", 0)).select("doc_id", "quality")


@query("select o_orderkey, o_orderdate, o_totalprice from orders order by o_orderdate desc, o_orderkey limit 20 offset 40")
def win1_page(spark, sf_dir):
    """Third page of a listing, newest first."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return L.page(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], 3, 20)


@query("select count(*) as total, ceil(count(*) / 20.0)::bigint as total_pages, 3 < ceil(count(*) / 20.0) as has_next, true as has_prev from orders")
def win1b_page_info(spark, sf_dir):
    """Totals of that listing."""
    return L.page_info(table(spark, sf_dir, "orders"), 3, 20)


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc, role desc) as r from conversations) where r <= 3")
def win8_last_messages(spark, sf_dir):
    """The last three messages of each session."""
    return W.last_n(table(spark, sf_dir, "conversations"), "conv_id", F.struct("turn", "role"), 3).select("conv_id", "turn", "role")


@query("""
select conv_id, turn, last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as previous
from conversations
""")
def win9_previous_user_text(spark, sf_dir):
    """The last user text before each turn."""
    return W.previous_of_role(table(spark, sf_dir, "conversations"), "conv_id", "turn", "user", "text").select("conv_id", "turn", "previous")


@query("select conv_id, turn, (row_number() over (partition by conv_id order by turn) - 1) // 4 as batch from conversations")
def win16_batches(spark, sf_dir):
    """Batches of four turns."""
    return W.batches(table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn")], 4).select("conv_id", "turn", "batch")


# Lookups.


@query("""
select c_custkey, c_name, coalesce(n_name, '') as nation from customer left join (select * from nation where n_regionkey < 3) n on n_nationkey = c_nationkey
""")
def jn1_left_lookup(spark, sf_dir):
    """Owners with their settings, empty where there are none."""
    nations = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return J.lookup(table(spark, sf_dir, "customer"), nations, ["c_nationkey"]).select("c_custkey", "c_name", F.coalesce("n_name", F.lit("")).alias("nation"))


@query("""
with f as (select conv_id, arg_min(text, turn) as question from conversations where role = 'user' group by 1),
g as (select conv_id, count(*) as n from conversations group by 1)
select conv_id, n, question from g left join f using (conv_id)
""")
def jn4_first_question(spark, sf_dir):
    """Chats with their first user text."""
    rows = table(spark, sf_dir, "conversations")
    first = J.first_per_key(rows.where("role = 'user'"), "conv_id", [F.col("turn")], ["text"]).withColumnRenamed("text", "question")
    return J.lookup(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), first, ["conv_id"])


@query("""
with t as (select user_id from events group by 1 order by max(ts) desc, user_id limit 5) select event_id, user_id from events where user_id in (select user_id from t)
""")
def jn5_rows_of_top_chats(spark, sf_dir):
    """Tokens of the five latest chats."""
    rows = events(spark, sf_dir)
    return rows.join(J.top_keys(rows, "user_id", "ts", 5), "user_id", "left_semi").select("event_id", "user_id")


@query("select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def jn7_pending(spark, sf_dir):
    """Documents that no label covers yet."""
    return J.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""
select l_orderkey, l_linenumber, o_totalprice, s_name from lineitem join orders on o_orderkey = l_orderkey join supplier on s_suppkey = l_suppkey where l_quantity > 45
""")
def jn8_three_way(spark, sf_dir):
    """Nested inner joins."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_suppkey")
    out = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")
    return out.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey").select("l_orderkey", "l_linenumber", "o_totalprice", "s_name")


@query("""
with e as (select user_id, event_id, ts, value, event_type from events)
select c.event_id, (select p.value from e p where p.user_id = c.user_id and p.event_type = 'view' and p.ts <= c.ts order by p.ts desc limit 1) as last_view from e c where c.event_type = 'click'
""")
def jn18_asof(spark, sf_dir):
    """The latest earlier value of another kind of event."""
    rows = events(spark, sf_dir)
    seen = rows.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("last_view"))
    return J.asof(rows.where("event_type = 'click'").select("user_id", "event_id", "ts"), seen, "user_id", "ts", "last_view").select("event_id", "last_view")


@query("""
with e as (select distinct l_orderkey as o, l_partkey as p from lineitem), s as (select min(p) as start from e)
select distinct 'p' || e2.p as node, 'p' || start as start from s join e e1 on e1.p = s.start join e e2 on e2.o = e1.o where e2.p <> s.start
union select distinct 'o' || e1.o, 'p' || start from s join e e1 on e1.p = s.start
""")
def jn22_two_hops(spark, sf_dir):
    """Neighbourhood of a node within two steps."""
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    start = lines.agg(F.concat(F.lit("p"), F.min("l_partkey").cast("string")).alias("start"))
    return J.neighbours(edges, "src", "dst", start).select("node", "start")


# Sets.


@query("select lower(c_mktsegment) as word from customer union select lower(p_brand) from part")
def set1_union(spark, sf_dir):
    """Two word lists as one, lower-cased."""
    return table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("word")).union(table(spark, sf_dir, "part").select(F.lower("p_brand"))).distinct()


@query("select doc_id from documents intersect select doc_id from labels")
def set2_intersection(spark, sf_dir):
    """Ids that both tables have."""
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("select c_custkey as key from customer except select o_custkey from orders")
def set3_difference(spark, sf_dir):
    """Ids of one table that another lacks."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


# Mutation.


@query("""
with d as (select c_custkey, c_name, c_acctbal + 1 as c_acctbal from customer where c_custkey % 3 = 0 union all select c_custkey + 1000000, 'new', 0 from customer where c_custkey % 5 = 0)
select c_custkey, c_name, c_acctbal from customer where c_custkey not in (select c_custkey from d) union all select * from d
""")
def snk6_upsert(spark, sf_dir):
    """Upsert by key."""
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = base.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    new = base.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return M.upsert(base, changed.union(new), ["c_custkey"])


@query("select c_custkey, case when c_custkey % 4 = 0 then 'changed' else c_name end as c_name, c_acctbal from customer")
def snk7_partial_update(spark, sf_dir):
    """Only fields that are not null change."""
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    delta = base.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "changed").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"))
    return M.upsert(base, delta, ["c_custkey"], partial=True)


@query("select s_suppkey, s_name from supplier union all select c_custkey, c_name from customer where c_custkey not in (select s_suppkey from supplier)")
def snk8_insert_if_absent(spark, sf_dir):
    """Insert what is not there."""
    delta = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"))
    return M.insert_if_absent(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), delta, ["s_suppkey"])


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def snk9_delete(spark, sf_dir):
    """Delete by key."""
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return M.delete(table(spark, sf_dir, "orders"), gone, ["o_custkey"]).select("o_orderkey")


@query("""
select count(*) as total, count(*) filter (where doc_id not in (select doc_id from labels)) as inserted,
       count(*) filter (where doc_id in (select doc_id from labels)) as skipped, ceil(count(*) / 1000.0)::bigint as batches from documents
""")
def snk13_copy_stats(spark, sf_dir):
    """Copy without touching rows that exist."""
    return M.copy_missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id").distinct(), ["doc_id"])[1]


@query("""
with a as (select conv_id, list(turn order by turn) as t from conversations group by 1)
select conv_id, array_to_string(list_slice(list_concat(t, [1001, 1002]), greatest(1, len(t) + 2 - 3), len(t) + 2), ',') as kept from a
""")
def snk15_bounded_push(spark, sf_dir):
    """Two elements appended, the last four kept."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    kept = M.push_bounded(F.col("t"), F.array(F.lit(1001).cast("long"), F.lit(1002).cast("long")), 4)
    return rows.select("conv_id", F.array_join(kept.cast("array<string>"), ",").alias("kept"))


@query("""
select c_custkey, c_nationkey % 3 = 0 or c_acctbal < 0 or c_acctbal > 5000 as needs_update from customer
""")
def str13_needs_update(spark, sf_dir):
    """Incremental re-index decision."""
    synced = F.when(F.col("c_nationkey") % 3 == 0, F.lit(None)).otherwise(F.lit("05000.00"))
    update = F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.format_string("%08.2f", "c_acctbal"))
    return table(spark, sf_dir, "customer").select("c_custkey", M.needs_update(synced, update).alias("needs_update"))


@query("""
select c_custkey, o.i as owner, w.j as word from customer, (values ('a'), ('b')) o(i), (values ('x'), ('y'), ('z')) w(j)
""")
def sup9_fan_out(spark, sf_dir):
    """One row for each owner and word."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.array(F.lit("a"), F.lit("b")).alias("owners"), F.array(*map(F.lit, "xyz")).alias("words"))
    return M.fan_out(rows, "owners", "words")
