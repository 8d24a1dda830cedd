"""Calendar queries: lunar dates over ``orders``, questions over ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lunar
from ..functions.calendar import small_numeral
from ..operators import calendar_answers as A
from ..operators.joins import points_in_ranges
from ..session import table
from .registry import query

#: The twins' own lunar calendar, of 1988 to 2001: for each year the new-year day and the bits of a published
#: table (lowest four: leap month; next twelve, from the first month down: 30 days; the highest: 30 days in the leap month).
_YEARS = """
y(y, start, code) as (values (1988, date '1988-02-17', 43872), (1989, date '1989-02-06', 38256), (1990, date '1990-01-27', 19189), (1991, date '1991-02-15', 18800),
    (1992, date '1992-02-04', 25776), (1993, date '1993-01-23', 29859), (1994, date '1994-02-10', 59984), (1995, date '1995-01-31', 27480), (1996, date '1996-02-19', 23232),
    (1997, date '1997-02-07', 43872), (1998, date '1998-01-28', 38613), (1999, date '1999-02-16', 37600), (2000, date '2000-02-05', 51552), (2001, date '2001-01-24', 55636)),
mm as (select y, start, m, false as leap, 29 + (code // (65536 // (2 ** m)::int)) % 2 as days from y, range(1, 13) t(m)
    union all select y, start, code % 16, true, 29 + code // 65536 from y where code % 16 > 0),
months as (select y, m, leap, days, start + coalesce(sum(days) over (partition by y order by m, leap rows between unbounded preceding and 1 preceding), 0)::int as start from mm)
"""


@query(f"""
with {_YEARS}
select o_orderkey, y as lunar_year, m::int as lunar_month, leap, (o_orderdate::date - start + 1)::int as lunar_day
from orders join months on o_orderdate::date between start and start + days::int - 1
""")
def dt5_lunar_days(spark, sf_dir):
    """The lunar date of every order's day: an interval join with the table of months."""
    epoch = F.lit("1970-01-01").cast("date")
    months = lunar.lunar_months(spark)
    ranges = months.select("lunar_year", "lunar_month", "leap", F.datediff("start", epoch).alias("first"), (F.datediff("start", epoch) + F.col("days") - 1).alias("last"))
    points = table(spark, sf_dir, "orders").select("o_orderkey", F.datediff("o_orderdate", epoch).alias("at"))
    hit = points_in_ranges(points, ranges, [], "at", "first", "last", bucket=32)
    return hit.select("o_orderkey", "lunar_year", "lunar_month", "leap", (F.col("at") - F.col("first") + 1).alias("lunar_day"))


@query(f"""
with {_YEARS},
q as (select o_orderkey, year(o_orderdate) as y, (o_orderkey % 12 + 1)::int as m, (o_orderkey // 12 % 30 + 1)::int as d from orders),
hit as (select q.o_orderkey, min(start + d - 1) as day from q join months n on n.m = q.m and not leap and d <= days and year(start + d - 1) = q.y group by all)
select o_orderkey, m as lunar_month, d as lunar_day, hit.day::date as day from q left join hit using (o_orderkey)
""")
def dt5_lunar_to_solar(spark, sf_dir):
    """A lunar month and day found in the solar year of every order: the first such day, null where the year has none."""
    n = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(
        n, F.year("o_orderdate").alias("year"), (n % 12 + 1).cast("int").alias("lunar_month"), (F.floor(n / 12) % 30 + 1).cast("int").alias("lunar_day")
    )
    months = lunar.lunar_months(spark).where(~F.col("leap"))
    each = months.select("lunar_month", F.explode(F.sequence(F.lit(1), F.col("days"))).alias("lunar_day"), F.col("start"))
    each = each.select("lunar_month", "lunar_day", F.date_add("start", F.col("lunar_day") - 1).alias("day"))
    days = each.groupBy("lunar_month", "lunar_day", F.year("day").alias("year")).agg(F.min("day").alias("day"))
    return orders.join(days, ["lunar_month", "lunar_day", "year"], "left").select("o_orderkey", "lunar_month", "lunar_day", "day")


@query(f"""
with {_YEARS},
f(festival, m, d) as (values ('春节', 1, 1), ('元宵节', 1, 15), ('端午节', 5, 5), ('七夕节', 7, 7), ('中秋节', 8, 15), ('重阳节', 9, 9), ('腊八节', 12, 8)),
days as (select festival, year(start + d - 1) as y, min(start + d - 1) as day from f join months using (m) where not leap and d <= days group by all),
o as (select year(o_orderdate) as y, count(*) as n, count(*) filter (o_orderdate::date = days.day) as on_the_day, festival, any_value(days.day)::date as day
    from orders join days on days.y = year(o_orderdate) group by 1, festival)
select festival, y::int as year, day, n, on_the_day from o
""")
def sup2_lunar_festivals(spark, sf_dir):
    """The day of each lunar festival in each year of orders, with the orders of the year and of the day."""
    days = lunar.festival_days(lunar.lunar_months(spark))
    daily = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("on")).agg(F.count(F.lit(1)).alias("n"))
    joined = daily.withColumn("year", F.year("on")).join(days, "year")
    return joined.groupBy("festival", "year", "day").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("on") == F.col("day"), F.col("n"))), F.lit(0)).alias("on_the_day"))


#: Questions by number; each may use the month and day words of its row.
_ASKED = (
    "明天是几号？昨天呢？", "上周六是几月几号", "下下周一呢？大后天是星期几", "{m}月{d}号是星期几", "{M}月{D}日是周几？", "明年中秋节 是几号", "What is the date of Father’s Day next year?",
    "清明节是哪一天", "今天天气怎么样，是几号", "  Today?! ", "What day is it tomorrow, what time?", "今天几点了，是几号", "三年前的端午节是几号；2031年清明节呢", "明天是几号？为什么下雨",
    "今天会议安排", "Happy birthday to you",
)


@query(f"""
with {_YEARS},
c as (select conv_id * 100 + turn as id, conv_id, turn, coalesce(text, '') as text, (conv_id * 7 + turn * 5) % 16 as k,
    timestamp '1992-03-01 00:00:00' + to_seconds((conv_id * 7919 + turn * 104729) % 180000000) as now from conversations),
p as (select *, now::date as d, (conv_id % 12 + 1)::int as m, ((conv_id + turn) % 31 + 1)::int as n, (conv_id + turn) % 5 = 0 as more, strftime(now, '%H:%M:%S') as clock from c),
w as (select *, ['一', '二', '三', '四', '五', '六', '日'] as wk, d - (isodow(d) - 1)::int as monday from p),
f(lk, m, d, plus) as (values (5, 8, 15, 1), (12, 5, 5, -3)),
lunar as (select lk, year(start + f.d - 1) - plus as y, min(start + f.d - 1)::date as day from f join months using (m) where not leap and f.d <= days group by all),
x as (select w.*, l.day as ld, case k when 0 then d + 1 when 1 then monday - 2 when 2 then monday + 14 when 3 then try_cast(year(d) || '-' || m || '-' || n as date)
    when 4 then try_cast(year(d) || '-' || m || '-' || n as date) when 5 then l.day
    when 6 then make_date(year(d) + 1, 6, 1) + ((7 - isodow(make_date(year(d) + 1, 6, 1)))::int + 14) when 9 then d when 10 then d + 1 when 11 then d when 12 then l.day end as a
    from w left join lunar l on l.lk = w.k and l.y = year(d)),
z as (select *, year(a) || '年' || month(a) || '月' || day(a) || '日' as za, '星期' || wk[isodow(a)] as zw, strftime(a, ' %B ') || day(a) || ', ' || year(a) || strftime(a, ' (%A).') as ea,
    case k when 0 then d - 1 when 2 then d + 3 when 12 then date '2031-04-05' end as b from x),
r as (select *, year(b) || '年' || month(b) || '月' || day(b) || '日' as zb, '星期' || wk[isodow(b)] as zbw from z)
select id, case when more and regexp_matches(text, '[^\\s?？!！。；;]') then null when a is null then null else case k
    when 0 then '明天是' || za || '，' || zw || '。' || chr(10) || '昨天的日期是' || zb || '（' || zbw || '）。'
    when 1 then '上周六是' || za || '（' || zw || '）。'
    when 2 then '下下周一是' || za || '（' || zw || '）。' || chr(10) || '大后天是' || zb || '，' || zbw || '。'
    when 3 then za || '，' || zw || '。' when 4 then za || '，' || zw || '。'
    when 5 then '中秋节是' || za || '（' || zw || '）。'
    when 6 then '父亲节 will be' || ea when 9 then 'Today is' || ea when 10 then 'Tomorrow will be' || ea || ' The current time is ' || clock || '.'
    when 11 then '今天是' || za || '，' || zw || '。当前时间' || clock || '。'
    when 12 then '端午节是' || za || '（' || zw || '）。' || chr(10) || '清明节是' || zb || '（' || zbw || '）。' end end as answer from r
""")
def dt9_resolved_questions(spark, sf_dir):
    """Every turn asks one of sixteen questions at a time of its own; every fifth has the turn's whole text behind it (DT9, SUP2, SUP3)."""
    c, turn = F.col("conv_id"), F.col("turn")
    numerals = F.array(*[F.lit(small_numeral(i)) for i in range(1, 32)])
    m, d = (c % 12 + 1).cast("int"), ((c + turn) % 31 + 1).cast("int")

    def said(text: str):
        words = {"{m}": m.cast("string"), "{d}": d.cast("string"), "{M}": F.get(numerals, m - 1), "{D}": F.get(numerals, d - 1)}
        out = F.lit(text)
        for mark, word in words.items():
            out = F.replace(out, F.lit(mark), word) if mark in text else out
        return out

    asked = F.get(F.array(*map(said, _ASKED)), ((c * 7 + turn * 5) % 16).cast("int"))
    text = F.when((c + turn) % 5 == 0, F.concat(asked, F.lit("？"), F.coalesce("text", F.lit("")))).otherwise(asked)
    now = F.timestamp_seconds(F.unix_timestamp(F.lit("1992-03-01 00:00:00")) + (c * 7919 + turn * 104729) % 180000000)
    questions = table(spark, sf_dir, "conversations").select((c * 100 + turn).alias("id"), text.alias("question"), now.alias("now"))
    festivals = lunar.festival_days(lunar.lunar_months(spark))
    return A.calendar_answers(questions, festivals, "id", "question", "now").select("id", "answer")
