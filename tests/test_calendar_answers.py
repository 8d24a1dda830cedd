"""The lunar calendar against published days, and answers to questions of several parts."""

import datetime as dt

import pytest

from lorewright.functions import lunar
from lorewright.operators.calendar_answers import calendar_answers


@pytest.fixture(scope="module")
def months(spark):
    return lunar.lunar_months(spark).collect()


def test_published_new_years_and_leap_months(months):
    years = {r.lunar_year: r.start for r in months if r.lunar_month == 1 and not r.leap}
    published = "1900-01-31 1912-02-18 1949-01-29 1985-02-20 2000-02-05 2008-02-07 2020-01-25 2024-02-10 2025-01-29 2026-02-17 2033-01-31 2034-02-19 2050-01-23 2099-01-21"
    assert [str(years[int(x[:4])]) for x in published.split()] == published.split()
    leaps = {r.lunar_year: r.lunar_month for r in months if r.leap}
    assert {y: leaps.get(y) for y in (1984, 1985, 1995, 2001, 2004, 2006, 2009, 2012, 2014, 2017, 2020, 2023, 2025, 2028, 2033)} == {
        1984: 10, 1985: None, 1995: 8, 2001: 4, 2004: 2, 2006: 7, 2009: 5, 2012: 4, 2014: 9, 2017: 6, 2020: 4, 2023: 2, 2025: 6, 2028: 5, 2033: 11
    }
    assert len(leaps) == 74 and len(years) == 200


def test_months_follow_each_other(months):
    rows = sorted(months, key=lambda r: r.start)
    assert all(a.start + dt.timedelta(days=a.days) == b.start and a.days in (29, 30) for a, b in zip(rows, rows[1:], strict=False))
    assert all(b.lunar_month == (a.lunar_month if b.leap else a.lunar_month % 12 + 1) for a, b in zip(rows, rows[1:], strict=False))


NOW = dt.datetime(2026, 11, 28, 9, 30, 5)  # a Saturday
CASES = [
    ("明天是几号？昨天呢？", None, "明天是2026年11月29日，星期日。\n昨天的日期是2026年11月27日（星期五）。"),
    ("明天是几号？为什么下雨", None, None),
    ("今天天气怎么样，是几号", None, None),
    ("今天 会议安排", None, None),
    ("昨天？", None, "昨天的日期是2026年11月27日（星期五）。"),
    ("上周六是几号", None, "上周六是2026年11月21日（星期六）。"),
    ("下下星期三呢？是星期几号", None, None),
    ("下下星期三是哪天", None, "下下星期三是2026年12月9日（星期三）。"),
    ("2月30日是星期几", None, None),
    ("二月二十八号是星期几", None, "2026年2月28日，星期六。"),
    ("五月一号是几号", 2031, "2031年5月1日，星期四。"),
    ("2033年春节是几月几号", None, "春节是2033年1月31日（星期一）。"),
    ("前年的中秋节 是哪天", None, "中秋节是2024年9月17日（星期二）。"),
    ("两年后清明是哪天", None, "清明节是2028年4月5日（星期三）。"),
    ("1999年清明节是哪天", None, None),
    ("When is fathers day, what's the date", None, "父亲节 was June 21, 2026 (Sunday)."),
    ("What's the date today, what time", None, "Today is November 28, 2026 (Saturday). The current time is 09:30:05."),
    ("现在几点了，今天几号", None, "今天是2026年11月28日，星期六。当前时间09:30:05。"),
    ("what day is it the day before yesterday", None, "The day before yesterday was November 26, 2026 (Thursday)."),
    ("breaking news: today?", None, None),
    ("", None, None),
    (None, None, None),
]


def test_answers(spark, months):
    rows = [(i, q, NOW, a) for i, (q, a, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id long, q string, now timestamp, year int")
    festivals = lunar.festival_days(spark.createDataFrame(months))
    got = {r.id: r for r in calendar_answers(df, festivals, "id", "q", "now", "year").collect()}
    assert len(got) == len(CASES)
    for i, (q, _, want) in enumerate(CASES):
        assert got[i].answer == want, (q, got[i].answer)
    assert (got[0].n_parts, got[0].n_resolved) == (2, 2) and (got[1].n_parts, got[1].n_resolved) == (2, 1)
    assert calendar_answers(df.limit(0), festivals, "id", "q", "now").count() == 0
