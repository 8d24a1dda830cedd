"""Dates in text and calendar rules (DT1-DT15, SUP1-SUP3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relative day words and weekday names.
RELATIVE_DAYS = {
    "大前天": -3, "前天": -2, "昨天": -1, "今天": 0, "明天": 1, "后天": 2, "大后天": 3,
    "day before yesterday": -2, "yesterday": -1, "today": 0, "tomorrow": 1, "day after tomorrow": 2,
}
WEEKDAYS = {"一": 0, "二": 1, "三": 2, "四": 3, "五": 4, "六": 5, "日": 6, "天": 6, "monday": 0, "tuesday": 1, "wednesday": 2, "thursday": 3, "friday": 4, "saturday": 5, "sunday": 6}
#: The weekday festivals as (month, n-th, weekday), Monday 0.
WEEKDAY_FESTIVALS = {"母亲节": (5, 2, 6), "父亲节": (6, 3, 6), "感恩节": (11, 4, 3), "mother's day": (5, 2, 6), "father's day": (6, 3, 6), "thanksgiving": (11, 4, 3)}
#: Month and century constant of each solar term, 2000-2099.
SOLAR_TERMS = {
    "小寒": (1, 5.4055), "大寒": (1, 20.12), "立春": (2, 3.87), "雨水": (2, 18.73), "惊蛰": (3, 5.63), "春分": (3, 20.646), "清明": (4, 4.81), "谷雨": (4, 20.1),
    "立夏": (5, 5.52), "小满": (5, 21.04), "芒种": (6, 5.678), "夏至": (6, 21.37), "小暑": (7, 7.108), "大暑": (7, 22.83), "立秋": (8, 7.5), "处暑": (8, 23.13),
    "白露": (9, 7.646), "秋分": (9, 23.042), "寒露": (10, 8.318), "霜降": (10, 23.438), "立冬": (11, 7.438), "小雪": (11, 22.36), "大雪": (12, 7.18), "冬至": (12, 21.94),
}
_DIGITS = "零一二三四五六七八九"


def small_numeral(n: int) -> str:
    """DT7: 0 to 99 in Chinese numerals."""
    tens, ones = divmod(n, 10)
    return _DIGITS[ones] if not tens else ("" if tens == 1 else _DIGITS[tens]) + "十" + (_DIGITS[ones] if ones else "")


def numeral_value(text: Column) -> Column:
    """DT7: the number that a numeral from 0 to 99 names, null for others."""
    table = F.create_map(*[F.lit(x) for n in range(100) for x in (small_numeral(n), n)])
    return F.coalesce(F.try_element_at(table, text), F.try_to_number(F.nullif(F.regexp_extract(text, r"^(\d{1,2})$", 1), F.lit("")), F.lit("99")).cast("int"))


def relative_day(text: Column, today: Column) -> Column:
    """DT1: the day that the longest relative word in a text names."""
    low = F.lower(text)
    ranked = sorted(RELATIVE_DAYS, key=lambda w: (-len(w), w))
    return F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.date_add(today, RELATIVE_DAYS[w])) for w in ranked])


def weekday_expression(text: Column, today: Column) -> Column:
    """DT2: last, this or next week's weekday."""
    low = F.lower(text)
    day = F.regexp_extract(low, r"(?:周|星期|礼拜)([一二三四五六日天])|\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b", 0)
    table = F.create_map(*[F.lit(x) for kv in WEEKDAYS.items() for x in kv])
    k = F.try_element_at(table, F.regexp_replace(day, "^(?:周|星期|礼拜)", ""))
    week = F.when(F.rlike(low, F.lit("上(?:个)?(?:周|星期|礼拜)|last ")), -1).when(F.rlike(low, F.lit("下(?:个)?(?:周|星期|礼拜)|next ")), 1).otherwise(0)
    return F.when(k.isNotNull(), F.date_add(F.date_sub(today, F.weekday(today)), 7 * week + k))


def nth_weekday(year: Column, month: Column, n: Column, weekday: Column) -> Column:
    """DT3: the n-th weekday (Monday 0) of a month, null where the month has fewer."""
    first = F.make_date(year, month, F.lit(1))
    day = F.date_add(first, (F.pmod(weekday - F.weekday(first), F.lit(7)) + 7 * (n - 1)).cast("int"))
    return F.when(F.month(day) == month, day)


def solar_term(year: Column, month: int, constant: float) -> Column:
    """DT4: the day of a solar term, for 2000-2099."""
    y = F.pmod(year, F.lit(100))
    leap = F.floor((y - 1) / 4) if month <= 2 else F.floor(y / 4)
    day = (F.floor(y * F.lit(0.2422) + F.lit(constant)) - leap).cast("int")
    return F.when(year.between(2000, 2099), F.make_date(year, F.lit(month), day))


def festival(text: Column, year: Column) -> Column:
    """SUP1: the weekday festival or solar term that a text names, the longest name first."""
    low = F.lower(text)
    named = [(w, nth_weekday(year, *[F.lit(x) for x in r])) for w, r in WEEKDAY_FESTIVALS.items()]
    named += [(w, solar_term(year, *r)) for w, r in SOLAR_TERMS.items()]
    return F.coalesce(*[F.when(F.contains(low, F.lit(w)), day) for w, day in sorted(named, key=lambda x: -len(x[0]))])


def target_year(text: Column, anchor: Column, now: Column) -> Column:
    """DT6: an explicit year, this, last or next year, n years ago or on, the anchor's, now's."""
    explicit = F.nullif(F.regexp_extract(text, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1), F.lit("")).cast("int")
    ago = F.nullif(F.regexp_extract(text, r"(\d{1,2})\s*(?:年前|years? ago)", 1), F.lit("")).cast("int")
    later = F.nullif(F.regexp_extract(text, r"(\d{1,2})\s*(?:年后|years? later)", 1), F.lit("")).cast("int")
    y = F.year(now)
    word = F.when(F.rlike(text, F.lit("(?i)今年|this year")), y).when(F.rlike(text, F.lit("(?i)去年|last year")), y - 1).when(F.rlike(text, F.lit("(?i)明年|next year")), y + 1)
    return F.coalesce(explicit, word, y - ago, y + later, F.year(anchor), y)


def month_day(text: Column, year: Column) -> Column:
    """DT8: an explicit month and day; an impossible one is null."""
    m, d = (F.regexp_extract(text, r"(\d{1,2})月(\d{1,2})[日号]", i) for i in (1, 2))
    return F.when(m != "", F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"))


#: Date patterns in the order in which they are tried, and the groups of year (0: none), month and day.
#: The first that matches decides, even if its date does not exist. A day after a separator ends at its shortest form.
DATE_PATTERNS = (
    (r"(20\d{2})[-/.](0?[1-9]|1[0-2])[-/.](0?[1-9]|[12]\d|3[01])", (1, 2, 3)),
    (r"(20\d{2})\s*年\s*(0?[1-9]|1[0-2])\s*月\s*(0?[1-9]|[12]\d|3[01])\s*日", (1, 2, 3)),
    (r"(20\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])", (1, 2, 3)),
    (r"(20\d{2})[-/.](0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])", (1, 2, 3)),
    (r"(0?[1-9]|1[0-2])\s*月\s*(0?[1-9]|[12]\d|3[01])\s*日", (0, 1, 2)),
)


_SHORTEST_DAY, _WHOLE_DAY = r"(0?[1-9]|[12]\d|3[01])", r"(3[01]|[12]\d|0?[1-9])(?!\d)"


def found_date(text: Column, now: Column, as_written: bool = True) -> Column:
    """DT10: the date in a text; one without a year is in that of ``now``. Empty and null texts have none.

    As written, "2024/11/28" is the second of November: a day after a separator ends at its shortest form.
    Otherwise days are read whole.
    """
    out = None
    for pattern, (y, m, d) in DATE_PATTERNS:
        pattern = pattern if as_written else pattern.replace(_SHORTEST_DAY, _WHOLE_DAY)
        year = F.regexp_extract(text, pattern, y) if y else F.year(now).cast("string")
        day = F.try_to_date(F.concat_ws("-", year, *[F.lpad(F.regexp_extract(text, pattern, i), 2, "0") for i in (m, d)]), "yyyy-MM-dd")
        hit = F.rlike(text, F.lit(pattern))
        out = F.when(hit, day) if out is None else out.when(hit, day)
    return out


def found_in(now: Column, *texts: Column) -> Column:
    """DT10: title, then content, then URL."""
    return F.coalesce(*[found_date(t, now) for t in texts])


def iso_z(ts: Column) -> Column:
    """DT12."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_clock_question(text: Column) -> Column:
    """DT14: asks for the time of day."""
    return F.rlike(text, F.lit("(?i)几点|现在时间|what time")) & ~F.rlike(text, F.lit("(?i)时差|黄历|农历|time zone|lunar"))


def answered_days(parts: Column, today: Column) -> Column:
    """DT9, SUP3: the days that the parts of a question name, as ISO text; none unless every part names one."""
    days = F.transform(parts, lambda p: F.date_format(relative_day(p, today), "yyyy-MM-dd"))
    return F.when((F.size(days) > 0) & F.forall(days, lambda d: d.isNotNull()), days).otherwise(F.array().cast("array<string>"))
