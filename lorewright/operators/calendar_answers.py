"""Questions about dates, answered part by part (DT9, SUP2, SUP3).

A question is cut into its parts. Every resolver looks at every part: an explicit month and day, a lunar
festival, a festival of a weekday, a solar term, a weekday of some week, a relative day; the first of them
that names a day decides. A question is answered only if each part is (``bool_and`` over its parts), and
its lines are put together in order. Resolvers are column expressions but for the lunar festivals, whose
days are a small table joined by festival and year.

A null or blank question, one that does not ask for a date, and one with a part that names no day have a
null answer; every question row gives one output row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import nth_weekday
from ..functions.lunar import LUNAR_FESTIVALS

#: Relative days, Chinese ones before English ones, and the words that answers use for them.
DAY_WORDS = {"大前天": -3, "前天": -2, "昨天": -1, "今天": 0, "明天": 1, "后天": 2, "大后天": 3}
DAY_WORDS_EN = {
    "three days ago": -3, "day before yesterday": -2, "yesterday": -1, "today": 0, "tomorrow": 1, "day after tomorrow": 2, "three days later": 3,
}
SPOKEN = {v: k for k, v in DAY_WORDS.items()}
SPOKEN_EN = {
    -3: "Three days ago", -2: "The day before yesterday", -1: "Yesterday", 0: "Today", 1: "Tomorrow", 2: "The day after tomorrow", 3: "Three days from now",
}
#: Years counted from this one, in the order in which they are looked for.
YEAR_WORDS = {"大前年": -3, "前年": -2, "去年": -1, "明年": 1, "后年": 2, "大后年": 3}
#: Weeks counted from this one, with the spellings that name them.
WEEKS = {"上上上周": -3, "上上周": -2, "上周": -1, "本周": 0, "这周": 0, "下周": 1, "下下周": 2, "下下下周": 3}
_WEEK = r"((?:上上上周|下下下周|(?:上上|上|下下|下|本|这)(?:周|星期)))?(?:周|星期)?([一二三四五六日天])"
WEEKDAYS = "一二三四五六日"
#: Festivals of the n-th weekday (Monday 0) of a month, and of solar terms (month, constant of this century).
WEEKDAY_FESTIVALS = {"父亲节": (6, 3, 6, ("父亲节", "father's day", "fathers day"))}
TERM_FESTIVALS = {"清明节": (4, 4.81, ("清明节", "清明", "qingming"))}
#: What makes a question one for the calendar, and words of questions that look like one but are not.
ASKS_DATE = r"几月几号|几月几日|哪天|哪一日|日期|星期几|周几|礼拜几|几号|几日|号\?|号？"
ASKS_DATE_EN = (
    r"(?i)\b(?:what(?:'s|\s+is)?\s+the\s+date|what\s+date|which\s+day|day\s+of\s+the\s+week|month\s+and\s+day|today'?s\s+date|the\s+date\s+today"
    r"|what\s+was\s+the\s+date|what\s+day(?:\s+is\s+it)?)\b|'s\s+date\b"
)
OTHER_MATTERS = ("天气", "气温", "降雨", "下雪", "台风", "空气质量", "拥堵", "路况", "交通", "堵", "股价", "汇率", "黄金", "新闻")
OTHER_MATTERS_EN = (
    "weather", "temperature", "forecast", "rain", "raining", "rainy", "rainfall", "snow", "snowing", "snowy", "snowfall", "typhoon", "hurricane", "thunderstorm",
    "storm", "blizzard", "humid", "humidity", "sunny", "cloudy", "windy", "foggy", "air quality", "aqi", "pollution", "smog", "haze", "traffic", "congestion",
    "gridlock", "road condition", "stock", "stocks", "share price", "exchange rate", "currency", "gold price", "news", "headline", "headlines", "breaking",
)
_NUMERAL = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
_NUMBER = "[0-9零一二两三四五六七八九十]+"
_EDGES = "[`'\"“”，,。.．:：;；、!！…~\\s_-]+"


def normalised_question(text: Column) -> Column:
    """Straight quotes, no white space between Chinese characters, and single spaces elsewhere."""
    t = F.translate(F.coalesce(text, F.lit("")), "’‘“”", "''\"\"")
    t = F.regexp_replace(F.regexp_replace(t, r"^(?U)\s+|(?U)\s+$", ""), "　", "")
    t = F.regexp_replace(t, r"(?<=[一-鿿])(?U)\s+(?=[一-鿿])", "")
    return F.btrim(F.regexp_replace(t, r"(?U)\s+", " "))


def question_parts(text: Column) -> Column:
    """The parts between marks that end a sentence; a text of nothing else is its own part."""
    parts = F.filter(F.transform(F.split(text, r"[?？!！。；;\n]+"), lambda p: F.btrim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def _table(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def _first_named(text: Column, names: list[tuple[str, object]]) -> Column:
    """The value of the first name that a text contains."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(name)), F.lit(value)) for name, value in names])


def _by_length(entries: dict) -> list[tuple[str, object]]:
    return sorted(entries.items(), key=lambda kv: -len(kv[0]))


def _alias(text: Column, festivals: dict) -> Column:
    return _first_named(text, _by_length({alias: name for name, (*_, aliases) in festivals.items() for alias in aliases}))


def small_number(text: Column) -> Column:
    """A number in digits or, up to 99, in numerals; null for anything else."""
    value = lambda x: F.try_element_at(_table(_NUMERAL), x)
    first, rest, last = F.substring(text, 1, 1), F.substring(text, 2, 1000), F.right(text, F.lit(1))
    return (
        F.when(F.rlike(text, F.lit("^[0-9]{1,9}$")), text.try_cast("int"))
        .when(value(text).isNotNull(), value(text))
        .when(F.contains(text, F.lit("十")), F.when(first == "十", value(rest) + 10).when(last == "十", value(first) * 10).otherwise(value(first) * 10 + value(last)))
    )


def asked_year(part: Column, now: Column, anchor: Column) -> Column:
    """A year in digits, this year's words, words and numbers that count from it, the anchor's year, this year."""
    low, this = F.lower(part), F.year(now)
    written = F.regexp_extract(part, r"(?<![0-9])(20\d{2}|19\d{2})", 1).try_cast("int")
    counted = r"([0-9]+|[零一二两三四五六七八九十]+)\s*年\s*(前|后)"
    n = small_number(F.regexp_extract(low, counted, 1))
    offset = F.coalesce(
        _first_named(low, list(YEAR_WORDS.items())),
        F.when(F.regexp_extract(low, counted, 2) == "前", -n).otherwise(n),
        -F.regexp_extract(low, r"\b(\d+)\s+years?\s+ago\b", 1).try_cast("int"),
        F.regexp_extract(low, r"\bin\s+(\d+)\s+years?\b", 1).try_cast("int"),
        F.when(F.rlike(low, F.lit(r"\blast\s+year\b")), -1),
        F.when(F.rlike(low, F.lit(r"\bnext\s+year\b")), 1),
    )
    here = F.when(F.rlike(low, F.lit(r"今年|本年|this\s+year")), this)
    return F.coalesce(written, here, this + offset, anchor, this)


def _relative(low: Column) -> Column:
    return _first_named(low, _by_length(DAY_WORDS) + _by_length(DAY_WORDS_EN))


def _only_a_day(part: Column) -> Column:
    """Nothing is left of a part without its relative day, or only what asks for a date."""
    out = None
    for name, _ in _by_length(DAY_WORDS):
        left = F.regexp_replace(part, f"^(.*?){name}", "$1 ")
        out = F.when(F.contains(part, F.lit(name)), left) if out is None else out.when(F.contains(part, F.lit(name)), left)
    for name, _ in _by_length(DAY_WORDS_EN):
        out = out.when(F.rlike(part, F.lit(rf"\b{name}\b")), F.regexp_replace(part, rf"^(.*?)\b{name}\b", "$1 "))
    left = F.regexp_replace(normalised_question(out), f"^{_EDGES}|{_EDGES}$", "")
    return F.coalesce((left == "") | F.rlike(left, F.lit(ASKS_DATE)) | F.rlike(left, F.lit(ASKS_DATE_EN)), F.lit(False))


def asks_for_date(text: Column, other: tuple[str, ...] = OTHER_MATTERS, other_en: tuple[str, ...] = OTHER_MATTERS_EN) -> Column:
    """Names a festival, asks for a date, or has a part that is no more than a relative day, and is about nothing else."""
    q = F.lower(normalised_question(text))
    about = F.rlike(q, F.lit("|".join(other))) | F.rlike(q, F.lit(r"\b(?:" + "|".join(w.replace(" ", r"\s+") for w in other_en) + r")\b"))
    named = F.coalesce(_alias(q, LUNAR_FESTIVALS), _alias(q, WEEKDAY_FESTIVALS), _alias(q, TERM_FESTIVALS)).isNotNull()
    asked = F.rlike(q, F.lit(ASKS_DATE)) | F.rlike(q, F.lit(ASKS_DATE_EN))
    return (q != "") & ~about & (named | asked | F.exists(question_parts(q), _only_a_day))


def _explicit(part: Column, year: Column) -> Column:
    pattern = rf"({_NUMBER})\s*月\s*({_NUMBER})\s*(?:日|号)"
    month, day = (small_number(F.regexp_extract(part, pattern, i)) for i in (1, 2))
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(month.between(1, 12) & day.between(1, 31), F.try_to_date(text, "yyyy-MM-dd"))


def _term(name: Column, year: Column) -> Column:
    y, out = year % 100, None
    for festival, (month, constant, _) in TERM_FESTIVALS.items():
        leaps = F.when(y == 0, 0).otherwise(F.floor((y - 1) / 4))
        day = F.make_date(year, F.lit(month), (F.floor(y * F.lit(0.2422) + F.lit(constant)) - leaps).cast("int"))
        hit = (name == festival) & year.between(2000, 2099)
        out = F.when(hit, day) if out is None else out.when(hit, day)
    return out


def _weekday(part: Column, today: Column) -> tuple[Column, Column]:
    """Label and day of a weekday of this or another week."""
    prefix = F.regexp_replace(F.regexp_extract(part, _WEEK, 1), "星期", "周")
    prefix, name = F.when(prefix == "", "本周").otherwise(prefix), F.regexp_extract(part, _WEEK, 2)
    index = F.try_element_at(_table({**{w: i for i, w in enumerate(WEEKDAYS)}, "天": 6}), name)
    usable = ~F.rlike(part, F.lit("星期几|周几|礼拜几")) & F.rlike(part, F.lit("周|星期")) & (name != "")
    day = F.date_add(F.date_sub(today, F.weekday(today)), (F.try_element_at(_table(WEEKS), prefix) * 7 + index).cast("int"))
    label = F.when(F.contains(part, F.lit("星期")), F.regexp_replace(prefix, "周", "星期")).otherwise(prefix)
    return F.when(usable, F.concat(label, name)), F.when(usable, day)


def resolved_parts(questions: DataFrame, festivals: DataFrame, key: str, text: str, now: str, anchor: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, pos, part, now, kind, label, day and the columns of ``carry``: what the first resolver that knows a part says about it.

    ``festivals`` (festival, year, day) is what ``festival_days`` gives.
    """
    since = F.col(anchor).cast("int") if anchor else F.lit(None).cast("int")
    base = questions.select(F.col(key).alias("key"), F.col(now).alias("now"), since.alias("since"), normalised_question(F.col(text)).alias("q"), *carry)
    parts = base.select("key", "now", "since", *carry, F.posexplode_outer(question_parts(F.col("q"))).alias("pos", "part")).withColumn("part", F.lower("part"))
    part, today = F.col("part"), F.to_date("now")
    parts = parts.withColumns({"year": asked_year(part, F.col("now"), F.col("since")), "lunar": _alias(part, LUNAR_FESTIVALS)})
    days = festivals.select(F.col("festival").alias("lunar"), "year", F.col("day").alias("lunar_day"))
    parts = parts.join(days, ["lunar", "year"], "left")
    week, week_day = _weekday(part, today)
    sunday, term = _alias(part, WEEKDAY_FESTIVALS), _alias(part, TERM_FESTIVALS)
    nth = F.coalesce(*[F.when(sunday == n, nth_weekday(F.col("year"), F.lit(m), F.lit(i), F.lit(w))) for n, (m, i, w, _) in WEEKDAY_FESTIVALS.items()])
    found = [
        ("explicit", None, _explicit(part, F.col("year"))),
        ("lunar", F.col("lunar"), F.col("lunar_day")),
        ("nth", sunday, nth),
        ("term", term, _term(term, F.col("year"))),
        ("week", week, week_day),
        ("relative", None, F.date_add(today, _relative(part))),
    ]
    said = F.coalesce(*[F.when(day.isNotNull(), F.struct(F.lit(kind).alias("kind"), (label if label is not None else F.lit(None).cast("string")).alias("label"), day.alias("day"))) for kind, label, day in found])
    return parts.select("key", "pos", "part", "now", *carry, said.alias("said")).select("key", "pos", "part", "now", *carry, "said.*")


def _line(chinese: Column) -> Column:
    """One line of an answer, from part, now, day, label and kind."""
    part, now, day = F.col("part"), F.col("now"), F.col("day")
    offset = F.datediff(day, F.to_date(now))
    clock = F.rlike(part, F.lit("几点|什么时间|时刻|当前时间|现在几点|what time|clock"))
    date = F.rlike(part, F.lit("日期|几号|哪天|星期|礼拜|周几|星期几|哪一日"))
    plain = date | F.rlike(part, F.lit("几月几"))
    written = F.concat(F.year(day).cast("string"), F.lit("年"), F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日"))
    week = F.concat(F.lit("星期"), F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(day) + 1))
    word = F.coalesce(F.try_element_at(_table(SPOKEN), offset), F.lit("该日"))
    text = (
        F.when(F.col("kind") == "explicit", F.concat(written, F.lit("，"), week, F.lit("。")))
        .when(F.col("label").isNotNull(), F.concat("label", F.lit("是"), written, F.lit("（"), week, F.lit("）。")))
        .when(plain, F.concat(word, F.lit("是"), written, F.lit("，"), week, F.lit("。")))
        .otherwise(F.concat(word, F.lit("的日期是"), written, F.lit("（"), week, F.lit("）。")))
    )
    time = F.date_format(now, "HH:mm:ss")
    text = (
        F.when(clock & ~date, F.concat(F.regexp_replace(text, "。$", ""), F.lit("，当前时间"), time, F.lit("。")))
        .when(clock, F.concat(text, F.lit("当前时间"), time, F.lit("。")))
        .otherwise(text)
    )
    word = F.coalesce("label", F.try_element_at(_table(SPOKEN_EN), offset), F.lit("That day"))
    verb = F.when(offset == 0, "is").when(offset < 0, "was").otherwise("will be")
    english = F.concat(word, F.lit(" "), verb, F.date_format(day, " MMMM d, yyyy (EEEE)"), F.lit("."))
    english = F.when(clock & ~date, F.concat(english, F.lit(" The current time is "), time, F.lit("."))).when(clock, F.concat(english, F.lit(" Current time: "), time, F.lit("."))).otherwise(english)
    return F.when(chinese, text).otherwise(english)


def calendar_answers(questions: DataFrame, festivals: DataFrame, key: str, text: str, now: str, anchor: str | None = None) -> DataFrame:
    """key, n_parts, n_resolved and answer for every question; ``key`` is unique.

    Answers are Chinese where the question has a Chinese character, and where it has no Latin letter.
    """
    asked = F.coalesce(asks_for_date(F.col(text)), F.lit(False))
    speaks = F.rlike(F.coalesce(F.col(text), F.lit("")), F.lit(r"[一-鿿]")) | ~F.rlike(F.coalesce(F.col(text), F.lit("")), F.lit("[A-Za-z]"))
    marked = questions.withColumns({"_asked": asked, "_chinese": speaks})
    parts = resolved_parts(marked, festivals, key, text, now, anchor, ("_asked", "_chinese"))
    done = parts.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_parts"),
        F.count("day").alias("n_resolved"),
        F.bool_and(F.col("_asked") & F.col("day").isNotNull()).alias("all"),
        F.array_sort(F.collect_list(F.struct("pos", _line(F.col("_chinese")).alias("line")))).alias("lines"),  # of one question
    )
    answer = F.when(F.col("all"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return done.select(F.col("key").alias(key), "n_parts", "n_resolved", answer.alias("answer"))
