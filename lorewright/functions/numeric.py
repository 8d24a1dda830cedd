"""Numeric rules, codes and decision cascades (MX1-MX11, DT13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weather interpretation codes of the WMO table.
WEATHER = {
    0: "clear sky", 1: "mainly clear", 2: "partly cloudy", 3: "overcast", 45: "fog", 48: "rime fog", 51: "light drizzle", 53: "drizzle", 55: "dense drizzle",
    56: "light freezing drizzle", 57: "freezing drizzle", 61: "light rain", 63: "rain", 65: "heavy rain", 66: "light freezing rain", 67: "freezing rain",
    71: "light snow", 73: "snow", 75: "heavy snow", 77: "snow grains", 80: "light showers", 81: "showers", 82: "violent showers", 85: "snow showers",
    86: "heavy snow showers", 95: "thunderstorm", 96: "thunderstorm with hail", 99: "thunderstorm with heavy hail",
}
WINDS = ("north", "north-east", "east", "south-east", "south", "south-west", "west", "north-west")


def weather_text(code: Column) -> Column:
    """MX1."""
    table = F.create_map(*[F.lit(x) for kv in WEATHER.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit("unknown"))


def wind_sector(degrees: Column) -> Column:
    """MX2."""
    at = F.pmod(F.floor((F.pmod(degrees, F.lit(360.0)) + 22.5) / 45), F.lit(8)).cast("int")
    return F.get(F.array(*map(F.lit, WINDS)), at)


def overlap_share(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """MX3: overlap of two inclusive ranges over the shorter one."""
    both = F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a1, b1) + 1)
    shorter = F.least(a2 - a1, b2 - b1) + 1
    return F.when(shorter > 0, both / shorter).otherwise(0.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def route(label: Column, modes: dict[str, str], branches: dict[str, str], mode: str = "direct", branch: str = "answer") -> Column:
    """MX5, MX8: label to mode to branch, each with a default."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.try_element_at(table(branches), F.coalesce(F.try_element_at(table(modes), label), F.lit(mode))), F.lit(branch))


#: Confidence words in order.
LEVELS = {"low": 0, "medium": 1, "high": 2}


def level(confidence: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), confidence)


def noise_gate(label: Column, confidence: Column, text: Column, enabled: bool = True, least: str = "medium") -> Column:
    """MX6, A2: (label, reason); only noise is examined, and stays noise if nothing speaks against it."""
    legit = F.rlike(text, F.lit(r"(?i)[?？0-9+\-*/=]|什么|怎么|为什么|多少|who|what|why|how|when|where"))
    reason = (
        F.when(F.lit(not enabled), "feature_disabled")
        .when(level(confidence).isNull() | (level(confidence) < LEVELS[least]), "low_confidence")
        .when(F.char_length(F.trim(text)) > 12, "query_too_long")
        .when(legit, "heuristic_legit_query")
    )
    reason = F.when(label == "noise", reason)
    return F.struct(F.when(reason.isNotNull(), "other").otherwise(label).alias("label"), reason.alias("reason"))


_SETTLED = ("greeting", "noise", "math_problem", "realtime_query")


def final_label(raw: Column, raw_confidence: Column, original: Column, second: Column, confidence: Column, realtime: Column, text: Column, math: Column, concept: Column) -> Column:
    """MX7, A3: restore, promote, upgrade, then the noise gate; (label, reason)."""
    n = F.char_length(original)
    strong = raw_confidence == "high"
    preserve = (raw != "realtime_query") & strong & (n >= 8)
    label = (
        F.when((second != "realtime_query") & (raw == "realtime_query") & strong & (n < 8), raw)
        .when((second == "realtime_query") & (raw != "realtime_query") & strong, raw)
        .otherwise(second)
    )
    label = F.when(realtime & ~label.isin(*_SETTLED) & (confidence != "high") & ~preserve, "realtime_query").otherwise(label)
    open_ = label.isin("general_knowledge", "chit_chat", "other")
    label = F.when(open_ & math, "math_problem").when(open_ & concept, "concept_explain").otherwise(label)
    return noise_gate(label, confidence, text)


def keep_decision(is_concept: Column, is_complete: Column) -> Column:
    """MX10: (keep, issues)."""
    issues = F.array_compact(F.array(F.when(~is_concept, "not_a_concept"), F.when(~is_complete, "incomplete")))
    return F.struct((F.size(issues) == 0).alias("keep"), issues.alias("issues"))


def first_fault(*faults: tuple[Column, str]) -> Column:
    """MX11, SUP15: the name of the first rule that is broken, else null."""
    return F.coalesce(*[F.when(broken, F.lit(name)) for broken, name in faults])


def rush_level(ts: Column) -> Column:
    """DT13: weekday and hour to one of three levels."""
    workday, hour = F.weekday(ts) < 5, F.hour(ts)
    peak = workday & (hour.between(7, 9) | hour.between(17, 19))
    return F.when(peak, "high").when(hour.between(10, 20), "medium").otherwise("low")


def segment_mode(by_newline: Column, size: Column) -> tuple[Column, Column]:
    """MX15: cutting at line ends and at a length exclude each other; neither means paragraphs."""
    mode = F.when(by_newline & size.isNotNull(), "invalid").when(by_newline, "newline").when(size.isNotNull(), "length").otherwise("paragraph")
    return mode, size


#: Where a question goes by the way in which it is to be answered.
BRANCHES = {"math_llm": "math", "rag_with_fallback": "rag", "general_llm": "general"}


def route_after_classification(intent: Column, realtime: Column, mode: Column) -> Column:
    """MX8: greetings and noise first, then the present, then the answer mode; unknown modes are general."""
    by_mode = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BRANCHES.items() for x in kv]), F.lower(mode)), F.lit("general"))
    return F.when(intent.isin("greeting", "noise"), "greeting").when(F.coalesce(realtime, F.lit(False)), "realtime").otherwise(by_mode)


def route_after_concepts(hit: Column, context: Column) -> Column:
    """MX8: a hit counts only with a context."""
    return F.when(F.coalesce(hit, F.lit(False)) & (F.coalesce(context, F.lit("")) != ""), "concept_hit").otherwise("concept_miss")
