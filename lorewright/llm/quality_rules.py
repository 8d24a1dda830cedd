r"""Quality rules with thresholds that adapt to each language and source.

Fixed base rules come first (too few words; too many words in repeated five-word windows). Four
ratios of every document are then held against thresholds from mergeable quantile sketches: for
each (lang, source), and for each lang as the fall-back of small groups, ``percentile_approx``
merges one Greenwald-Khanna sketch from each task, so no group is ever gathered in one place. A
document is rejected if a ratio lies beyond the upper quartile by more than ``spread`` times the
interquartile range (and by at least the ratio's ``floor``, so that a group without variation does
not reject its ordinary documents).

Everything is DataFrame functions. A null text has no words, fails the base rules and gets zeros.
Null languages and sources form groups of their own. A group below ``min_group`` documents uses its
language's thresholds, and those of all documents where the language is small too. A ratio that equals
its threshold is fine. Every input row gives one output row, repeated rows each their own, an empty
table none; very long texts are judged whole; columns that are not named here are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .text_native import SPACES, UPPER, window_hashes, words

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: ratio: least distance from the upper quartile that counts as unusual.
FLOORS = {"symbol_ratio": 0.10, "upper_ratio": 0.30, "dup_line_ratio": 0.30, "repeat_ratio": 0.10}

#: Base columns, in the order of the report.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(size: int) -> Column:
    """Words in windows that occur twice or more, from the sorted (hash, position) pairs ``_pairs``."""
    pairs, n = F.col("_pairs"), F.size("_pairs")
    same = lambda i, j: F.get(pairs, i)["hash"] == F.get(pairs, j)["hash"]  # noqa: E731
    twice = F.filter(
        F.sequence(F.lit(0), n - 1), lambda i: ((i > 0) & same(i, i - 1)) | ((i < n - 1) & same(i, i + 1))
    )
    return F.sort_array(F.transform(twice, lambda i: F.get(pairs, i)["pos"]))


def with_base(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
    (and ``_upper``, the number of capital letters A-Z)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, SPACES, "")
    filled = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    step = docs.select("*", words(F.col("text")).alias("_words"), bare.alias("_bare"), filled.alias("_filled"))
    step = step.select("*", window_hashes(F.col("_words"), 5).alias("_hashes"))
    step = step.select("*", (F.size(F.array_distinct("_hashes")) < F.size("_hashes")).alias("_repeats"))
    pairs = F.when(
        F.col("_repeats"),
        F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("hash"), i.alias("pos")))),
    )
    step = step.select("*", pairs.alias("_pairs"))
    step = step.select("*", F.when(F.col("_repeats"), _covered(5)).alias("_starts"))
    starts = F.col("_starts")
    gaps = F.aggregate(
        F.sequence(F.lit(1), F.size("_starts")),
        F.lit(0),
        lambda total, i: total + F.least(F.lit(5), F.coalesce(F.get(starts, i) - F.get(starts, i - 1), F.lit(5))),
    )
    n_words, repeated = F.size("_words").cast("long"), F.when(F.col("_repeats"), gaps).otherwise(0).cast("long")
    step = step.select(
        *docs.columns,
        n_words.alias("n_words"),
        F.char_length("_bare").cast("long").alias("word_chars"),
        (F.char_length("_bare") - F.char_length(F.translate("_bare", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_filled") - F.size(F.array_distinct("_filled"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        (F.char_length("_bare") - F.char_length(F.translate("_bare", UPPER, ""))).cast("long").alias("_upper"),
        F.size("_filled").cast("long").alias("_n_filled"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return step.withColumn("base_failed", failed)


def _ratios() -> dict[str, Column]:
    per = lambda x, n: F.col(x) / F.greatest(F.col(n), F.lit(1))  # noqa: E731
    return {
        "symbol_ratio": per("n_symbols", "word_chars"),
        "upper_ratio": per("_upper", "word_chars"),
        "dup_line_ratio": per("n_dup_lines", "_n_filled"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
    }


def judged_rows(docs: DataFrame, scratch: Scratch, keep: list[str], spread: float, min_group: int, accuracy: int) -> DataFrame:
    """The columns ``keep`` of every row as the struct ``row``, its base columns and its verdict.

    Ratios are measured once and written with the row; limits are then looked up by group.
    """
    measured = with_base(docs.select(F.struct(*keep).alias("row"), "text", "lang", "source"))
    ratios = _ratios()
    slim = scratch.save(measured.select("*", *[c.alias(name) for name, c in ratios.items()]).drop("text"), "measured")
    valid = slim.where(~F.col("base_failed"))
    quartiles = [F.percentile_approx(name, F.array(F.lit(0.25), F.lit(0.75)), F.lit(accuracy)).alias(name) for name in ratios]

    def limits(prefix: str) -> list[Column]:
        return [
            (F.col(name)[1] + F.greatest(F.lit(spread) * (F.col(name)[1] - F.col(name)[0]), F.lit(FLOORS[name]))).alias(f"{prefix}_{name}")
            for name in ratios
        ]

    def grouped(keys: list[str], prefix: str) -> DataFrame:
        sketched = valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *quartiles).where(F.col("n") >= min_group)
        return sketched.select(*[F.col(k).alias(f"{prefix}_{k}") for k in keys], *limits(prefix))

    # One row for each language or pair of language and source: written, so that its size is known.
    both, lang = scratch.save(grouped(["lang", "source"], "g"), "both"), scratch.save(grouped(["lang"], "l"), "lang")
    every = grouped([], "a").first()  # one row of four limits
    out = slim.join(both, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    out = out.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left")
    fine = F.lit(True)
    for name in ratios:
        limit = F.coalesce(F.col(f"g_{name}"), F.col(f"l_{name}"), F.lit(every[f"a_{name}"] if every else float("inf")))
        fine = fine & (F.col(name) <= limit)
    return out.select("row", *BASE, "base_failed", (~F.col("base_failed") & fine).alias("kept"))


def judge(docs: DataFrame, scratch: Scratch, spread: float = 3.0, min_group: int = 30, accuracy: int = 10_000) -> DataFrame:
    """doc_id, the base columns, base_failed and kept for every row of ``docs``."""
    return judged_rows(docs, scratch, ["doc_id"], spread, min_group, accuracy).select("row.doc_id", *BASE, "base_failed", "kept")


def keep_good(docs: DataFrame, scratch: Scratch, spread: float = 3.0, min_group: int = 30, accuracy: int = 10_000) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    return judged_rows(docs, scratch, docs.columns, spread, min_group, accuracy).where("kept").select("row.*")


#: The same in DuckDB: exact quartiles, which the sketches equal as long as a group has fewer rows than their accuracy.
QUALITY_SQL = r"""
with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select *, list_filter(string_split_regex(text, '[ 	

]+'), lambda x: x <> '') as ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	

]')) as ls,
        regexp_replace(text, '[ 	

]+', '', 'g') as bare from d),
g as (select rid, i, list_slice(ws, i, i + 4) as g from (select rid, ws, unnest(generate_series(1, len(ws) - 4)) as i from w)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from g) where n > 1),
c as (select rid, count(distinct i + j) as n from r cross join range(5) as t(j) group by 1),
m as (select rid, doc_id, lang, source, len(ws)::bigint as n_words, length(bare) as word_chars,
        length(regexp_replace(bare, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
        (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls) as n_lines,
        length(regexp_replace(bare, '[^A-Z]+', '', 'g')) as n_upper from w),
b as (select m.*, coalesce(c.n, 0)::bigint as n_repeat_words from m left join c using (rid)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
        n_symbols / greatest(word_chars, 1) as r1, n_upper / greatest(word_chars, 1) as r2,
        n_dup_lines / greatest(n_lines, 1) as r3, n_repeat_words / greatest(n_words, 1) as r4 from b),
q as (select lang, source, grouping(lang, source) as level, count(*) as n,
        quantile_disc(r1, [0.25, 0.75]) as q1, quantile_disc(r2, [0.25, 0.75]) as q2,
        quantile_disc(r3, [0.25, 0.75]) as q3, quantile_disc(r4, [0.25, 0.75]) as q4
      from f where not base_failed group by grouping sets ((lang, source), (lang), ()) having count(*) >= 30),
t as (select lang, source, level, q1[2] + greatest(3.0 * (q1[2] - q1[1]), 0.10) as t1, q2[2] + greatest(3.0 * (q2[2] - q2[1]), 0.30) as t2,
        q3[2] + greatest(3.0 * (q3[2] - q3[1]), 0.30) as t3, q4[2] + greatest(3.0 * (q4[2] - q4[1]), 0.10) as t4 from q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and r1 <= coalesce(g.t1, l.t1, a.t1, 'infinity'::double) and r2 <= coalesce(g.t2, l.t2, a.t2, 'infinity'::double)
       and r3 <= coalesce(g.t3, l.t3, a.t3, 'infinity'::double) and r4 <= coalesce(g.t4, l.t4, a.t4, 'infinity'::double) as kept
from f left join t g on g.level = 0 and g.lang is not distinct from f.lang and g.source is not distinct from f.source
left join t l on l.level = 1 and l.lang is not distinct from f.lang left join t a on a.level = 3
"""
