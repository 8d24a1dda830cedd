"""Text, number and date rules over ``documents``, ``conversations`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import filters as L
from ..scratch import Scratch
from ..session import table
from .registry import query


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def one(column, name="out", key="doc_id"):
    """A query that computes one column of ``documents``."""
    return lambda spark, sf_dir: docs(spark, sf_dir).select(key, column(F.col("text")).alias(name))


def text_query(name: str, doc: str, column, sql: str | None):
    f = one(column)
    f.__name__, f.__doc__ = name, doc
    query(sql and f"select doc_id, {sql} as out from documents")(f)


text_query("st1_clean_query", "Leading punctuation goes.", T.clean_query, r"regexp_replace(text, '^[，。！？、；：,.?!;:\s]+', '')")
text_query("st2_language", "Dominant script.", T.dominant_language, "case when regexp_matches(text, '[一-鿿]') then 'zh' when regexp_matches(text, '[A-Za-z]') then 'en' else '' end")
text_query("st4_output_language", "Language to answer in.", T.output_language, "case when not regexp_matches(text, '[一-鿿]') and regexp_matches(text, '[A-Za-z]') then 'en' else 'zh' end")
text_query("st5_file_name", "Safe file name.", T.safe_file_name, r"""coalesce(nullif(substring(trim(regexp_replace(text, '[\\/:*?"<>|\x00-\x1f]', '_', 'g'), ' .'), 1, 50), ''), 'untitled')""")
text_query("st6_plain_file_name", "File name of letters and digits.", T.plain_file_name, "substring(trim(regexp_replace(text, '[^一-鿿A-Za-z0-9]+', '_', 'g'), '_'), 1, 80)")
text_query("st7_slug", "Slug.", T.slug, "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9一-鿿]+', '_', 'g'), '_+', '_', 'g'), '_')")
text_query("st8_stable_id", "Hash id over joined parts.", lambda t: T.stable_id(F.col("doc_id").cast("string"), t, prefix="c_"), "'c_' || substring(sha1(doc_id::varchar || chr(31) || text), 1, 16)")
text_query("st9_md5_id", "MD5 id.", lambda t: T.md5_id(t, "doc_"), "'doc_' || substring(md5(text), 1, 12)")
text_query("st10_question_hash", "SHA-256.", T.question_hash, "sha256(text)")
text_query("st11_rough_tokens", "Rough token count.", T.rough_tokens, "(length(regexp_replace(text, '[^一-鿿]', '', 'g')) + ceil((length(text) - length(regexp_replace(text, '[^一-鿿]', '', 'g'))) / 4.0))::bigint")
text_query("st12_cut", "Cut for embedding.", T.cut_for_embedding, "case when length(text) <= 384 then text else substring(text, 1, 381) || '...' end")
text_query("st13_one_spaced", "White space normalised.", T.one_spaced, r"trim(regexp_replace(text, '\s+', ' ', 'g'))")
text_query("st20_proof", "Proof or not.", T.is_proof, "regexp_matches(text, '(?i)证明|求证|prove|show that')")
text_query("st22_list_markers", "List markers go.", T.strip_list_markers, r"regexp_replace(text, '(?m)^([ \t]*)(?:[-*+])[ \t]+', '\1', 'g')")
text_query("st36_math", "Mathematical signs.", T.has_math, r"regexp_matches(text, '[=+×÷√∑∫≤≥≠∞π^]|\\[a-zA-Z]+|\d\s*[-*/]\s*\d')")
text_query("st37_title", "Normal title.", lambda t: T.normal_title(F.get(F.split(t, "\n"), 0)), r"lower(regexp_replace(regexp_replace(regexp_replace(split_part(text, chr(10), 1), '^\s*#+\s*', ''), '[*_`]', '', 'g'), '\s+', '', 'g'))")
text_query("st38_page", "Title without page number.", lambda t: T.without_page(F.concat(t, F.lit(" ... 12"))), r"rtrim(regexp_replace(text || ' ... 12', '[\s.·…]*\s\d+\s*$', ''))")
text_query("st48_sentences", "Sentences, counted.", lambda t: F.size(T.sentences(t)).cast("long"), r"len(list_filter(string_split_regex(text, '[?？!！。；;\n]'), lambda x: trim(x, ' ') <> ''))::bigint")
text_query("prj4_shortened", "Cut with an ellipsis.", lambda t: T.shortened(t, 120), r"case when length(regexp_replace(text, '\n+', ' ', 'g')) > 120 then substring(regexp_replace(text, '\n+', ' ', 'g'), 1, 120) || '…' else regexp_replace(text, '\n+', ' ', 'g') end")
_SPEECH = [(r"(?s)```.*?```", " "), (r"`([^`]*)`", r"\1"), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?m)^[ \t]*#{1,6}[ \t]*", ""), (r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+", ""), (r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*\n]+)\*", r"\1"), (r"\n{2,}", "\n")]
_BODY = [(r"!\[[^\]]*\]\([^)]*\)", ""), (r"https?://[^\s)>]+", ""), (r"(?:[A-Za-z]:)?[\\/](?:[\w.-]+[\\/])+[\w.-]+", ""), (r"\b[\w-]+\.(?:png|jpe?g|gif|svg|webp|pdf)\b", ""), (r"\n{3,}", "\n\n")]


def _replaced(of: str, steps) -> str:
    for pattern, by in steps:
        of = f"regexp_replace({of}, '{pattern}', '{by}', 'g')"
    return f"trim({of}, ' ')"


_MARKED = "'# T' || chr(10) || '1. `a` **b** [c](d) ![e](f.png) see http://x.y/z and a/b/c.txt or g.jpg' || chr(10) || chr(10) || chr(10) || text"
_marked = lambda t: F.concat(F.lit("# T\n1. `a` **b** [c](d) ![e](f.png) see http://x.y/z and a/b/c.txt or g.jpg\n\n\n"), t)
text_query("st21_speech", "Markdown to speech.", lambda t: T.speech_text(_marked(t)), _replaced(_MARKED, _SPEECH))
text_query("st41_body", "Clean body.", lambda t: T.clean_body(_marked(t)), _replaced(_MARKED, _BODY))
text_query("st15_fence", "Fence stripped.", lambda t: T.strip_code_fence(F.concat(F.lit("```json\n"), t, F.lit("\n```"))), "trim(text, ' ')")
text_query("st34_alias", "Label by alias.", lambda t: T.alias_of(F.col("lang"), {"en": "english", "fr": "french"}, "general"), "case lang when 'en' then 'english' when 'fr' then 'french' else 'general' end")


@query("""
with r as (select *, case when turn % 4 = 0 then '' when turn % 4 = 1 then text || text || text || text when turn % 4 = 2 then lower(text) else '什么是 ' || text end as new from conversations where text is not null),
l as (select *, case when regexp_matches(text, '[一-鿿]') then 'zh' when regexp_matches(text, '[A-Za-z]') then 'en' else '' end as a,
        case when regexp_matches(new, '[一-鿿]') then 'zh' when regexp_matches(new, '[A-Za-z]') then 'en' else '' end as b from r)
select conv_id, turn, case when trim(new, ' ') = '' or (a <> '' and b <> '' and a <> b) or length(trim(new, ' ')) > greatest(80, 3 * length(text)) then text else trim(new, ' ') end as out from l
""")
def st25_guarded_rewrite(spark, sf_dir):
    """Empty rewrites, answers and rewrites in another language are refused, good ones taken."""
    t, kind = F.col("text"), F.col("turn") % 4
    new = F.when(kind == 0, "").when(kind == 1, F.concat(t, t, t, t)).when(kind == 2, F.lower(t)).otherwise(F.concat(F.lit("什么是 "), t))
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", T.guarded_rewrite(t, new).alias("out"))


@query("""
with s as (select doc_id, string_split(text, '. ') as p, text from documents)
select doc_id, coalesce(nullif(array_to_string(list_filter(p, lambda x: not contains(x, 'the')), '. '), ''), text) as out from s
""")
def fil16_consistent_sentences(spark, sf_dir):
    """Sentences that conflict go, unless all do."""
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", L.keep_unless_all_dropped(F.split(t, r"\. "), lambda x: ~F.contains(x, F.lit("the")), t, ". ").alias("out"))


@query(r"""
with w as (select item_id as pos, lower(split_part(text, ' ', 3)) as term from benchmark union all values (-1, 'idiot'), (-2, 'ouan'), (-3, 'é')),
d as (select doc_id, ' ' || regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '  ', 'g') || ' ' as padded, lower(text) as low from documents)
select doc_id, pos from d, w where term <> '' and case when regexp_matches(term, '^[a-z0-9]+$') then contains(padded, ' ' || term || ' ') else contains(low, term) end
""")
def jn11_sensitive_words(spark, sf_dir):
    """Sensitive words: whole words for plain terms, substrings otherwise."""
    from ..operators.retrieval import terms_in_text

    listed = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), F.get(F.split("text", " "), 2).alias("term"))
    terms = listed.union(spark.createDataFrame([(-1, "idiot"), (-2, "ouan"), (-3, "É")], "pos long, term string"))
    rows = docs(spark, sf_dir).select("doc_id", "text", T.padded_words(F.col("text")).alias("padded"))
    plain = F.rlike(F.lower("term"), F.lit(T.PLAIN_TERM))
    whole = terms.where(plain).select("pos", F.concat(F.lit(" "), "term", F.lit(" ")).alias("term"))
    words = terms_in_text(rows, "doc_id", "padded", whole, "term", "pos", Scratch(spark, "words"))
    parts = terms_in_text(rows, "doc_id", "text", terms.where(~plain), "term", "pos", Scratch(spark, "parts"))
    return words.union(parts).select("doc_id", "pos")


@query("select event_id, case (event_id % 100) " + " ".join(f"when {k} then '{v}'" for k, v in N.WEATHER.items()) + """ else 'unknown' end as weather,
       (['north', 'north-east', 'east', 'south-east', 'south', 'south-west', 'west', 'north-west'])[1 + (floor((value * 3.6 - 360 * floor(value * 3.6 / 360) + 22.5) / 45)::int % 8)] as wind,
       case when isodow(ts) - 1 < 5 and (hour(ts) between 7 and 9 or hour(ts) between 17 and 19) then 'high' when hour(ts) between 10 and 20 then 'medium' else 'low' end as rush
from events
""")
def mx1_codes(spark, sf_dir):
    """Weather codes, wind sectors and rush hours (MX1, MX2, DT13)."""
    code = F.col("event_id") % 100
    return table(spark, sf_dir, "events").select("event_id", N.weather_text(code).alias("weather"), N.wind_sector(F.col("value") * 3.6).alias("wind"), N.rush_level(F.col("ts")).alias("rush"))


@query("""
select l_orderkey, l_linenumber, round(case when least(e1 - s1, e2 - s2) + 1 > 0 then greatest(0, least(e1, e2) - greatest(s1, s2) + 1) / (least(e1 - s1, e2 - s2) + 1)::double else 0 end, 6) as share
from (select l_orderkey, l_linenumber, l_partkey % 50 as s1, l_partkey % 50 + l_quantity::bigint as e1, l_suppkey % 40 as s2, l_suppkey % 40 + 10 as e2 from lineitem)
""")
def mx3_overlap(spark, sf_dir):
    """Overlap of ranges over the shorter one."""
    s1, s2 = F.col("l_partkey") % 50, F.col("l_suppkey") % 40
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s1.alias("s1"), (s1 + F.col("l_quantity").cast("long")).alias("e1"), s2.alias("s2"), (s2 + 10).alias("e2"))
    return rows.select("l_orderkey", "l_linenumber", F.round(N.overlap_share(*map(F.col, ("s1", "e1", "s2", "e2"))), 6).alias("share"))


@query("""
select event_id, case event_type when 'click' then 'fast' when 'view' then 'slow' else 'answer' end as branch from events
""")
def mx5_route(spark, sf_dir):
    """Label to mode to branch, with defaults."""
    modes, branches = {"click": "retrieve", "view": "web"}, {"retrieve": "fast", "web": "slow"}
    return table(spark, sf_dir, "events").select("event_id", N.route(F.col("event_type"), modes, branches).alias("branch"))


@query("""
select doc_id, case when n_chars < 10 then 'too_short' when lang = 'en' and n_chars > 50000 then 'too_long' when source = 'src3' then 'excluded' end as skip_reason from documents
""")
def sup15_skip_reasons(spark, sf_dir):
    """The first rule that speaks against importing a record."""
    n = F.col("n_chars")
    fault = N.first_fault((n < 10, "too_short"), ((F.col("lang") == "en") & (n > 50000), "too_long"), (F.col("source") == "src3", "excluded"))
    return docs(spark, sf_dir).select("doc_id", fault.alias("skip_reason"))


@query("""
select doc_id, x.i as line_no, x.line as line from (select doc_id, unnest(list_zip(range(1, len(string_split(text, chr(10))) + 1), string_split(text, chr(10))), recursive := false) as z from documents) t,
lateral (select z[1] as i, z[2] as line) x
""")
def src10_numbered_lines(spark, sf_dir):
    """Texts as numbered lines."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    return lines.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")
