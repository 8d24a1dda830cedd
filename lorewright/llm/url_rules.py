"""URL filtering by mined association rules, below a list of explicit rules.

Labelled URLs become transactions of tokens (scheme, every domain suffix of two labels or more, first
label, hyphenated parts of labels, path segments with numbers made equal, extension, query keys) and,
for bad ones, a label item. Spark's FP-growth mines item sets; rules that conclude the label with
enough confidence and support are kept, and rules that contain a smaller kept rule are pruned.
Matching uses an inverted index: each rule stands under its rarest token, distinct URLs look up their
tokens, and a hit is confirmed if the URL has all tokens of the rule. The index is written, so the
planner broadcasts it only below its own size limit.

Explicit rules (host and path) win over mined ones. A rule fits its host and all subdomains if the
URL's path starts with the rule's path; the longest rule wins, of equally long ones the one that
blocks. They are a parameter, held as a map of literals, so judging needs no shuffle. Of several
mined rules that match, the one of greatest confidence is reported, of equal ones the last in order
of its tokens.

Rows: one for each input row, an empty table gives none. A null url, or one without ``://``, has an
empty host and path, fits no rule and is allowed. Labels with null fields are ignored; without
labelled bad URLs nothing is mined. Very long URLs have as many tokens as segments and keys. Repeated
rows and other columns make no difference.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .text_native import ascii_lower

#: Explicit rules: (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as (length, verdict, rule), else null."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name.lower(), []).append((slash + rest, verdict, rule))
    if not by_host:
        return F.lit(None).cast("struct<length:int,verdict:string,rule:string>")
    entry = lambda r: F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("path", "verdict", "rule"), strict=True)])
    table = F.create_map(*[x for name, own in by_host.items() for x in (F.lit(name), F.array(*map(entry, own)))])
    labels = F.split(host_, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(table, s), F.array().cast("array<struct<path:string,verdict:string,rule:string>>")))), lambda r: F.startswith(path_, r["path"]))
    sized = F.transform(fitting, lambda r: F.struct(F.char_length(r["rule"]).alias("length"), r["verdict"].alias("verdict"), r["rule"].alias("rule")))
    return F.when(host_ != "", F.array_max(sized))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL."""
    h, p = host(url), path(url)
    labels = F.split(h, r"\.", -1)
    n = F.size(labels)
    none = F.array().cast("array<string>")
    scheme = F.array(F.concat(F.lit("scheme="), ascii_lower(F.substring_index(url, "://", 1))))
    starts = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array(F.lit(1)))
    domains = F.transform(starts, lambda i: F.concat(F.lit("d="), F.array_join(F.slice(labels, i, n), ".")))
    first_label = F.when(n >= 3, F.array(F.concat(F.lit("s="), F.get(labels, 0)))).otherwise(none)
    split = F.transform(F.filter(labels, lambda x: F.contains(x, F.lit("-"))), lambda x: F.filter(F.split(x, "-", -1), lambda y: y != ""))
    hyphened = F.transform(F.flatten(split), lambda x: F.concat(F.lit("h="), x))
    segments = F.filter(F.split(p, "/", -1), lambda x: x != "")
    parts = F.transform(segments, lambda x: F.concat(F.lit("p="), F.regexp_replace(x, "[0-9]+", "0")))
    extension = F.transform(F.slice(F.regexp_extract_all(p, F.lit(r"\.([A-Za-z]{1,6})$"), 1), 1, 1), lambda x: F.concat(F.lit("e="), ascii_lower(x)))
    query = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1)
    keys = F.transform(query, lambda x: F.concat(F.lit("q="), x))
    found = F.array_distinct(F.concat(scheme, domains, first_label, hyphened, parts, extension, keys))
    return F.when(h != "", found).otherwise(F.array().cast("array<string>"))


def mine_rules(pages: DataFrame, labels: DataFrame, scratch: Scratch, support: float, count: int, confidence: float) -> DataFrame:
    """rule_id, items, confidence, support of the pruned rules that conclude a bad label."""
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    marked = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max(bad.cast("int")).alias("bad"))
    rows = pages.where("url is not null").select("page_id", "url").join(marked, F.col("page_id") == F.col("doc_id"))
    rows = rows.select("bad", tokens(F.col("url")).alias("t")).where(F.size("t") > 0)
    rows = scratch.save(rows.select(F.when(F.col("bad") == 1, F.concat("t", F.array(F.lit("label=bad")))).otherwise(F.col("t")).alias("items")), "transactions")
    n = rows.count()
    empty = "items array<string>, confidence double, support double"
    if not n or rows.where(F.array_contains("items", "label=bad")).isEmpty():
        mined = pages.sparkSession.createDataFrame([], empty)
    else:
        model = FPGrowth(itemsCol="items", minSupport=max(support, min(1.0, count / n)), minConfidence=confidence).fit(rows)
        mined = model.associationRules.where(F.col("consequent") == F.array(F.lit("label=bad"))).select(F.array_sort("antecedent").alias("items"), "confidence", "support")
    mined = scratch.save(mined.withColumn("rule_id", F.xxhash64("items")), "mined")
    # A rule is superfluous if another one's items are a proper subset: found through a shared item, as the subset stands under its own first item.
    heads = mined.select(F.col("items")[0].alias("item"), F.col("items").alias("smaller"))
    larger = mined.select("rule_id", "items", F.explode("items").alias("item"))
    beaten = larger.join(heads, "item").where((F.size("smaller") < F.size("items")) & (F.size(F.array_except("smaller", "items")) == 0)).select("rule_id").distinct()
    return scratch.save(mined.join(beaten, "rule_id", "left_anti"), "rules")


def bad_urls(pages: DataFrame, rules: DataFrame, scratch: Scratch) -> DataFrame:
    """url, confidence, bad_rule of the distinct URLs that a mined rule matches."""
    urls = pages.where("url is not null").select("url").distinct()
    looked_up = urls.select("url", tokens(F.col("url")).alias("t")).select("url", "t", F.explode_outer("t").alias("anchor"))
    often = rules.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    anchors = rules.select("rule_id", "items", "confidence", F.explode("items").alias("item")).join(often, "item")
    index = anchors.groupBy("rule_id").agg(F.min(F.struct("n", "item"))["item"].alias("anchor"), F.first("items").alias("items"), F.first("confidence").alias("confidence"))
    index = scratch.save(index, "index")
    hits = looked_up.join(index, "anchor").where(F.size(F.array_except("items", "t")) == 0)
    best = F.max(F.struct(F.col("confidence"), F.array_join("items", " & ").alias("bad_rule"))).alias("best")
    return scratch.save(hits.groupBy("url").agg(best).select("url", F.col("best.confidence").alias("confidence"), F.col("best.bad_rule").alias("bad_rule")), "bad")


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    scratch: Scratch,
    rules: Sequence[tuple[str, str]] = RULES,
    support: float = 0.0005,
    count: int = 8,
    confidence: float = 0.8,
) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url); and the mined rule that blocks it."""
    mined = mine_rules(pages, labels, scratch, support, count, confidence)
    bad = bad_urls(pages, mined, scratch)
    scratch.keep_only("bad")
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).join(bad, "url", "left")
    fit = explicit_rule(F.col("host"), F.col("path"), rules)
    out = rows.select("page_id", "host", "path", fit.alias("fit"), "bad_rule", "confidence")
    method = F.when(F.col("bad_rule").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "bad_rule", "confidence")
