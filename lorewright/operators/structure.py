"""Candidates, anchors and plans of a book's structure (JN16, WIN12, WIN19, MX12, MX13, SUP16-SUP19).

Lines are rows (doc_id, line_no, text), catalogs rows (doc_id, catalog_index, level, title). A window
never holds more than six lines around a line, or one document's catalog.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .books import by_document, title_ratio
from .joins import points_in_ranges
from .windows import one_per_line

#: The priority of each kind of candidate, and what it is worth in a score.
PRIORITY = {"short_title": 10, "numbered_line": 20, "markdown_heading": 30, "chapter_group": 40}
WORTH = {"chapter_group": 28.0, "markdown_heading": 22.0, "numbered_line": 16.0, "short_title": 5.0}
BLOCK_TYPES = ("concept", "theorem", "definition", "example", "exercise", "section", "unknown")

IS_MARKER, IS_CHAPTER = r"(?i)^\s*#*\s*CHAPTER\b", r"第\s*\d+\s*章"


def any_number(text: Column) -> Column:
    """The first dotted number of a line without leading zeros, else empty."""
    return F.array_join(F.transform(F.split(F.regexp_extract(text, r"(\d+(?:\.\d+)*)", 1), r"\."), lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")), ".")


def chapter_groups(lines: DataFrame) -> DataFrame:
    """WIN19: (doc_id, line_no, until, text, number_key): a chapter mark and the headings up to six lines before
    it, or a chapter title and the headings and marks up to six lines after it, as one candidate."""
    marked = lines.select(
        "doc_id", "line_no", "text", T.is_heading(F.col("text")).alias("heading"), F.rlike("text", F.lit(IS_MARKER)).alias("marker"), F.rlike("text", F.lit(IS_CHAPTER)).alias("chapter"), any_number(F.col("text")).alias("key")
    )
    w = Window.partitionBy("doc_id").orderBy("line_no")
    row = F.struct("line_no", F.trim("text").alias("text"), "heading", "marker")
    near = marked.withColumn("before", F.collect_list(row).over(w.rowsBetween(-6, -1))).withColumn("after", F.collect_list(row).over(w.rowsBetween(1, 6)))
    near = near.where((F.col("marker") | F.col("chapter")) & (F.col("key") != ""))
    none = F.slice("before", 1, 0)
    heads = F.when(F.col("marker"), F.filter("before", lambda x: x["heading"])).otherwise(none)
    tails = F.when(F.col("chapter"), F.filter("after", lambda x: x["heading"] | x["marker"])).otherwise(none)
    group = near.select("doc_id", "key", F.concat(heads, F.array(F.struct("line_no", F.trim("text").alias("text"), "heading", "marker")), tails).alias("g"))
    text = F.array_join(F.transform(F.filter("g", lambda x: x["text"] != ""), lambda x: x["text"]), " | ")
    return group.select("doc_id", F.get("g", 0)["line_no"].alias("line_no"), F.element_at("g", -1)["line_no"].alias("until"), text.alias("text"), F.col("key").alias("number_key"))


def candidates(lines: DataFrame, short: int = 40) -> DataFrame:
    """(doc_id, line_no, priority, text, reasons): the candidate of highest priority on each line."""
    text, key = F.col("text"), T.number_key(F.col("text"))
    title_like = (F.trim(text) != "") & (F.char_length(F.trim(text)) <= short) & ~T.only_numbering(text)
    heading = T.is_heading(text)
    kind = lambda name, reason: F.struct(F.lit(PRIORITY[name]).alias("priority"), reason.alias("reason"))
    numbered = F.when((key != "") & (heading | title_like), kind("numbered_line", F.concat(F.lit("number "), key)))
    found = F.array_compact(F.array(F.when(heading, kind("markdown_heading", F.lit("heading"))), numbered.when(title_like, kind("short_title", F.lit("short title")))))
    single = lines.select("doc_id", "line_no", "text", F.explode(found).alias("f")).select("doc_id", "line_no", "text", "f.priority", "f.reason")
    groups = chapter_groups(lines).select("doc_id", "line_no", "text", F.lit(PRIORITY["chapter_group"]).alias("priority"), F.concat(F.lit("group "), "number_key").alias("reason"))
    return one_per_line(single.union(groups), "doc_id", "line_no")


def _candidate_pairs(catalog: DataFrame, found: DataFrame, spans: DataFrame) -> DataFrame:
    """Items and lines of a document in pairs, with titles a and b and all parts of a score but the similarity.

    What one side tells is worked out before they meet, once a row and not once a pair.
    """
    worth = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in WORTH.items()], F.lit(0.0))
    expected = (F.col("catalog_index") - 1) / F.greatest(F.lit(1), F.col("n_items") - 1)
    actual = (F.col("line_no") - F.col("first")) / F.greatest(F.lit(1), F.col("last") - F.col("first"))
    items = catalog.select("doc_id", "catalog_index", expected.alias("expected"), T.normal_title(F.col("title")).alias("a"), T.number_key(F.col("title")).alias("x"))
    lines = found.join(spans, "doc_id").select("doc_id", "line_no", worth.alias("worth"), actual.alias("actual"), T.normal_title(F.col("text")).alias("b"), T.number_key(F.col("text")).alias("y"))
    items, lines = (r.withColumn(f"{c}_dot", F.concat(F.col(c), F.lit("."))) for r, c in ((items, "x"), (lines, "y")))
    pairs = items.join(lines, "doc_id")
    a, b, x, y = (F.col(c) for c in "abxy")
    number = F.when((x != "") & (x == y), 120.0).when((x != "") & (y != "") & (F.startswith(y, F.col("x_dot")) | F.startswith(x, F.col("y_dot"))), 10.0).otherwise(0.0)
    filled = (a != "") & (b != "")
    within = F.when(filled & (F.contains(a, b) | F.contains(b, a)), 18.0).otherwise(0.0)
    place = F.greatest(F.lit(0.0), 6 - F.abs(F.col("actual") - F.col("expected")) * 6)
    parts = [number.alias("number"), within.alias("within"), place.alias("place")]
    return pairs.select("doc_id", "catalog_index", "line_no", "a", "b", "worth", filled.alias("filled"), ((x != "") & (x == y)).alias("exact"), *parts)


def _shared(a: Column, b: Column, within: Column) -> Column:
    """How many characters the matching pieces of two titles hold at most: those that the other one has too."""
    others = lambda x, y: F.char_length(x) - F.char_length(F.call_function("translate", x, y, F.lit("")))
    return F.when(within, F.least(F.char_length(a), F.char_length(b))).otherwise(F.least(others(a, b), others(b, a)))


def _as_many(a: Column, b: Column, n: Column) -> Column:
    """Whether the matching pieces hold these ``n`` for certain: one character is a piece, and where the ``n`` at an end of one
    title stand in the other, they are the longest piece."""
    ends = [F.contains(y, end(x, n)) for x, y in ((b, a), (a, b)) for end in (F.right, F.left)]
    return F.coalesce(reduce(or_, ends, n <= 1), F.lit(True))


def _score(ratio: Column) -> Column:
    """Terms in one order, so that equal pairs have equal scores."""
    return F.round(_raw_score(ratio), 3)


def _raw_score(ratio: Column) -> Column:
    similar = F.when(F.col("filled"), ratio * 55 + F.col("within")).otherwise(0.0)
    return F.col("worth") + F.col("number") + similar + F.col("place")


def candidate_scores(catalog: DataFrame, found: DataFrame, spans: DataFrame) -> DataFrame:
    """JN16: every catalog item of a document with every candidate of it, scored.

    ``catalog`` (doc_id, catalog_index, n_items, title), ``found`` (doc_id, line_no, kind, text),
    ``spans`` (doc_id, first, last) of the body's lines.
    """
    return _candidate_pairs(catalog, found, spans).select("doc_id", "catalog_index", "line_no", _score(title_ratio("a", "b")).alias("score"), "exact")


def top_candidates(catalog: DataFrame, found: DataFrame, spans: DataFrame, k: int = 8) -> DataFrame:
    """JN16, RET14: the ``k`` best candidates of every item and all of its number, scored; as if all pairs had been.

    The ratio of two titles is 2 * (characters of their matching pieces) / (both lengths). It is worked out only where
    columns do not tell it and it lets a pair reach the k-th best of what its item has for certain: known scores, and of other
    pairs those with one matching character. Bars are compared before rounding, one unit of it lower.
    """
    a, b = F.col("a"), F.col("b")
    ratio = lambda n: F.try_divide(2 * n, F.char_length(a) + F.char_length(b))
    pairs = _candidate_pairs(catalog, found, spans).withColumn("shared", _shared(a, b, F.col("within") > 0))
    pairs = pairs.withColumns({"known": _as_many(a, b, F.col("shared")), "at_most": _raw_score(ratio(F.col("shared")))})
    least = F.when(F.col("known"), F.col("at_most")).otherwise(_raw_score(ratio(F.lit(1))))
    item, parts = ["doc_id", "catalog_index"], ["filled", "exact", "worth", "number", "within", "place"]
    pairs = pairs.select(*item, "line_no", *parts, "known", "at_most", least.alias("at_least"), *[F.when(~F.col("known"), x).alias(n) for n, x in (("a", a), ("b", b))])
    best = Window.partitionBy(*item).orderBy(F.desc("at_least")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    reach = pairs.withColumn("bar", F.nth_value("at_least", k).over(best)).where(F.col("exact") | F.col("bar").isNull() | (F.col("at_most") >= F.col("bar") - 0.001))
    score = F.round(F.when(F.col("known"), F.col("at_most")).otherwise(_raw_score(title_ratio("a", "b"))), 3)
    w = Window.partitionBy(*item).orderBy(F.desc("score"), "line_no")
    scored = reach.select(*item, "line_no", score.alias("score"), "exact")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("exact") | (F.col("rank") <= k)).select(*item, "line_no", "score", "exact")


def preferred(rows: DataFrame, keys: list[str]) -> DataFrame:
    """WIN12: of duplicates (start, end, confidence) the most confident, then the longest."""
    others = [c for c in rows.columns if c not in keys]
    rank = F.struct("confidence", (F.col("end") - F.col("start")).alias("length"), (-F.col("start")).alias("first"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("r")).select(*keys, "r.*")


def plan_faults(line_count: Column) -> Column:
    """MX12: what is wrong with a plan record (block_id, start, end, window_start, window_end, confidence), in order."""
    c = {n: F.col(n) for n in ("block_id", "start", "end", "window_start", "window_end", "confidence")}
    whole = c["start"].isNotNull() & c["end"].isNotNull()
    checks = [
        (~whole, "lines"),
        (whole & ((c["start"] < 1) | (c["end"] > line_count)), "bounds"),
        (whole & (c["start"] > c["end"]), "order"),
        (whole & (c["start"] < c["window_start"]), "window start"),
        (whole & (c["end"] > c["window_end"]), "window end"),
        (F.trim(F.coalesce(c["block_id"], F.lit(""))) == "", "block_id"),
        (~F.coalesce(c["confidence"], F.lit(0.0)).between(0, 1), "confidence"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for bad, name in checks]))


def plan_records(records: DataFrame, line_count: Column) -> DataFrame:
    """MX12: valid records only, with a known block type and the image lines that lie within."""
    kind = F.when(F.col("block_type").isin(*BLOCK_TYPES), F.col("block_type")).otherwise("unknown")
    inside = F.filter(F.coalesce("image_lines", F.array().cast("array<long>")), lambda x: x.between(F.col("start"), F.col("end")))
    return records.where(F.size(plan_faults(line_count)) == 0).withColumn("block_type", kind).withColumn("image_lines", inside)


def anchor_states(anchors: DataFrame, catalog: DataFrame) -> DataFrame:
    """SUP16: each catalog item with what its stored anchors allow: absent or repeated ones are invalid, one is checked again."""
    stored = anchors.groupBy("doc_id", "catalog_index").agg(F.count(F.lit(1)).alias("n"), F.max("start").alias("stored"))
    state = F.when(F.col("n").isNull(), "absent").when(F.col("n") > 1, "repeated").otherwise("revalidate")
    return catalog.join(stored, ["doc_id", "catalog_index"], "left").select("doc_id", "catalog_index", state.alias("state"), F.when(F.col("n") == 1, F.col("stored")).alias("start"))


def source_missing(review_status: Column, *flags: Column) -> Column:
    """SUP17: whether a reviewer marked an item as missing in the source."""
    out = F.coalesce(review_status == "source_missing", F.lit(False))
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return out


def missing_faults(reason: Column, start: Column, candidate: Column) -> Column:
    """SUP17: what contradicts the mark."""
    return F.array_compact(F.array(F.when(F.trim(F.coalesce(reason, F.lit(""))) == "", "no reason"), F.when(start.isNotNull(), "has a line"), F.when(candidate.isNotNull(), "has a candidate")))


def to_repair(anchors: DataFrame, found: DataFrame) -> DataFrame:
    """SUP18: matched anchors whose candidate agrees in its line, but whose confidence or reason is not usable."""
    lines = found.select("doc_id", F.col("candidate_id"), F.col("line_no").alias("start"))
    bad = F.col("confidence").isNull() | ~F.col("confidence").between(0, 1) | (F.trim(F.coalesce("reason", F.lit(""))) == "")
    return anchors.where("matched").where(bad).join(lines, ["doc_id", "candidate_id", "start"], "left_semi")


def _bounds(rows: list[tuple]) -> list[tuple]:
    """Rows (catalog_index, level, start, last) in order, backwards over stacks of what may still close an item.

    On a stack stays what no nearer item of its level or above hides, so levels grow towards its top and
    the next item of a level or above is found by bisection. One stack holds all items, one the matched.
    """
    levels, indices, matched_levels, starts = [], [], [], []
    ahead, next_level, out = None, None, []

    def nearest(of_levels: list, values: list, level: int):
        at = bisect_right(of_levels, level) - 1
        return values[at] if at >= 0 else None

    def push(of_levels: list, values: list, level: int, value: int) -> None:
        while of_levels and of_levels[-1] > level:
            of_levels.pop()
            values.pop()
        of_levels.append(level)
        values.append(value)

    for index, level, start, last in reversed(rows):
        closing = None if level is None else nearest(levels, indices, level)
        within = ahead is not None and (closing is None or ahead[0] < closing)
        bound = ahead[1] if within else None if level is None else nearest(matched_levels, starts, level)
        if start is not None:
            out.append((index, start, last if bound is None else bound - 1, level is not None and next_level is not None and next_level > level))
            ahead = (index, start)
            if level is not None:
                push(matched_levels, starts, level, start)
        if level is not None:
            push(levels, indices, level, index)
        next_level = level
    return out[::-1]


def structure_plan(catalog: DataFrame, lines: DataFrame) -> DataFrame:
    """MX13: matched catalog items (doc_id, catalog_index, level, start, last line) as blocks.

    A block ends before the next matched item: its first descendant, or else the next of its level or
    above. An item without children is a leaf; one with children is direct if its own lines hold text,
    else structural. A catalog is read once, backwards; lines meet the blocks they lie in bucket by bucket.
    """
    columns = ["catalog_index", "level", "start", "last"]
    rows = catalog.select("doc_id", *[F.col(c).cast("long").alias(c) for c in columns])
    blocks = by_document(rows, "doc_id", ["catalog_index"], columns, _bounds, "doc_id long, catalog_index long, start long, end long, has_children boolean")
    text = F.trim("text")
    body = lines.where((text != "") & ~T.is_heading(F.col("text")) & ~F.rlike("text", F.lit(IS_MARKER)) & ~F.startswith(text, F.lit("!["))).select("doc_id", "line_no")
    parents = blocks.where("has_children and start <= end").select("doc_id", "catalog_index", "start", "end")
    held = points_in_ranges(body, parents, ["doc_id"], "line_no", "start", "end").select("doc_id", "catalog_index").distinct()
    marked = blocks.join(held.withColumn("direct", F.lit(True)), ["doc_id", "catalog_index"], "left")
    scope = F.when(~F.col("has_children"), "leaf").when(F.col("direct"), "direct").otherwise("structural")
    return marked.select("doc_id", "catalog_index", "start", "end", scope.alias("scope"), (scope != "structural").alias("extract"))
