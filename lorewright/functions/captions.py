"""Figure captions: number and text apart, what means nothing left out, captions compared (ST40, SUP22)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.books import title_ratio

#: How a caption begins, what follows it as its author, and captions that say nothing.
FIGURE = r"^\s*(图\s*\d+\s*[-－]\s*\d+)"
AUTHOR = r"(?i)\s*(?:作者\s*[:：]|(?<![A-Za-z])author\s*[:：]|(?<![A-Za-z])by\s+).*$"
MEANINGLESS = ("无图注", "image", "img", "图片", "图像", "photo", "picture", "screenshot", "截图")
_EDGES = r"^[ \t\r\n\-—:：;,，。]+|[ \t\r\n\-—:：;,，。]+$"


def figure_number(raw: Column) -> Column:
    """The figure's number without spaces; null where the caption has none."""
    found = F.regexp_replace(F.regexp_replace(F.regexp_extract(raw, FIGURE, 1), r"\s+", ""), "－", "-")
    return F.nullif(found, F.lit(""))


def caption_text(raw: Column) -> Column:
    """What the caption says, without number and author; null where that is nothing."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), FIGURE, ""), AUTHOR, "")
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), _EDGES, "")
    says = (text != "") & ~F.rlike(text, F.lit(FIGURE + r"\s*$")) & ~F.lower(text).isin(*MEANINGLESS)
    return F.when(says, text)


def meaningful_alt(alt: Column) -> Column:
    """The caption in an image's alternative text; none in paths, addresses, digests and empty words."""
    value = F.trim(F.coalesce(alt, F.lit("")))
    low = F.lower(value)
    nothing = low.isin("", *MEANINGLESS) | F.rlike(low, F.lit(r"^[0-9a-f]{8,}$")) | F.rlike(low, F.lit(r"images/|https?://|\.(?:jpe?g|png|webp)(?:\b|$)"))
    return F.when(~nothing, caption_text(value))


def compare_key(raw: Column) -> Column:
    """Letters, digits and Chinese characters of a caption, in lower case; empty where it says nothing."""
    return F.coalesce(F.regexp_replace(F.lower(caption_text(raw)), "[^0-9a-z一-鿿]+", ""), F.lit(""))


def captions_match(a: Column, b: Column, from_length: int = 8, least: float = 0.92) -> Column:
    """Compare keys are equal, or long enough and one within the other, or similar; ratios are worked out for the rest only."""
    shorter, longer = F.least(F.char_length(a), F.char_length(b)), F.greatest(F.char_length(a), F.char_length(b))
    within = F.contains(a, b) | F.contains(b, a)
    reachable = (shorter >= from_length) & (2 * shorter >= least * (shorter + longer))  # the ratio is 2 * matches / (both lengths)
    filled = (a != "") & (b != "")
    return filled & F.when(a == b, True).when((shorter >= from_length) & within, True).when(reachable, title_ratio(F.when(reachable, a), F.when(reachable, b)) >= least).otherwise(False)
