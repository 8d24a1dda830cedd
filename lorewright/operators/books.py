"""Structure of books: anchors, blocks, deduplication and chunks (WIN13, S15, MX13-MX16, WIN15).

Order-dependent algorithms run document by document over sorted partitions: a document's catalog or
block list is what bounds a group. Everything around them is columns.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: str | None, b: str | None) -> float:
    """ST39: similarity of sequence matching."""
    return difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).ratio()


@F.pandas_udf(T.DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """ST39 as a column; titles that meet more than once in a batch are compared once."""
    known: dict[tuple, float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = ratio(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def similar_titles(a: str, b: str, least: float = 0.78) -> bool:
    return bool(a) and bool(b) and (a == b or a in b or b in a or ratio(a, b) >= least)


def are_similar_titles(a: Column, b: Column, least: float = 0.78) -> Column:
    """ST39 as a column: equal, one within the other, or similar; the ratio is worked out only where lengths let it reach ``least``."""
    shorter, longer = F.least(F.char_length(a), F.char_length(b)), F.greatest(F.char_length(a), F.char_length(b))
    reachable = 2 * shorter >= least * (shorter + longer)
    similar = F.when(reachable, title_ratio(F.when(reachable, a), F.when(reachable, b)) >= least).otherwise(False)
    return F.coalesce((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a) | similar), F.lit(False))


def best_increasing(lines: Sequence[int], confidence: Sequence[float]) -> list[int]:
    """WIN13, A6: positions of the longest strictly increasing sequence, then of most confidence; the earliest wins ties.

    A Fenwick tree over the ranks of lines holds the best chain that ends at or before each: n log n.
    """
    rank = {line: i + 1 for i, line in enumerate(sorted(set(lines)))}
    nothing = (0, 0.0, 0)  # length, confidence, minus the position that ends the chain
    tree = [nothing] * (len(rank) + 1)
    before: list[int] = []
    best, end = nothing, -1
    for i, line in enumerate(lines):
        top, at = nothing, rank[line] - 1
        while at:
            top = max(top, tree[at])
            at -= at & -at
        before.append(-top[2] if top[0] else -1)
        chain = (top[0] + 1, top[1] + confidence[i], -i)
        if chain[:2] > best[:2]:
            best, end = chain, i
        at = rank[line]
        while at < len(tree):
            tree[at] = max(tree[at], chain)
            at += at & -at
    kept = []
    while end >= 0:
        kept.append(end)
        end = before[end]
    return kept[::-1]


def by_document(rows: DataFrame, key: str, order: list[str], columns: list[str], work: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``work`` on each document's rows (``columns``, in ``order``), documents of a partition one after another.

    Rows of a document lie together in one sorted partition, so many small documents cost one pass
    over Arrow batches; one document at a time is held.
    """
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, []
        for pdf in batches:
            out = []
            for k, *row in pdf[[key, *columns]].astype(object).where(pdf[[key, *columns]].notna(), None).itertuples(index=False, name=None):
                if k != current and held:
                    out += [(current, *r) for r in work(held)]
                    held = []
                current = k
                held.append(tuple(row))
            if out:
                yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame([(current, *r) for r in work(held)], columns=names)

    sorted_rows = rows.select(key, *columns).repartition(key).sortWithinPartitions(key, *order)
    return sorted_rows.mapInPandas(run, schema)


def consistent_anchors(anchors: DataFrame) -> DataFrame:
    """(doc_id, pos, line, confidence) with ``kept``: anchors outside the best increasing chain are rejected."""

    def work(rows: list[tuple]) -> list[tuple]:
        matched = [i for i, r in enumerate(rows) if r[1] is not None]
        kept = set(matched) if len(matched) < 2 else {matched[i] for i in best_increasing([int(rows[i][1]) for i in matched], [float(rows[i][2] or 0.0) for i in matched])}
        return [(*r, i in kept) for i, r in enumerate(rows)]

    return by_document(anchors, "doc_id", ["pos", "line", "confidence"], ["pos", "line", "confidence"], work, "doc_id long, pos long, line long, confidence double, kept boolean")


def greedy_blocks(rows: list[tuple[str, str, int, int, float]], least: float = 0.70) -> list[tuple[str, str, int, int, float]]:
    """S15, A5: (block_id, title, start, end, confidence) without duplicates; order-dependent, no closure."""
    kept: list[tuple[str, str, int, int, float]] = []
    for r in sorted(rows, key=lambda x: (x[2], x[3])):
        for i, k in enumerate(kept):
            shorter = min(r[3] - r[2], k[3] - k[2]) + 1
            overlap = min(r[3], k[3]) - max(r[2], k[2]) + 1
            if r[0] == k[0] or (shorter > 0 and overlap / shorter >= least and similar_titles(r[1], k[1])):
                if (r[4], r[3] - r[2]) > (k[4], k[3] - k[2]):
                    kept[i] = r
                break
        else:
            kept.append(r)
    return sorted(kept, key=lambda x: (x[2], x[3]))


def unique_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, title, start, end, confidence) after greedy deduplication."""
    names = ["block_id", "title", "start", "end", "confidence"]
    return by_document(blocks, "doc_id", ["start", "end", "block_id", "title", "confidence"], names, greedy_blocks, "doc_id long, block_id string, title string, start long, end long, confidence double")


_BOUNDARY = re.compile(r"^\s*(?:#{1,6}\s|[-*+]\s|\d+[.)、]|(?:定义|定理|例|证明))")
_SENTENCE = re.compile(r"(?<=[。！？.!?])")


def units(lines: list[str], target: int) -> list[str]:
    """MX14, A8: boundary lines by themselves, others together; what is too long is split by line, sentence, and length."""
    groups: list[list[str]] = []
    for line in lines:
        if not line.strip() or _BOUNDARY.match(line) or not groups or not groups[-1][-1].strip() or _BOUNDARY.match(groups[-1][-1]):
            groups.append([line])
        else:
            groups[-1].append(line)
    out: list[str] = []
    for g in groups:
        whole = "\n".join(g)
        for line in [whole] if len(whole) <= target else g:
            if len(line) <= target:
                out.append(line)
                continue
            part = ""
            for sentence in _SENTENCE.split(line):
                if part and len(part) + len(sentence) > target:
                    out.append(part)
                    part = ""
                part += sentence
                while len(part) > target:
                    out.append(part[:target])
                    part = part[target:]
            if part:
                out.append(part)
    return out


def pack(text: str, target: int = 2000, hard: int = 3000) -> list[str]:
    """MX14, A8: one part unless the text exceeds ``hard``; parts fill greedily up to ``target``."""
    if len(text) <= hard:
        return [text] if text.strip() else []
    parts: list[str] = []
    current: list[str] = []
    size = 0
    for unit in units(text.split("\n"), target):
        if current and size + 1 + len(unit) > target:
            parts.append("\n".join(current))
            current, size = [], 0
        size += len(unit) + (1 if current else 0)
        current.append(unit)
    if current:
        parts.append("\n".join(current))
    return [p for p in parts if p.strip()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def packed(texts: pd.Series) -> pd.Series:
    """MX14 as a column."""
    return texts.map(lambda t: pack(t or ""))


def overlapping_pieces(text: str, size: int = 3000, overlap: int = 300) -> list[str]:
    """WIN15, A9: pieces of ``size`` cut at sentence ends past the half, each starting ``overlap`` before the last end."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while True:
        end = min(start + size, len(text))
        if end < len(text):
            for mark in ("。", "！", "？", "\n\n", "；"):
                at = text.rfind(mark, start, end)
                if at >= start + size // 2:
                    end = at + len(mark)
                    break
        out.append(text[start:end])
        if end >= len(text):
            return out
        start = max(end - overlap, start + 1)


@F.pandas_udf(T.ArrayType(T.StringType()))
def pieces(texts: pd.Series) -> pd.Series:
    """WIN15 as a column."""
    return texts.map(lambda t: overlapping_pieces(t or ""))


def chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, part, n_parts, content: packed chunks of every text."""
    parts = docs.select(key, packed(F.col(text)).alias("parts"))
    return parts.select(key, F.size("parts").cast("long").alias("n_parts"), F.posexplode("parts").alias("p", "content")).select(
        key, (F.col("p") + 1).cast("long").alias("part"), "n_parts", "content"
    )
