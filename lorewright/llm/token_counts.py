"""Token counts by a two-tier lookup of pre-token lengths.

A byte-level BPE never merges across pre-tokens, so a text's token count is the sum of its
pre-tokens' lengths. The first tier is one broadcast table of frequent pre-tokens and their lengths,
``table_size`` entries of up to ``longest`` characters at most. It comes from the whole texts of the rows
with the ``sample_rows`` least hashes of doc_id, wherever they lie in the table: Spark splits them where
they are read, sums the counts with a map-side combine and sends the most frequent pre-tokens only, no
text. The sample decides speed alone. The second tier is a cache in every Python worker; what it
lacks is encoded by the library itself, ``encode_rows`` pre-tokens a call, and kept up to
``cache_bytes`` of text, then the cache starts anew. Pre-tokens longer than ``longest`` characters
are not kept. Pre-tokens are never shuffled, each row is counted where it is read, and whole texts
are counted, in slices of a batch.

Strings of the vocabulary's added tokens count as one token each, as is the library's default. A
null text is empty: 0 bytes, 0 tokens. Every input row gives one output row, an empty table none; null
and repeated doc_ids and further columns make no difference. Very long texts are counted whole, a text
with exactly ``limit`` tokens is not over it.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of the byte-level vocabulary files.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PreTokenizer:
    """Splits texts into pre-tokens as the vocabulary's library does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE without prefix space or normalizer is needed")
        # The library's white space is Unicode's, without the separators U+001C to U+001F that Python adds.
        self.find = regex.compile(PRE_TOKEN.replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def __call__(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many added tokens stand in it."""
        if self.added is None or not self.added.search(text):
            return self.find(text), 0
        parts = self.added.split(text)
        return [x for part in parts for x in self.find(part)], len(parts) - 1


#: What a Python worker keeps from task to task, by vocabulary path.
_WORKER: dict[str, tuple] = {}


def _worker(path: str):
    if path not in _WORKER:
        from tokenizers import Tokenizer

        _WORKER[path] = (PreTokenizer(path), Tokenizer.from_file(path), {"cache": {}, "bytes": 0})
    return _WORKER[path]


def frequent_lengths(docs: DataFrame, path: str, sample_rows: int, table_size: int, longest: int) -> dict[str, int]:
    """The first tier: lengths of the pre-tokens that are frequent in a sample of whole texts."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _worker(path)[0]
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen = Counter(x for x in cut(text or "")[0] if len(x) <= longest)
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["token", "n"])

    rank = F.xxhash64("doc_id")
    last = docs.select(rank.alias("rank")).orderBy("rank").limit(sample_rows).agg(F.max("rank")).first()[0]  # one number
    counts = docs.where(rank <= F.lit(last)).select("text").mapInArrow(split, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    names = [r.token for r in counts.orderBy(F.desc("n"), "token").limit(table_size).collect()]
    encoded = _worker(path)[1].encode_batch(names, add_special_tokens=False)
    return {x: len(e.ids) for x, e in zip(names, encoded, strict=True)}


class _Counter:
    """Token counts of texts from the first tier, the worker's cache and, for the rest, the library."""

    def __init__(self, path: str, frequent: dict[str, int], cache_bytes: int, longest: int, encode_rows: int):
        self.split, self.tokenizer, self.kept = _worker(path)
        self.frequent, self.cache_bytes, self.longest, self.encode_rows = frequent, cache_bytes, longest, encode_rows

    def _encoded(self, missing: set[str]) -> dict[str, int]:
        out, names = {}, list(missing)
        for at in range(0, len(names), self.encode_rows):
            part = names[at : at + self.encode_rows]
            out.update(zip(part, [len(e.ids) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)], strict=True))
        return out

    def _keep(self, fresh: dict[str, int]) -> None:
        cache = self.kept["cache"]
        for token, n in fresh.items():
            if len(token) <= self.longest:
                cache[token] = n
                self.kept["bytes"] += 160 + 4 * len(token)  # a dictionary entry and its string, at most
        if self.kept["bytes"] > self.cache_bytes:
            cache.clear()
            self.kept["bytes"] = 0

    def __call__(self, texts: list[str]) -> list[int]:
        counts, waiting = [], []
        for at, text in enumerate(texts):
            tokens, added = self.split(text)
            lengths = list(map(self.frequent.get, tokens, repeat(0)))
            total = added + sum(lengths)
            if 0 in lengths:
                rest = [t for t, n in zip(tokens, lengths, strict=True) if not n]
                known = list(map(self.kept["cache"].get, rest, repeat(0)))
                total += sum(known)
                if 0 in known:
                    waiting.append((at, [t for t, n in zip(rest, known, strict=True) if not n]))
            counts.append(total)
        fresh = self._encoded({t for _, missing in waiting for t in missing})
        for at, missing in waiting:
            counts[at] += sum(map(fresh.__getitem__, missing))
        self._keep(fresh)
        return counts


def _slices(texts: list[str], chars: int) -> Iterator[list[str]]:
    """Consecutive texts of some ``chars`` characters together."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def token_counts(
    docs: DataFrame, path: str, limit: int = 1024, sample_rows: int = 2000, table_size: int = 30_000,
    cache_bytes: int = 160 << 20, longest: int = 64, encode_rows: int = 4096, slice_chars: int = 1 << 20,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    first_tier = spark.sparkContext.broadcast(frequent_lengths(docs, path, sample_rows, table_size, longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _Counter(path, first_tier.value, cache_bytes, longest, encode_rows)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            counts = [n for part in _slices(texts, slice_chars) for n in count(part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
