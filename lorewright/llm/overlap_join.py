"""N-gram Jaccard join by T-occurrence search on inverted lists.

Every document is the set of its distinct k-word shingles; equal sets form one class, and only classes
take part. Two sets with a similarity of ``percent`` share at least alpha(n) = ceil(percent * n / 100)
shingles, n being the size of either. Every bound below holds for every pair, so no link is lost.

1. Routing, over all classes. Shingles have one order, that of their hashes. Of a set its first
   n - alpha(n) + l(n) shingles are posted, l(n) = 1 + n // 10: two similar sets have at least
   min(l) posted shingles in common. Posted shingles of one class only are dead. A class with fewer live
   ones than any partner would need leaves the search: that are nearly all documents without partner,
   also those that share a passage with many. Of m live ones the m - need + 1 rarest are kept, among
   which two similar sets still share one. Each task posts a class once, however many copies it reads.
2. Classes that share a kept shingle are contracted to groups, in Spark, over one link from each of them
   to the least one of the shingle. Each class's whole set goes to its group once; a table of bits of
   fixed size keeps nearly all texts without a group out of that shuffle.
3. Search: a group's sets are indexed by inverted lists, and each set in turn is searched for among those
   not reached yet (DivideSkip). Of the lists of its shingles the long ones are set apart, as many as the
   usual balance T / (mu log2 M + 1) gives; the short ones are merged, as sorted runs in one pass of
   numpy in place of a heap of list heads; what occurs often enough there to reach T with the long lists
   is probed in those by binary search, and stays if it reaches the overlap of its own size.
4. Groups beyond ``group_limit`` classes or ``group_shingles`` shingles stay spread over tasks and are
   searched in buckets and blocks with the same search (see the large groups of ``minhash_join``).

Rows: every input row gives one output row, an empty table none. A row without words has an empty set
and stays alone. A row without ``doc_id`` has no component. Repeated rows share theirs. Very long texts
are read whole. A similarity equal to the threshold links. Only ``doc_id`` and ``text`` are looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .minhash_join import bucketed_search, components, dealt, search_across, search_within, shingle_set, signature

#: Buckets of large groups are drawn by one of so many MinHash tokens.
_WIDTH = 8
#: Bits that tell before a shuffle whether a document is in a group: 8 MB, at every size of the input.
_SLOTS = 1 << 26


def _class(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _needed(n, percent: int):
    """The least overlap of a set of n shingles with any similar one."""
    return -(-percent * n // 100)


def _slack(n):
    """How many posted shingles two similar sets have in common, by the smaller one's size."""
    return 1 + n // 10


def _key(cid: bytes) -> int:
    return int.from_bytes(cid[:8], "big", signed=True)


def _sizer(k: int):
    """doc_id, set size, class and class key of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes = [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, k)
                sizes.append(len(s))
                classes.append(_class(s) if len(s) else None)
            keys = pa.array([x and _key(x) for x in classes], pa.int64())
            arrays = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), keys]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "cid", "key"])

    return run


def _poster(k: int, percent: int, remembered: int = 500_000, ready: int = 200_000):
    """token and class key of every posted shingle; a task posts a class once (again after ``remembered`` others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        tokens, keys, held = [], [], 0

        def full() -> pa.RecordBatch:
            flat = np.concatenate(tokens) if tokens else np.empty(0, np.uint64)
            owner = np.repeat(np.array(keys, np.int64), [len(x) for x in tokens])
            return pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(owner, pa.int64())], ["token", "key"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, k)
                n = len(s)
                if not n or (n == _needed(n, percent) and 100 * n // percent == n):
                    continue  # similar to equal sets only
                cid = _class(s)
                if cid in seen:
                    continue
                if len(seen) >= remembered:
                    seen.clear()
                seen.add(cid)
                tokens.append(s[: n - _needed(n, percent) + _slack(n)])
                keys.append(_key(cid))
                held += len(tokens[-1])
                if held > ready:
                    yield full()
                    tokens, keys, held = [], [], 0
        yield full()

    return run


def _bits(ids: DataFrame, scratch: Scratch) -> np.ndarray:
    """A bit for the hash of each doc_id, ``_SLOTS`` of them whatever their number: it tells most rows apart that are not meant."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(_SLOTS))
    words = ids.select(F.floor(slot / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit"))
    words = scratch.save(words.groupBy("word").agg(F.bit_or("bit").alias("bits")), "bits")
    out = np.zeros(_SLOTS // 64, np.int64)
    for r in words.toLocalIterator():
        out[r.word] = r.bits
    return out


def _meant_sets(k: int, held):
    """Class, whole set and a few MinHash tokens (for large groups) of the rows (text, slot) whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value.view(np.uint64)
        for batch in batches:
            slot = batch.column("slot").to_numpy(zero_copy_only=False)
            hit = (bits[slot // 64] >> (slot % 64).astype(np.uint64)) & np.uint64(1)
            sets = [shingle_set(text, k) for text in batch.column("text").filter(pa.array(hit.astype(bool))).to_pylist()]
            sets = [s for s in sets if len(s)]
            columns = ([_class(s) for s in sets], [signature(s, _WIDTH).tobytes() for s in sets], [s.tobytes() for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["cid", "sig", "shingles"])

    return run


class InvertedLists:
    """The inverted lists of some sets of shingles, for T-occurrence search."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.n = percent, len(sets)
        self.sizes = np.fromiter(map(len, sets), np.int64, self.n)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(self.n), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.shingles, self.start = np.unique(flat[order], return_index=True)
        self.end = np.append(self.start[1:], len(flat))
        self.owner = owner[order]  # ascending within each list
        # list and owner in one number, ascending throughout: one binary search probes any list
        self.entry = np.repeat(np.arange(len(self.shingles)), self.end - self.start) * self.n + self.owner

    def similar(self, query: np.ndarray, among: np.ndarray, mu: float = 0.0085) -> np.ndarray:
        """Positions of the sets marked in ``among`` that are similar to ``query``."""
        n, none = len(query), np.empty(0, np.int64)
        least = max(1, int(_needed(n, self.percent)))
        at = np.searchsorted(self.shingles, query)
        at = at[self.shingles[np.minimum(at, len(self.shingles) - 1)] == query]
        if len(at) < least:
            return none
        lengths = self.end[at] - self.start[at]
        order = np.argsort(lengths, kind="stable")
        at, lengths = at[order], lengths[order]
        n_long = min(least - 1, int(least / (mu * np.log2(lengths[-1]) + 1)))
        short, long, size = at[: len(at) - n_long], at[len(at) - n_long :], lengths[: len(at) - n_long]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[short], size)
        merged = np.sort(self.owner[place], kind="stable")  # merges the sorted runs
        first = np.flatnonzero(np.append(True, merged[1:] != merged[:-1])) if len(merged) else none
        found, count = merged[first], np.diff(np.append(first, len(merged)))
        fits = (count >= least - n_long) & among[found] & (100 * n >= self.percent * self.sizes[found]) & (100 * self.sizes[found] >= self.percent * n)
        found, count = found[fits], count[fits]
        step = max(1, 2_000_000 // max(1, n_long))
        for i in range(0, len(found), step):
            probe = long[:, None] * self.n + found[None, i : i + step]
            here = np.searchsorted(self.entry, probe)
            count[i : i + step] += (self.entry[np.minimum(here, len(self.entry) - 1)] == probe).sum(axis=0)
        return found[100 * count >= self.percent * (n + self.sizes[found] - count)]


def overlap_roots(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each of some non-empty sets the position of the first one that links reach, itself included."""
    n = len(sets)
    root, left, lists, among = np.arange(n), np.arange(n), InvertedLists(sets, percent), np.ones(n, bool)
    waiting = n
    reached = np.zeros(n, bool)
    for first in range(n):
        if reached[first]:
            continue
        queue, reached[first] = [first], True
        among[np.searchsorted(left, first)] = False
        waiting -= 1
        while queue and waiting:
            if 2 * waiting < len(left):  # lists of those that are left only
                left, among = left[among], np.ones(waiting, bool)
                lists = InvertedLists([sets[i] for i in left], percent)
            near = lists.similar(sets[queue.pop()], among)
            among[near] = False
            waiting -= len(near)
            reached[left[near]], root[left[near]] = True, first
            queue += left[near].tolist()
    return root.tolist()


def _block_of(percent: int) -> Callable[[list[np.ndarray]], Callable[[np.ndarray], np.ndarray]]:
    """A block of sets as a function that finds the similar ones of a set."""

    def block(sets: list[np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
        lists, among = InvertedLists(sets, percent), np.ones(len(sets), bool)
        return lambda query: lists.similar(query, among)

    return block


def _routes(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(key, token): the kept shingles of every class that may have a partner."""
    posted = docs.select("text").mapInArrow(_poster(k, percent), "token long, key long").repartition("token").distinct()
    live = posted.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("many > 1")
    live = live.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("many", "token"))).alias("live"))  # of one set
    need = F.expr(f"1 + (({percent} * n + 99) div 100) div 10").cast("int")
    kept = live.join(classes.select("key", "n"), "key").select("key", "live", (F.size("live") - need + 1).alias("most")).where("most > 0")
    return kept.select("key", F.explode(F.slice("live", F.lit(1), F.col("most"))).alias("post")).select("key", "post.token")


def overlap_components(
    docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80, group_limit: int = 4000, group_shingles: int = 4_000_000, rounds: int = 3
) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs`` (doc_id, text).

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of distinct
    k-word shingles; component_id is the least doc_id reachable over links.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch.save(docs.mapInArrow(_sizer(k), "doc_id long, n_shingles long, cid binary, key long"), "rows")
    classes = rows.where("cid is not null and doc_id is not null").groupBy("cid", "key")
    classes = scratch.save(classes.agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")), "classes")
    routes = _routes(docs, classes, k, percent)
    links = routes.select(F.col("key").alias("a"), F.min("key").over(Window.partitionBy("token")).alias("b")).where("a <> b").distinct()
    groups = components(scratch.save(links, "links"), scratch, "groups").select(F.col("root").alias("grp"), F.col("node").alias("key"))
    wanted = groups.join(classes, "key").select("grp", "cid", "n", F.col("rep").alias("doc_id"))
    pieces = F.ceil(F.greatest(F.count(F.lit(1)) / group_limit, F.sum("n") / group_shingles)).cast("long")
    wanted = scratch.save(wanted.join(wanted.groupBy("grp").agg(pieces.alias("pieces"), F.count(F.lit(1)).alias("many")).where("many > 1"), "grp"), "wanted")
    held = docs.sparkSession.sparkContext.broadcast(_bits(wanted, scratch))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(_SLOTS)).alias("slot")
    sets = docs.where("doc_id is not null").select("text", slot).mapInArrow(_meant_sets(k, held), "cid binary, sig binary, shingles binary")
    sets = scratch.save(sets.join(wanted.select("grp", "pieces", "cid", "n"), "cid").select("grp", "pieces", "cid", "n", "sig", "shingles"), "sets")
    within = search_within(lambda found: overlap_roots(found, percent))
    small = dealt(sets.where("pieces = 1").select(F.col("grp").alias("key"), "cid", "shingles"))
    labels = scratch.save(small.mapInArrow(within, "cid binary, root binary"), "labels-small")
    large = sets.where("pieces > 1")
    if not large.isEmpty():
        labels = labels.union(bucketed_search(large, scratch, within, search_across(_block_of(percent)), _WIDTH, group_limit, group_shingles, rounds))
    named = classes.join(labels, "cid", "left").select("cid", "rep", F.coalesce("root", "cid").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = scratch.save(named.join(least, "root").select("cid", "component_id"), "named")
    scratch.keep_only("rows", "named")
    out = rows.select("doc_id", "n_shingles", "cid").join(named, "cid", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
