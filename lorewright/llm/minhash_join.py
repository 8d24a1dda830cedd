"""Near-duplicate components by a chosen-path set similarity join.

Every document is the set of its distinct k-word shingles. Equal sets form one class, and only
classes take part. A class has ``width`` MinHash tokens, its signature.

1. Candidates, on signatures. Each of several independent trees starts with all classes in one
   node; a node picks one or two of the token positions (1.25 on average, 1 / 0.8) and sends each
   class to one child for each picked position, named by the class's token there. A pair of
   similarity 0.8 stays together in at least one child about as often as not to die out, and
   ``trees`` independent trees make a loss in all of them rare. Nodes of at most ``leaf`` classes
   are compared exhaustively in one task; larger ones branch again. A node that is still large at
   ``depth`` is joined as a whole, so no pair is lost there.
2. Candidate pairs are contracted to candidate groups, in Spark. Each class's full set goes to its
   group once.
3. Links are confirmed on full sets, all of a group's: a group of up to ``group_limit`` classes and
   ``group_shingles`` shingles is searched breadth first in one task. Larger groups stay spread.
   Their members are first dealt into buckets of that size, ``rounds`` times by another token, so
   that similar ones mostly meet; every bucket is searched. More such turns follow while more members
   than one task takes stay apart and a fifth of them meets in each. Then members outside the group's
   largest component are compared with all its members, block by block. What is left apart has no
   link: no case is dropped, and only members that a few rounds leave outside meet the whole group.

Rows: every input row gives one output row, an empty table none. A row without words has an empty
set and stays alone. A row without ``doc_id`` can't be named as a partner: it has no component and is
kept. Repeated rows share their component. Very long texts are read whole; their signatures are made
in slices. A similarity equal to the threshold links. Columns other than ``doc_id`` and ``text`` are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

_MASK = (1 << 64) - 1


def _mixed(n: int, seed: int) -> np.ndarray:
    """n well-spread 64-bit numbers from a rule (splitmix64)."""
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    k = min(k, len(tokens))
    factors = _mixed(k, 11) | np.uint64(1)
    n = len(h) - k + 1
    s = np.full(n, k, np.uint64)
    for j in range(k):
        s = (s ^ (s >> np.uint64(29))) * factors[j] + h[j : j + n]
    s ^= s >> np.uint64(32)
    return np.unique(s * np.uint64(0xD6E8FEB86659FD93))


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    """``width`` MinHash tokens of 32 bits; long sets are read in slices, so memory is bounded."""
    xor, odd = _mixed(width, 23)[:, None], (_mixed(width, 37) | np.uint64(1))[:, None]
    best = np.full(width, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(best, ((shingles[None, at : at + 4096] ^ xor) * odd).min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketcher(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, classes, signatures = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, k)
                counts.append(len(s))
                classes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(signature(s, width).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(classes, pa.binary()), pa.array(signatures, pa.binary())],
                ["doc_id", "n_shingles", "cid", "sig"],
            )

    return run


def _setter(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sets = [], []
            for at, (cid, text) in enumerate(zip(batch.column("cid").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                data = shingle_set(text, k).tobytes()
                if hashlib.blake2b(data, digest_size=16).digest() == cid:  # a repeated doc_id may carry another text
                    kept.append(at)
                    sets.append(data)
            rows = batch.take(pa.array(kept, pa.int64()))
            names = ["grp", "pieces", "cid", "sig", "n"]
            yield pa.RecordBatch.from_arrays([*(rows.column(x) for x in names), pa.array(sets, pa.binary())], [*names, "shingles"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[tuple]]:
    """The rows of each value of ``key``, for rows sorted by it; one value's rows are held at a time."""
    key, rows = None, []
    for batch in batches:
        for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", *columns)), strict=True):
            if k != key and rows:
                yield rows
                rows = []
            key = k
            rows.append(row)
    if rows:
        yield rows


def _paired(found: Iterator[list[tuple[bytes, bytes]]], names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Lists of pairs as batches of some ten thousand."""
    ready: list[tuple[bytes, bytes]] = []
    for pairs in found:
        ready += pairs
        if len(ready) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in ready], pa.binary()) for i in (0, 1)], list(names))
            ready = []
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in ready], pa.binary()) for i in (0, 1)], list(names))


def exact_roots(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each of some non-empty sets the position of the first one that links reach, itself included.

    Breadth first: a set is marked in the vocabulary of all, and one pass over the sets not reached
    yet counts what they share with it.
    """
    n, root = len(sets), np.arange(len(sets))
    sizes = np.fromiter(map(len, sets), np.int64, n)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(flat.max()) + 1, bool)
    left, part, at = np.arange(n), flat, bounds[:-1]
    reached = np.zeros(n, bool)
    for first in range(n):
        queue = [] if reached[first] else [first]
        reached[first] = True
        while queue:
            keep = ~reached[left]
            if 2 * keep.sum() < len(left):
                part, left = part[np.repeat(keep, sizes[left])], left[keep]
                at = np.cumsum(sizes[left]) - sizes[left]
            if not len(left):
                break
            x = queue.pop()
            mark[flat[bounds[x] : bounds[x + 1]]] = True
            shared = np.add.reduceat(mark[part], at, dtype=np.int64)
            mark[flat[bounds[x] : bounds[x + 1]]] = False
            near = left[(100 * shared >= percent * (sizes[x] + sizes[left] - shared)) & ~reached[left]]
            reached[near] = True
            root[near] = first
            queue += near.tolist()
    return root.tolist()


def search_within(roots_of: Callable[[list[np.ndarray]], list[int]]):
    """Rows (key, cid, shingles) sorted by key to (cid, root), the root within its key, which ``roots_of`` finds."""

    def split(rows: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
        rows = sorted(dict(rows).items())  # repeated input rows give a set twice
        roots = roots_of([np.frombuffer(x, np.uint64) for _, x in rows]) if len(rows) > 1 else [0]
        return [(cid, rows[r][0]) for (cid, _), r in zip(rows, roots, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _paired(map(split, _runs(batches, "cid", "shingles")), ("cid", "root"))

    return run


def marked_block(percent: int) -> Callable[[list[np.ndarray]], Callable[[np.ndarray], np.ndarray]]:
    """A block of sets as a function that finds the positions of those similar to a set, which it marks in their vocabulary."""

    def block(sets: list[np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
        vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        at, mark = np.cumsum(sizes) - sizes, np.zeros(len(vocabulary), bool)

        def similar(own: np.ndarray) -> np.ndarray:
            here = np.searchsorted(vocabulary[:-1], own)  # one past the others is the last one's place
            here = here[vocabulary[here] == own]
            mark[here] = True
            shared = np.add.reduceat(mark[flat], at, dtype=np.int64)
            mark[here] = False
            return np.flatnonzero(100 * shared >= percent * (sizes + len(own) - shared))

        return similar

    return block


def search_across(block_of: Callable[[list[np.ndarray]], Callable[[np.ndarray], np.ndarray]]):
    """Rows (key, side, root, shingles) sorted by key and side, where side 0 is a block of outsiders and
    side 1 members of their group, to the pairs of roots that links between the two join."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, bytes]]]:
        key, block, similar, up = None, [], None, {}

        def find(x: bytes) -> bytes:
            while up.get(x, x) != x:
                x = up[x]
            return x

        for batch in batches:
            found = []
            for k, side, root, data in zip(*(batch.column(c).to_pylist() for c in ("key", "side", "root", "shingles")), strict=True):
                if k != key:
                    key, block, similar, up = k, [], None, {}
                own = np.frombuffer(data, np.uint64)
                if side == 0:
                    block.append((root, own))
                    continue
                if similar is None:
                    similar = block_of([x for _, x in block])
                for i in similar(own):
                    a, b = find(block[i][0]), find(root)
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        found.append((block[i][0], root))
            yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _paired(links(batches), ("a", "b"))

    return run


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of one ``key`` together and in one task: keys are made for groups of bounded size."""
    order = ["key", "side"] if "side" in rows.columns else ["key"]
    return rows.repartition("key").sortWithinPartitions(*order)


def bucketed_search(members: DataFrame, scratch: Scratch, within, across, width: int, limit: int, shingles: int, rounds: int) -> DataFrame:
    """(cid, root) for the members (grp, pieces, cid, sig, n, shingles) of groups too large for one task.

    ``pieces`` is the number of tasks' worth of members that the group has; ``within`` and ``across`` are what
    ``search_within`` and ``search_across`` give.
    """
    members = members.dropDuplicates(["cid"])
    ids = scratch.save(members.select("grp", "pieces", "cid", "sig", "n"), "large-ids")
    sets = members.select("cid", "shingles")

    def pieces(count: str, total: str) -> Column:
        return F.ceil(F.greatest(F.col(count) / limit, F.col(total) / shingles)).cast("long")

    stars, turn, apart = None, 1, None
    while True:  # as long as further turns bring members together
        turns = ids.select("grp", "cid", "sig", "n", F.explode(F.array(*map(F.lit, range(turn, turn + rounds)))).alias("turn"))
        at = F.pmod(F.xxhash64("grp", "turn"), F.lit(width)).cast("int")
        turns = turns.select("cid", "n", "turn", F.xxhash64("grp", "turn", _token(F.col("sig"), at)).alias("bucket"))
        sizes = turns.groupBy("bucket").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("total")).where("many > 1")
        keys = turns.join(sizes, "bucket").select("cid", F.xxhash64("bucket", F.pmod(F.xxhash64("cid", "turn"), pieces("many", "total"))).alias("key"))
        met = dealt(scratch.save(keys, f"large-buckets-{turn}").join(sets, "cid").select("key", "cid", "shingles"))
        found = scratch.save(met.mapInArrow(within, "cid binary, root binary"), f"large-stars-{turn}")
        stars = found if stars is None else stars.union(found)
        labels = components(stars.select(F.col("cid").alias("a"), F.col("root").alias("b")), scratch, f"large-{turn}")
        placed = ids.join(labels, ids.cid == labels.node, "left").select("grp", "pieces", "cid", "n", F.coalesce("root", "cid").alias("root"))
        placed = scratch.save(placed, f"large-placed-{turn}")
        largest = placed.groupBy("grp", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
        outside = scratch.save(placed.join(largest, "grp").where("root <> main").drop("main"), f"large-outside-{turn}")
        left = outside.count()
        if left <= limit or (apart is not None and left > 0.8 * apart):
            break
        apart, turn = left, turn + rounds
    blocks = outside.groupBy("grp").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("total")).select("grp", pieces("many", "total").alias("blocks"))

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def part(n: str, seed: int) -> Column:
        return F.pmod(F.xxhash64("cid", F.lit(seed)), F.col(n))

    one = outside.join(blocks, "grp").select("grp", "cid", "root", F.lit(0).alias("side"), part("blocks", 5).alias("block"), each("pieces").alias("piece"))
    all_ = placed.join(blocks, "grp").select("grp", "cid", "root", F.lit(1).alias("side"), each("blocks").alias("block"), part("pieces", 6).alias("piece"))
    keyed = scratch.save(one.union(all_).select("cid", "root", "side", F.xxhash64("grp", "block", "piece").alias("key")), "large-blocks")
    held = dealt(keyed.join(sets, "cid").select("key", "side", "root", "shingles"))
    more = scratch.save(held.mapInArrow(across, "a binary, b binary"), "large-more")
    if more.isEmpty():
        return placed.select("cid", "root")
    merged = components(more, scratch, "merged").withColumnRenamed("root", "top")
    return placed.join(merged, placed.root == merged.node, "left").select("cid", F.coalesce("top", "root").alias("root"))


def _token(sig: Column, at: Column) -> Column:
    """The MinHash token at a position of a signature, as its four bytes."""
    return F.substring(sig, at * 4 + 1, F.lit(4))


def _picked(node: Column, width: int) -> Column:
    """The positions at which a node branches: one, and a second one in a quarter of the nodes."""
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(width)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64(node, F.lit(2)), F.lit(width - 1)).cast("int"), F.lit(width)).cast("int")
    return F.when(F.pmod(F.xxhash64(node, F.lit(3)), F.lit(4)) == 0, F.array(first, second)).otherwise(F.array(first))


def _branched(rows: DataFrame, width: int) -> DataFrame:
    """(node, cid, sig) to (node, cid) one level deeper."""
    at = rows.select("cid", "node", "sig", F.explode(_picked(F.col("node"), width)).alias("at"))
    return at.select(F.xxhash64("node", "at", _token(F.col("sig"), F.col("at"))).alias("node"), "cid")


def components(links: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(a, b) to (node, root): every node of a link with one common root for each component.

    Each round points every node at its least neighbour, follows that pointer once more, and rewrites
    the links between the nodes so reached. Odd rounds order nodes by their key, which folds stars
    and short paths at once; even rounds by a fresh hash, which shortens long chains by a constant
    factor whatever their order. Only whether links remain reaches the driver. The pointers of the
    rounds are written, and put together at the end.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    labels = nodes.select("node", F.col("node").alias("root"))
    links = scratch.save(links.where(F.col("a") != F.col("b")).distinct(), f"{label}-links-0")
    i = 0
    while not links.isEmpty():
        i += 1

        def order(c: str, i: int = i) -> Column:
            first = F.lit(0).cast("long") if i % 2 else F.xxhash64(F.col(c), F.lit(i))
            return F.struct(first.alias("rank"), F.col(c).alias("key"))

        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy(F.col("a").alias("child")).agg(F.min(order("b")).alias("best"))
        one = best.select("child", F.least(order("child"), F.col("best"))["key"].alias("up"))
        two = one.select(F.col("child").alias("up"), F.col("up").alias("parent"))
        parent = scratch.save(one.join(two, "up").select("child", "parent"), f"{label}-parent-{i}")
        links = scratch.save(
            links.join(parent.select(F.col("child").alias("a"), F.col("parent").alias("pa")), "a")
            .join(parent.select(F.col("child").alias("b"), F.col("parent").alias("pb")), "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(),
            f"{label}-links-{i}",
        )
        labels = labels.join(parent, labels.root == parent.child, "left").select("node", F.coalesce("parent", "root").alias("root"))
        if i % 6 == 0:
            labels = scratch.save(labels, f"{label}-labels-{i}")
    return scratch.save(labels, f"{label}-labels")


def _stars(width: int, cut: float):
    """Rows (key, cid, sig) sorted by key to (a, b): each class that agrees with another one in ``cut`` of the
    positions, or is reached over such classes, with the least class so reached."""

    def compare(rows: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
        rows.sort()
        g = np.frombuffer(b"".join(x for _, x in rows), np.int32).reshape(-1, width)
        out, waiting = [], np.arange(len(rows))
        while len(waiting) > 1:  # breadth first: each class is compared once with those not reached yet
            queue, waiting = [int(waiting[0])], waiting[1:]
            first = rows[queue[0]][0]
            while queue and len(waiting):
                near = (g[waiting] == g[queue.pop()]).sum(axis=1) >= cut * width
                queue += waiting[near].tolist()
                out += [(rows[x][0], first) for x in waiting[near]]
                waiting = waiting[~near]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _paired(map(compare, _runs(batches, "cid", "sig")), ("a", "b"))

    return run


def _candidates(signatures: DataFrame, scratch: Scratch, near: float, trees: int, width: int, leaf: int, depth: int) -> DataFrame:
    """(a, b): pairs of (cid, sig) rows whose closure holds every pair that is likely to be similar."""
    cut = near - 0.2  # four standard deviations of 64 tokens below the link threshold
    roots = F.explode(F.array(*[F.xxhash64(F.lit("root"), F.lit(t)) for t in range(trees)]))
    members = _branched(signatures.select("cid", "sig", roots.alias("node")), width)
    found = []
    for level in range(1, depth + 1):
        size = members.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("pivot")).where("n > 1")
        here = scratch.save(members.join(size, "node"), f"nodes-{level}")
        few = dealt(here.where(F.col("n") <= leaf).join(signatures, "cid").select(F.col("node").alias("key"), "cid", "sig"))
        found.append(scratch.save(few.mapInArrow(_stars(width, cut), "a binary, b binary").distinct(), f"small-{level}"))
        many = here.where(F.col("n") > leaf)
        if many.isEmpty():
            break
        if level == depth:
            found.append(scratch.save(many.where("cid <> pivot").select(F.col("cid").alias("a"), F.col("pivot").alias("b")).distinct(), "unsplit"))
        else:
            members = _branched(many.select("node", "cid").join(signatures, "cid"), width)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def minhash_components(
    docs: DataFrame,
    scratch: Scratch,
    k: int = 5,
    percent: int = 80,
    trees: int = 8,
    width: int = 64,
    leaf: int = 2000,
    depth: int = 3,
    group_limit: int = 4000,
    group_shingles: int = 4_000_000,
    rounds: int = 3,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of distinct
    k-word shingles; component_id is the least doc_id reachable over links.
    """
    near = percent / 100
    rows = scratch.save(
        docs.select("doc_id", "text").mapInArrow(_sketcher(k, width), "doc_id long, n_shingles long, cid binary, sig binary"),
        "rows",
    )
    classes = scratch.save(
        rows.where("cid is not null and doc_id is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.max("n_shingles").alias("n")),
        "classes",
    )
    candidates = _candidates(classes.select("cid", "sig"), scratch, near, trees, width, leaf, depth)
    groups = components(candidates, scratch, "groups")
    wanted = groups.select(F.col("root").alias("grp"), F.col("node").alias("cid")).join(classes.select("cid", "sig", "n", F.col("rep").alias("doc_id")), "cid")
    pieces = F.ceil(F.greatest(F.count(F.lit(1)) / group_limit, F.sum("n") / group_shingles)).cast("long")
    wanted = scratch.save(wanted.join(wanted.groupBy("grp").agg(pieces.alias("pieces")), "grp"), "wanted")
    sets = docs.select("doc_id", "text").join(wanted, "doc_id").select("grp", "pieces", "cid", "sig", "n", "text")
    sets = scratch.save(sets.mapInArrow(_setter(k), "grp binary, pieces long, cid binary, sig binary, n long, shingles binary"), "sets")
    within = search_within(lambda found: exact_roots(found, percent))
    small = dealt(sets.where("pieces = 1").select(F.xxhash64("grp").alias("key"), "cid", "shingles"))
    labels = scratch.save(small.mapInArrow(within, "cid binary, root binary"), "labels-small")
    large = sets.where("pieces > 1")
    if not large.isEmpty():
        labels = labels.union(bucketed_search(large, scratch, within, search_across(marked_block(percent)), width, group_limit, group_shingles, rounds))
    named = classes.select("cid", "rep").join(labels, "cid", "left")
    least = named.where("root is not null").groupBy("root").agg(F.min("rep").alias("least"))
    named = scratch.save(named.join(least, "root", "left").select("cid", F.coalesce("least", "rep").alias("component_id")), "named")
    scratch.keep_only("rows", "named")
    out = rows.select("doc_id", "n_shingles", "cid").join(named, "cid", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_one(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the least doc_id.

    Rows that repeat a doc_id and its text are one document, and stay once.
    """
    out = scratch.save(minhash_components(docs, scratch, **options).select("doc_id", "kept"), "verdicts")
    scratch.keep_only("verdicts")
    ids = out.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    ids = scratch.save(ids.where("not kept or n > 1"), "not-once")
    left = docs.join(ids.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    again = ids.where("kept").select("doc_id")
    if again.isEmpty():
        return left
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).union(
        left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    )
