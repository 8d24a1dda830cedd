"""A trie of conversation prefixes, where every conversation owns a suffix of its path.

A node is a distinct sequence of first turns. Its smallest member owns it. A conversation that owns a
node owns all deeper nodes of its path as well, since they have fewer members and it is one of them:
what it owns is a suffix of its path. So all that a subtree holds follows from sums over members:

* each node's text is counted once less than it occurs, so a subtree saves what its members' turns
  hold from the top on, minus what their owners own: for each member the code points between the top
  and the first node it owns;
* a node has as many children as members that own a node right below it;
* a subtree has as many leaves as members that own a childless node.

1. Turns are numbered, and cumulative sums of two hashes of (depth, turn) name every prefix. Windows go
   over blocks of ``block`` turns, with the sums of earlier blocks added, so one very long conversation
   is spread over tasks. No text is shuffled, only a digest and a length of every turn.
2. A group-by finds the smallest member of every node; it is combined before the shuffle, where a window
   over a first turn that very many share would not be. Rows are joined with it, which marks what is
   owned, and a group-by on conversations finds where each suffix begins.
3. One group-by on nodes sums members' occurrences minus owned code points, leaf flags and child flags.
4. Ids of conversations that end in a node are joined to texts of ``ids`` consecutive ids and hashed as
   a stream in order, so the ids of one node are never held together.

Rows: one for each node; the root is a node as soon as there is a conversation. An empty table gives
none. Rows without conv_id belong to no conversation and are left out. Null turns come first; rows of
one turn number are ordered by a digest of role and text, repeated rows are turns of their own. A null
role or text is an empty one; a text of any length counts whole. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO = (Window.unboundedPreceding, Window.currentRow)


def numbered_turns(conversations: DataFrame, block: int = 1024) -> DataFrame:
    """conv_id, pos from 1, digest and chars of every turn, ordered by turn (null first)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    part = F.when(F.col("turn").isNull(), F.lit(-(2**62))).otherwise(F.floor(F.col("turn") / block).cast("long"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", part.alias("part"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars")
    )
    within = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest")
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(*_BEFORE))
    sizes = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "part", earlier.alias("earlier")).where("earlier > 0")
    placed = rows.withColumn("here", F.row_number().over(within)).join(sizes, ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("here") + F.coalesce("earlier", F.lit(0))).cast("long").alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame, scratch: Scratch, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that open as the first one of their family does, from numbered ``turns``.

    Conversation c begins with the first h turns of conversation c - c % family, h being the CRC-32 of c
    modulo ``most``, and goes on with its own turns after its first h. Returns (conv_id, length) and
    (conv_id, depth, digest, chars).
    """
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    opening = turns.where((F.col("pos") < most) & (F.col("conv_id") % family == 0)).groupBy(F.col("conv_id").alias("first"))
    opening = opening.agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("opening"))  # fewer than ``most`` turns
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    heads = lengths.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("first")).join(opening, "first", "left")
    taken = F.coalesce(F.slice("opening", F.lit(1), F.col("h")), F.array().cast(opening.schema["opening"].dataType))
    heads = scratch.save(heads.select("conv_id", "n", "h", taken.alias("taken")), "heads")
    convs = heads.select("conv_id", (F.size("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    given = heads.select("conv_id", F.explode("taken").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.digest", "t.chars")
    own = turns.join(heads.select("conv_id", "h", F.size("taken").alias("taken")), "conv_id").where("pos > h")
    return convs, given.union(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "digest", "chars"))


def _running(turns: DataFrame, block: int, **sums: Column) -> DataFrame:
    """``turns`` with cumulative sums along every conversation, from its first turn on."""
    rows = turns.select("conv_id", "depth", "chars", F.floor((F.col("depth") - 1) / block).alias("part"), *[v.alias(k) for k, v in sums.items()])
    many = rows.where(F.col("depth") > block).select("conv_id").distinct()
    totals = rows.join(many, "conv_id", "left_semi").groupBy("conv_id", "part").agg(*[F.sum(k).alias(k) for k in sums])
    along = Window.partitionBy("conv_id").orderBy("part").rowsBetween(*_BEFORE)
    earlier = totals.select("conv_id", "part", *[F.sum(k).over(along).alias(f"{k}_earlier") for k in sums])
    here = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(*_UP_TO)
    within = rows.select("conv_id", "part", "depth", "chars", *[F.sum(k).over(here).alias(k) for k in sums])
    joined = within.join(earlier, ["conv_id", "part"], "left")
    return joined.select("conv_id", "depth", "chars", *[(F.col(k) + F.coalesce(F.col(f"{k}_earlier"), F.lit(0))).alias(k) for k in sums])


def _digest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, ids) sorted by node and place to the digest of each node's ids, joined by commas."""
    node, state, done = None, None, []
    for batch in batches:
        for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key == node:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                done.append((node, state.hexdigest()))
            node, state = key, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["node", "ends_sha256"])
        done = []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "ends_sha256"])


def _ends(rows: DataFrame, ids: int) -> DataFrame:
    """node and ends_sha256 of rows (node, conv_id), each a conversation that ends there."""
    place = F.floor(F.col("conv_id") / ids).alias("place")
    parts = rows.groupBy("node", place).agg(F.sort_array(F.collect_list("conv_id")).alias("some"))  # ``ids`` of them at most
    texts = parts.select("node", "place", F.array_join(F.transform("some", lambda x: x.cast("string")), ",").alias("ids"))
    return texts.repartition("node").sortWithinPartitions("node", "place").select("node", "ids").mapInArrow(_digest_runs, "node binary, ends_sha256 string")


def trie_of(convs: DataFrame, turns: DataFrame, scratch: Scratch, block: int = 1024, ids: int = 256) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, length) with turns (conv_id, depth, digest, chars)."""
    root = F.unhex(F.md5(F.lit("")))

    def part(seed: int) -> Column:
        return F.xxhash64(F.lit(seed), "depth", "digest").cast("decimal(20,0)")

    paths = _running(scratch.save(turns, "turns"), block, one=part(1), two=part(2), upto=F.col("chars"))
    node = F.unhex(F.md5(F.concat_ws(",", "depth", "one", "two"))).alias("node")
    convs = scratch.save(convs, "convs")
    paths = paths.join(convs, "conv_id").select("conv_id", "depth", "chars", "upto", node, (F.col("depth") == F.col("length")).alias("last"))
    paths = scratch.save(paths, "paths")
    owners = paths.groupBy("node").agg(F.min("conv_id").alias("owner"), F.min("last").alias("childless"))
    marked = scratch.save(paths.join(owners, "node"), "marked")
    owned = F.col("conv_id") == F.col("owner")
    suffixes = marked.groupBy("conv_id").agg(
        F.max(F.when(~owned, F.struct("depth", "owner", "upto"))).alias("above"),
        F.max(owned).alias("owns"),
        F.max(owned & F.col("childless")).cast("long").alias("leaf"),
    )
    least = convs.agg(F.min("conv_id").alias("least")).first()["least"]
    above = (
        F.coalesce("above.depth", F.lit(0)).alias("above_depth"),
        F.coalesce("above.owner", F.lit(least).cast("long")).alias("above_owner"),
        F.coalesce("above.upto", F.lit(0)).alias("above_upto"),
    )
    suffixes = scratch.save(suffixes.select("conv_id", "owns", "leaf", *above), "suffixes")
    child = (F.col("owns") & (F.col("depth") >= F.col("above_depth")) & ~F.col("last")).cast("long").alias("child")
    saved = F.greatest(F.col("above_upto") - (F.col("upto") - F.col("chars")), F.lit(0)).alias("saved")
    parent = F.when(owned, F.when(F.col("depth") - 1 == F.col("above_depth"), F.col("above_owner")).otherwise(F.col("conv_id"))).alias("parent")
    below = marked.join(suffixes, "conv_id").select("node", "depth", "conv_id", child, "leaf", saved, parent)
    top = convs.join(suffixes, "conv_id", "left").select(
        root.alias("node"),
        F.lit(0).cast("long").alias("depth"),
        "conv_id",
        F.coalesce(F.col("owns") & (F.col("above_depth") == 0), F.lit(False)).cast("long").alias("child"),
        F.coalesce("leaf", F.lit(0)).alias("leaf"),
        F.coalesce("above_upto", F.lit(0)).alias("saved"),
        F.lit(None).cast("long").alias("parent"),
    )
    nodes = below.union(top).groupBy("node", "depth").agg(
        F.min("conv_id").alias("conv_id"),
        F.max("parent").alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum("child").alias("n_children"),
        F.sum("leaf").alias("leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    ending = paths.where("last").select("node", "conv_id").union(convs.where("length = 0").select(root.alias("node"), "conv_id"))
    done = nodes.join(_ends(ending, ids), "node", "left")
    return done.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, scratch: Scratch, family: int = 100, most: int = 6, block: int = 1024, ids: int = 256) -> DataFrame:
    """The trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256 of every node."""
    convs, turns = rebuilt(scratch.save(numbered_turns(conversations, block), "numbered"), scratch, family, most)
    out = scratch.save(trie_of(convs, turns, scratch, block, ids), "nodes")
    scratch.keep_only("nodes")
    return out


#: The same in DuckDB, with a subtree as the pairs of nodes that stand on one path.
TRIE_SQL = """
with c as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first,
        md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as pos from conversations where conv_id is not null),
i as (select distinct conv_id from c),
ids as (select conv_id, conv_id - conv_id % 100 as first, xor(list_reduce(
        list_concat([4294967295::ubigint], flatten([[ascii(x), 0, 0, 0, 0, 0, 0, 0] for x in string_split(conv_id::varchar, '')])),
        lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295) % 6 as h from i),
r as (select ids.conv_id, 0 as part, pos, role, text from ids join c on c.conv_id = ids.first and pos <= h
      union all select conv_id, 1, pos, role, text from c join ids using (conv_id) where pos > h),
t as (select conv_id, length(text) as chars, md5(length(role)::varchar || ':' || role || text) as turn, row_number() over (partition by conv_id order by part, pos) as depth from r),
p as (select conv_id, depth, chars, array_to_string(list(turn) over (partition by conv_id order by depth), ',') as node from t
      union all select conv_id, 0, 0, '' from i),
m as (select *, lag(node) over (partition by conv_id order by depth) as parent, depth = max(depth) over (partition by conv_id) as last from p),
n as (select node, any_value(depth) as depth, any_value(parent) as parent, any_value(chars) as chars, min(conv_id) as conv_id, count(*) as n_convs,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (last), '')) as ends_sha256 from m group by node),
k as (select parent as node, count(*) as n_children from n where depth > 0 group by parent),
s as (select distinct a.node as top, b.node from m a join m b on a.conv_id = b.conv_id and b.depth >= a.depth),
u as (select top, sum((n_convs - 1) * chars)::bigint as saved_tokens, count(*) filter (n_children is null) as n_leaves
      from s join n using (node) left join k using (node) group by top)
select n.conv_id, n.depth::bigint as depth, q.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, u.n_leaves, u.saved_tokens, n.ends_sha256
from n left join k on k.node = n.node join u on u.top = n.node left join n q on q.node = n.parent and n.depth > 0
"""
