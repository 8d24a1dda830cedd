r"""Benchmark passages inside documents, by size-partitioned MinHash containment search.

The shingles of a text are its distinct windows of five words (A-Z lower-cased); a benchmark item
with fewer words is one shingle of all its words. A document contains an item if at least 80 % of
the item's shingles occur in it. Jaccard similarity says nothing here, as items are short and
documents long, so the search is asymmetric:

* Items are partitioned by size. In a partition, the least ``m`` MinHash values of each item index
  it, with ``m`` from the partition's upper size: as many as can be absent from a document that
  contains 80 % of the item, and one more. No match can be missed. ``probes`` can bound ``m``, which
  makes the index of long items smaller, at a chance to miss one below 0.2 ** probes; the default is
  not to.
* Shingles of documents look those values up. Documents smaller than 80 % of an item are no
  candidates for it.
* Candidates alone are read again and verified by exact shingle containment: the shingles that each
  pair asks for are joined to the text's own, by text and shingle, so no passage is a hot key.

DataFrame functions only. The index is written first, so the planner knows its size and broadcasts
it only below its own limit; otherwise both sides are shuffled by shingle. Texts are keyed by their
digest, so equal texts are verified once.

Rows: one for each document and each item that it contains, so none for an empty table. Null or
repeated doc_ids are no special case, repeated rows give repeated results. Null and empty texts
contain nothing, a null item_id or an item without words is contained nowhere. Rows that repeat an
item_id are one item, with the shingles of all. A share of exactly 80 % counts. Texts of any length
are read whole. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .text_native import ascii_lower, window_hashes, words


def _shingles(tokens: Column, size: int, shorter: list[int]) -> Column:
    """Distinct hashes of windows of ``size`` words, and of the sizes in ``shorter``."""
    out = window_hashes(tokens, size)
    for k in shorter:
        out = F.concat(out, window_hashes(tokens, k))
    return F.array_distinct(out)


def _by_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.unhex(F.md5("text")).alias("key"), words(ascii_lower(F.col("text"))).alias("_words"))


def contained_items(docs: DataFrame, items: DataFrame, scratch: Scratch, size: int = 5, percent: int = 80, probes: int | None = None) -> DataFrame:
    """key, item_id, n_item, n_shared: the items that each distinct text contains; key is the text's MD5."""
    short = 1 - percent / 100
    item = items.where("item_id is not null and text is not null").select("item_id", words(ascii_lower(F.col("text"))).alias("_words"))
    k = F.least(F.size("_words"), F.lit(size))
    item = scratch.save(item.where(F.size("_words") > 0).select("item_id", "_words", k.alias("k")), "items")
    shorter = sorted(r.k for r in item.where(F.col("k") < size).select("k").distinct().collect())  # at most size - 1 numbers
    hashed = F.when(F.col("k") == size, F.array_distinct(window_hashes(F.col("_words"), size)))
    for j in shorter:
        hashed = hashed.when(F.col("k") == j, window_hashes(F.col("_words"), j))
    shingled = item.select("item_id", F.explode(hashed).alias("h")).groupBy("item_id").agg(F.array_sort(F.collect_set("h")).alias("s"))
    least = F.ceil(F.size("s") * F.lit(percent) / 100).cast("int")
    item = scratch.save(shingled.select("item_id", "s", F.size("s").alias("n_item"), least.alias("least")), "item-shingles")
    partition = F.floor(F.log2("n_item"))
    m = F.floor(F.pow(F.lit(2.0), partition + 1) * F.lit(short) + 1e-9) + 1
    m = (m if probes is None else F.least(F.lit(probes), m)).cast("int")
    order = F.array_sort(F.transform("s", lambda h: F.struct(F.xxhash64(h, F.lit(17)).alias("rank"), h.alias("h"))))
    index = scratch.save(
        item.select("item_id", "least", F.explode(F.slice(order, F.lit(1), F.least(m, F.col("n_item")))).alias("e")).select(
            "item_id", "least", F.col("e.h").alias("h")
        ),
        "index",
    )
    texts = docs.where("text is not null")
    # explode_outer: an inner explode is also planned as a filter below, which would compute the shingles once more for each word.
    probed = _by_text(texts).select("key", _shingles(F.col("_words"), size, shorter).alias("s"))
    found = probed.select("key", F.size("s").alias("n"), F.explode_outer("s").alias("h")).join(index, "h").where("n >= least")
    candidates = scratch.save(found.select("key", "item_id").distinct(), "candidates")
    again = texts.select(F.unhex(F.md5("text")).alias("key"), "text").join(candidates.select("key").distinct(), "key", "left_semi")
    again = again.groupBy("key").agg(F.first("text").alias("text")).select("key", words(ascii_lower(F.col("text"))).alias("_words"))
    own = again.select("key", _shingles(F.col("_words"), size, shorter).alias("s")).select("key", F.explode_outer("s").alias("h"))
    asked = candidates.join(item, "item_id").select("key", "item_id", "n_item", "least", F.explode("s").alias("h"))
    counted = asked.join(own, ["key", "h"]).groupBy("key", "item_id", "n_item", "least").agg(F.count(F.lit(1)).alias("n_shared"))
    exact = counted.where("n_shared >= least")
    contained = scratch.save(exact.select("key", "item_id", F.col("n_item").cast("long").alias("n_item"), "n_shared"), "contained")
    scratch.keep_only("contained")
    return contained


def leaks(docs: DataFrame, items: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """doc_id, item_id, n_item, n_shared for every document and each item that it contains."""
    found = contained_items(docs, items, scratch, **options)
    return docs.select("doc_id", F.unhex(F.md5("text")).alias("key")).join(found, "key").select("doc_id", "item_id", "n_item", "n_shared")


def clean(docs: DataFrame, items: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns."""
    bad = scratch.save(contained_items(docs, items, scratch, **options).select("key").distinct(), "bad")
    rows = docs.select(F.struct("*").alias("row"), F.unhex(F.md5("text")).alias("key"))
    return rows.join(bad, "key", "left_anti").select("row.*")


#: The same by brute force in DuckDB.
LEAK_SQL = r"""
with w as (select 'd' as t, doc_id as id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents
           union all select 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
v as (select t, id, list_filter(string_split_regex(x, '[ \t\n\x0B\f\r]+'), lambda y: y <> '') as ws from w),
s as (select distinct t, id, list_aggregate(list_slice(ws, i, i + 4), 'string_agg', ' ') as g
      from (select t, id, ws, unnest(generate_series(1, greatest(len(ws) - 4, case when len(ws) > 0 then 1 else 0 end))) as i from v)),
n as (select id, count(*) as n_item from s where t = 'b' group by 1),
m as (select d.id as doc_id, b.id as item_id, count(*) as n_shared from s d join s b on d.g = b.g where d.t = 'd' and b.t = 'b' group by 1, 2)
select doc_id, item_id, n_item, n_shared from m join n on n.id = m.item_id where 100 * n_shared >= 80 * n_item
"""
