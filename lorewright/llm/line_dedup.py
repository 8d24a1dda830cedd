r"""Removal of lines that recur across many documents.

A text is split at \n. The key of a line is the line without ASCII white space at its ends and with
A-Z lower-cased. Keys found in at least ``min_docs`` documents lose all their lines everywhere.

Each document contributes every key once, as a 128-bit digest, so counting a digest's rows counts
its documents and the shuffle combines on the map side. The common digests are written. Up to
``broadcast_keys`` of them (16 bytes each) go to every task as one sorted table, and lines are looked
up and put together again by position where the text is read: no text is shuffled. More of them are
joined by shuffle: the positions to drop come back as one short array for each text, keyed by the
text's digest. Both ways give the same rows.

Rows: one for each input row, which counts as one document; repeated rows and null or repeated
doc_ids are no special case, an empty table gives none. A null or empty text is one empty line, which
has no key and stays. Keys shorter than ``min_chars`` code points are never dropped; a key in exactly
``min_docs`` documents is. Very long texts are split as any. Columns other than ``text`` pass through
``drop_common_lines`` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .text_native import SPACES, ascii_lower


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def common_keys(docs: DataFrame, scratch: Scratch, min_docs: int, min_chars: int) -> DataFrame:
    """key: the digests of the keys that stand in ``min_docs`` documents or more."""
    in_document = docs.select(F.explode_outer(F.array_distinct(F.transform(_lines(F.col("text")), line_key))).alias("key"))
    common = (
        in_document.where(F.char_length("key") >= max(1, min_chars))
        .groupBy(F.unhex(F.md5("key")).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_docs)
        .select("key")
    )
    return scratch.save(common, "common")


def _looked_up(held):
    """Rows (row, text) to (row, n_lines, n_dropped, text) by the digests of ``held``, in one sorted string of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, spaces = held.value, SPACES.encode()
        known = frozenset(keys[i : i + 16] for i in range(0, len(keys), 16))
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                lines = (text or b"").split(b"\n")
                stay = [x for x in lines if not (key := x.strip(spaces).lower()) or hashlib.md5(key).digest() not in known]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            arrays = [batch.column("row"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "n_lines", "n_dropped", "text"])

    return run


def _joined(docs: DataFrame, common: DataFrame, scratch: Scratch, min_chars: int) -> DataFrame:
    """The same for any number of common keys."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    keyed = docs.select(digest.alias("digest"), F.posexplode_outer(F.transform(_lines(F.col("text")), line_key)).alias("pos", "key"))
    keyed = keyed.where(F.char_length("key") >= max(1, min_chars)).select("digest", "pos", F.unhex(F.md5("key")).alias("key"))
    hits = keyed.join(common, "key", "left_semi").select("digest", "pos").distinct()
    positions = scratch.save(hits.groupBy("digest").agg(F.collect_list("pos").alias("drop")), "positions")
    rows = docs.select(F.struct("*").alias("row"), digest.alias("digest"))
    joined = rows.join(positions, "digest", "left").select("row", "drop", _lines(F.col("row.text")).alias("lines"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = joined.select("row", "lines", F.when(F.col("drop").isNull(), every).otherwise(F.array_except(every, "drop")).alias("kept"))
    text = F.when(F.size("kept") == F.size("lines"), F.coalesce("row.text", F.lit(""))).otherwise(
        F.array_join(F.transform("kept", lambda i: F.get(F.col("lines"), i)), "\n")
    )
    n_lines = F.size("lines").cast("long")
    return kept.select("row", n_lines.alias("n_lines"), (n_lines - F.size("kept")).alias("n_dropped"), text.alias("text"))


def drop_common_lines(docs: DataFrame, scratch: Scratch, min_docs: int = 10, min_chars: int = 1, broadcast_keys: int = 1_000_000) -> DataFrame:
    """Every row of ``docs`` as the struct ``row``, with n_lines, n_dropped and ``text`` (the lines that stay)."""
    common = common_keys(docs.select("text"), scratch, min_docs, min_chars)
    n = common.count()
    if n > broadcast_keys:
        return _joined(docs, common, scratch, min_chars)
    keys = bytearray()
    for r in common.sort("key").toLocalIterator():  # broadcast_keys of 16 bytes at most
        keys += r.key
    rows = docs.select(F.struct("*").alias("row"), "text")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, n_lines long, n_dropped long, text string"
    return rows.mapInArrow(_looked_up(docs.sparkSession.sparkContext.broadcast(bytes(keys))), schema)


def clean_rows(docs: DataFrame, scratch: Scratch, min_docs: int = 10, min_chars: int = 1, **options) -> DataFrame:
    """``docs`` with the texts that remain; ``n_chars``, where it is a column, counts them anew."""
    done = drop_common_lines(docs, scratch, min_docs, min_chars, **options)
    new = F.when(F.col("row.text").isNotNull(), F.col("text"))
    kind = dict(docs.dtypes)
    fresh = {"text": new, **({"n_chars": F.char_length(new).cast(kind["n_chars"])} if "n_chars" in kind else {})}
    return done.select(*[fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, scratch: Scratch, min_docs: int = 10, min_chars: int = 1, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of what stays."""
    done = drop_common_lines(docs.select("doc_id", "text"), scratch, min_docs, min_chars, **options)
    return done.select(
        "row.doc_id",
        "n_lines",
        "n_dropped",
        F.sha2("text", 256).alias("kept_sha256"),
    )


#: The same in DuckDB.
LINE_SQL = r"""
with d as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
k as (select rid, doc_id, generate_subscripts(lines, 1) as pos, unnest(lines) as line from d),
n as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from k),
c as (select key from n where length(key) >= 1 group by key having count(distinct rid) >= 10)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(c.key) as n_dropped,
       sha256(coalesce(string_agg(case when c.key is null then line end, chr(10) order by pos), '')) as kept_sha256
from n left join c on n.key = c.key group by rid
"""
