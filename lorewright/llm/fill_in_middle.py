r"""Fill-in-middle training text, cut and rearranged by DuckDB inside ``mapInArrow``.

A text is cut into tokens: a word with the white space before it, or white space at the end. A digest
of ``seed:doc_id`` gives four numbers: two choose where the prefix and the middle end, two the form.
Each Arrow batch is registered with one DuckDB connection of its task, which cuts, rearranges, puts the
text together again from what it made, and hashes, in one SQL statement; no row is touched in Python.
There is no shuffle. A batch goes to DuckDB in slices of ``slice_bytes`` of text (a longer text alone),
so memory hangs on the longest text and not on the number of rows in a batch.

Rows: one for each input row, none for an empty table. A null or empty text is plain and has no tokens.
A text that contains one of the three marks stays plain, since it could not be put together again. A
null doc_id is hashed as an empty one. Repeated rows are cut alike, and rows of one doc_id with other
texts by the same numbers. Both cuts may fall together: any of the three parts may be empty. Columns
other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Statement over ``batch`` (doc_id, text); the parameters stand in braces.
_SQL = r"""
with cut as (
  select doc_id, coalesce(text, '') as text, sha256('{seed}:' || coalesce(doc_id::varchar, '')) as digest,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tokens
  from batch
), drawn as (
  select doc_id, text, tokens, len(tokens) as n,
    ('0x' || digest[1:8])::ubigint % (len(tokens) + 1) as one, ('0x' || digest[9:16])::ubigint % (len(tokens) + 1) as other,
    case when text = '' or contains(text, '{P}') or contains(text, '{S}') or contains(text, '{M}')
              or ('0x' || digest[17:24])::ubigint % 100 >= {rate} then 'plain'
         when ('0x' || digest[25:32])::ubigint % 100 < {spm} then 'spm' else 'psm' end as form
  from cut
), parts as (
  select doc_id, text, n, form,
    case when form <> 'plain' then array_to_string(list_slice(tokens, 1, least(one, other)::bigint), '') end as prefix,
    case when form <> 'plain' then array_to_string(list_slice(tokens, least(one, other)::bigint + 1, greatest(one, other)::bigint), '') end as middle,
    case when form <> 'plain' then array_to_string(list_slice(tokens, greatest(one, other)::bigint + 1, n), '') end as suffix
  from drawn
), made as (
  select doc_id, n, form, length(prefix) as prefix_chars, length(middle) as middle_chars,
    case form when 'plain' then text when 'psm' then '{P}' || prefix || '{S}' || suffix || '{M}' || middle
              else '{S}' || suffix || '{P}' || prefix || '{M}' || middle end as output
  from parts
), taken as (
  select *, split_part(output, '{M}', 1) as head, split_part(output, '{M}', 2) as last from made
), again as (
  select *, case form when 'plain' then output
    when 'psm' then substr(split_part(head, '{S}', 1), length('{P}') + 1) || last || split_part(head, '{S}', 2)
    else split_part(head, '{P}', 2) || last || substr(split_part(head, '{P}', 1), length('{S}') + 1) end as restored
  from taken
)
select doc_id, n::bigint as n, form, prefix_chars::bigint as prefix_chars, middle_chars::bigint as middle_chars, {outputs} from again
"""

#: What to return of a text: the text itself, or only digests of it and of what is put together from it.
_TEXTS = "output, restored"
_DIGESTS = "sha256(output) as output_sha256, sha256(restored) as restored_sha256"


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with ``most`` bytes of text; a longer text makes a run of its own."""
    start, held = 0, 0
    for i, size in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        if i > start and held + (size or 0) > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def _runner(sql: str, schema: pa.Schema, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as db:
            for batch in batches:
                for part in _slices(batch, slice_bytes):
                    db.register("batch", pa.Table.from_batches([part]))
                    yield from db.sql(sql).to_arrow_table().cast(schema).to_batches()
                    db.unregister("batch")

    return run


def fill_in_middle(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, digests: bool = False, slice_bytes: int = 4_000_000
) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, and what was made of every text.

    ``rate`` percent of the texts are rearranged, ``spm`` percent of those with the suffix first. The
    result ends with ``output`` and ``restored`` (the text rebuilt from ``output`` and ``form``), or with
    the SHA-256 of both where ``digests`` is set.
    """
    last = ("output_sha256", "restored_sha256") if digests else ("output", "restored")
    sql = _SQL.format(seed=int(seed), rate=int(rate), spm=int(spm), P=PREFIX, S=SUFFIX, M=MIDDLE, outputs=_DIGESTS if digests else _TEXTS)
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
    schema = pa.schema(fields + [(x, pa.string()) for x in last])
    columns = f"doc_id long, n long, form string, prefix_chars long, middle_chars long, {last[0]} string, {last[1]} string"
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    return rows.mapInArrow(_runner(sql, schema, slice_bytes), columns)


#: The same without lists: the cuts are found as lengths of text, and restoring is the identity.
FIM_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as digest from documents),
t as (select *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tokens from d),
h as (select doc_id, text, tokens, len(tokens) as n,
    [('0x' || substr(digest, 1 + 8 * i, 8))::ubigint for i in [0, 1, 2, 3]] as h from t),
c as (select *, list_sort([h[1] % (n + 1), h[2] % (n + 1)]) as ends,
    case when regexp_matches(text, '<[PSM]>') or text = '' or h[3] % 100 >= 50 then 'plain' when h[4] % 100 < 80 then 'spm' else 'psm' end as form from h),
l as (select doc_id, text, n, form, coalesce(list_sum([length(x) for x in tokens[:ends[1]::bigint]]), 0)::bigint as p,
    coalesce(list_sum([length(x) for x in tokens[ends[1]::bigint + 1:ends[2]::bigint]]), 0)::bigint as m from c)
select doc_id, n, form, case when form <> 'plain' then p end as prefix_chars, case when form <> 'plain' then m end as middle_chars,
    sha256(case form when 'plain' then text
      when 'psm' then '<P>' || substr(text, 1, p) || '<S>' || substr(text, p + m + 1) || '<M>' || substr(text, p + 1, m)
      else '<S>' || substr(text, p + m + 1) || '<P>' || substr(text, 1, p) || '<M>' || substr(text, p + 1, m) end) as output_sha256,
    sha256(text) as restored_sha256
from l
"""
