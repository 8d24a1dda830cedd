r"""Licence scans by canonical digests.

A text is brought into canonical form: lines that state a copyright are left out, so are a leading
title line ("The MIT License (MIT)") and list marks; A-Z is lower-cased, all but letters and digits
becomes one space, and equivalent spellings, of one word or of several, become one. Its SHA-256 is
joined to the digests of known licences, whole text against whole text. Lines are texts too: a
one-line grant ("Released under the MIT License.") is a known text of its own, and the scan reports
the grants that stand as lines in a document beside the licence that the document is, whatever their
length: every line is looked up.

The known digests are a table (digest, licence): by default the entire texts in ``KNOWN_DIGESTS`` and
the grants in ``GRANTS``; ``digest_table`` makes such a table from any texts. It is written, so the
planner broadcasts it if it is small and joins it by shuffle if it is not. Texts are read once, where
they lie.

Rows: one for each input row, an empty table gives none. Null and empty texts have the digest of the
empty text and no licence; so has a text that is nothing but a title. Of several licences with one
digest the first in order of names is given. Results hang on the text alone, so null or repeated
doc_ids and further columns make no difference. Very long texts are read whole, a line at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Digests of entire licence texts and of notices that stand for them, in the canonical form of this module.
KNOWN_DIGESTS = {
    "0BSD": (
        "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c",
    ),
    "Apache-2.0": (
        "cad7e115dcc84198649e380672cb1f510e047a4c15041d152b85406f26b71580",
        "05df7626f78378517e2a4d09ae72278aea3f093e4833a3b6bd7042b425be9a68",
        "5a314a28eba6b6f17ce1fee22213e2abd918a4c6bb3b50cbb3fb24464cd1b817",
        "3a25ef1ea7b3c32f8435f633f2a01e239fedc21f89866084fd400d61f2fb0850",
        "7a46cf4a5d56898d746584f4fe57bdf571d600a8f39d21063431d88929f803c7",
    ),
    "Artistic-1.0-Perl": (
        "b06eda62b7e0c69e6f8a5960610095b69349654af941a79eca834edcd5e64e49",
    ),
    "BSD-2-Clause": (
        "032f33a9fad178d38ba062bc5f6e47fde5eb48f13d4c8895fe1360e806c83a69",
        "6ab8440b62238c993d6db6230b344d74fd22cef6e077435ed18eedd5cad70144",
        "8487e44d35585f42e9392b2b5d09ef792ab09e2919a18cbd2abb381f9200b0e6",
        "ced87f28b63a812fe0b77ec0f7cd8ce6e4cad374624b716f7288c799b5e91f9b",
    ),
    "BSD-3-Clause": (
        "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa",
        "d0a339eb5454123c6a1f2696aace557e0561866f3fe33b93ffad58ecfcab7060",
        "928ed7af6f749bfba73610b43518f2269689e5333f42e06ef02577af8e38171b",
        "1c385a47a06e8617af75a817579f90db8367e306be47def56c8197941b5f1bc8",
        "d250b3ae78c1eb349a5c3dff4d3046669d8c2382781addd4a55bac5f73fe1227",
    ),
    "BSD-4-Clause": (
        "07b7f2ecfbd023ee2e0876efeb9b773a323ec0972871e06291cf7586f8f52a2c",
    ),
    "BSL-1.0": (
        "4242941f56cc0aaf7a416006734167273b17a074704308b941e02a99526671b6",
    ),
    "BlueOak-1.0.0": (
        "abaa5ae6a279325a74ecd2102297db44a5e224352c99a2f196ecd71727fb65df",
    ),
    "CC0-1.0": (
        "888ab175b43ed137ae3c3f8f32a1f0e1677fe31f7a9f09890c39b11b1934ad6c",
    ),
    "CDLA-Permissive-2.0": (
        "6ee3488bcad340dc63d0c7ce8143c10429cf2bbc5c4cac9ba6da003d5a3853c0",
    ),
    "FSFAP": (
        "83f0a3922ebb595067cf6331c723ca068a8018348f49fab264509ef99e300a65",
    ),
    "GFDL-1.2": (
        "8c5ad7c8aabb9db6e0c8b0f17a42302bd4f1ae1e177fb7d07be8a39b24692ecb",
    ),
    "GFDL-1.3": (
        "4535febd1992d48cf58c30b98b1b8276270248059dbb9686530fda1a11c5a4e8",
    ),
    "GPL-1.0": (
        "ccb759ed9f97b19013bbb75be2c230355e8b3993d435c1885559ea0b715b8cca",
    ),
    "GPL-2.0": (
        "5ef1f5f0461a54997a170af5c87102900e651106207b80558de731fd1db30832",
    ),
    "GPL-3.0": (
        "e625dabe077d0db98f64e03d412721706f2820142716a54a88c302e2f67ca53f",
    ),
    "GPL-3.0-or-later": (
        "b1165b3a9c3ac2638585a8adb6e0c10814b7d97627160747134355b2690ff5af",
    ),
    "ISC": (
        "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a",
        "88b7717fcdd81146db5806f169a2882599b1b6575d65b88971edaa913b7dbfa4",
        "f761c9a501035d9f436a1a2bbd08e055e5bff5beee12efcf562978fe57360e68",
    ),
    "LGPL-2.0": (
        "ffd8730789ab0fc5853425d608bf29d213379ce803c8549814e85648681ef32a",
    ),
    "LGPL-2.1": (
        "0af47c8da0e16365147be761910b2af02249ed8ea2f5dbed0a027d6f7639058a",
    ),
    "LGPL-3.0": (
        "26aeb5d3e16e4dee74aba841e3bb744f36eef8e902c291b36439a8a02441cb95",
    ),
    "MIT": (
        "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c",
        "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f",
        "c9e0b21ff70f6dd1855f8a502dd7a9f1911ad6fcf2dfadda0b0770fd5a43808c",
        "f51185296a74dfc01bc387e7ef11097ec5b8317d54ca6c653ddb27f1054a9401",
        "746f9c7b4a6f8b020fb1c719835d358e1311969497ceddb4840b046522b5564e",
    ),
    "MIT-0": (
        "a181c333030f65ebcf2eabeca3493225b6b03fce6907bdd3e59e7a8a37180fbd",
    ),
    "MPL-1.1": (
        "d95cc0543b6570cfad85bc0c962fe4dd5b5542fb6d6da8458601af7d2a231503",
    ),
    "MPL-2.0": (
        "d7fbfc052cff80cd4b7fac1ee2676014505cdeda5c49ea518929672857f61fcd",
        "acb0bece3dc447740b87a4db23e0d425157552e4a33f273241a94444c2368900",
    ),
    "Python-2.0": (
        "58f0d6f7dc087a8b222f4fc22a45629efd18d87bba80b21d5a7f5dc209df8800",
    ),
    "Unlicense": (
        "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229",
    ),
    "WTFPL": (
        "0f65ef39d26d7352b72163ea61a7839f6973825fa0a5c2914b938205bead0f23",
    ),
    "Zlib": (
        "9ddc78a5797b5008d488969fd959f4281a97821e07ddc5d19ca9c163fdbeeb73",
    ),
}

#: One-line grants.
GRANTS = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)

#: Equivalent spellings of one word, and of several, each with the one that stands for both.
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "licences": "licenses", "licenced": "licensed", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization",
    "whilst": "while", "wilful": "wilfull",
}
SEVERAL = {
    "copyright owner": "copyright holder", "copyright owners": "copyright holders", "sub license": "sublicense", "sub licenses": "sublicenses", "sub licensed": "sublicensed",
    "sub licensing": "sublicensing", "non infringement": "noninfringement", "non commercial": "noncommercial", "per cent": "percent",
}

# A notice names an owner: a mark, a year or "by" follows the word, which alone may start a wrapped line of the licence.
_COPYRIGHT = r"^[^\p{L}\p{N}©(]*(?:(?:(?:copyright|copr)[^\p{L}\p{N}©(]*)?(?:\(c\)|©)|(?:copyright|copr)[^\p{L}\p{N}]*(?:[0-9]{4}|by )|all rights reserved[^\p{L}]*$)"
_NOTICE = ("copyright", "copr", "(c)", "©", "all rights reserved")
# A title names a licence and grants nothing.
_TITLE = r"^[ \t\r\n#=*]*(?:[a-z0-9.+/\"'-]+ ){0,6}licen[cs]e(?: ?\([^()\n]{0,40}\))?(?:,? ?v?(?:ersion)? ?[0-9][0-9.]*)?[ \t\r.:*]*(?:\n[ \t\r=#*-]*(?:\n|$)|\n|$)"
_MARKS = r"^[ \t]*(?:[*•·-]|\(?[0-9]{1,2}[.)]|\(?[a-z][.)])[ \t]+"

_copyright, _title, _marks, _gaps = regex.compile(_COPYRIGHT).match, re.compile(_TITLE).match, re.compile(_MARKS).sub, re.compile(r"[\W_]+").split


def _lower(text: str | None) -> str:
    """A-Z lower-cased, every other character untouched."""
    return (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _is_notice(line: str) -> bool:
    return any(x in line for x in _NOTICE) and _copyright(line) is not None


def _words(line: str) -> list[str] | None:
    """The words of a lower-case line, each in its one spelling; None for a notice."""
    return None if _is_notice(line) else [EQUIVALENT.get(w, w) for w in _gaps(_marks("", line)) if w]


def _joined(words: list[str]) -> str:
    """One space between words, several-word spellings made one."""
    spaced = f" {'  '.join(words)} "
    for one, other in SEVERAL.items():
        if one.replace(" ", "  ") in spaced:
            spaced = spaced.replace(f" {one.replace(' ', '  ')} ", f" {other.replace(' ', '  ')} ")
    return spaced.replace("  ", " ").strip(" ")


def _title_lines(lines: list[str]) -> int:
    """How many of the lines make up a title at their head."""
    first = next((i for i, line in enumerate(lines) if any(c.isalnum() for c in line)), len(lines))
    title = _title("\n".join(lines[: first + 2]))
    if not title or " under " in title[0]:
        return 0
    return title[0].count("\n") + (not title[0].endswith("\n"))


def _whole(lines: list[str], words: list[list[str] | None]) -> str:
    kept = [i for i, w in enumerate(words) if w is not None]
    return _joined([w for i in kept[_title_lines([lines[i] for i in kept]) :] for w in words[i]])


def canonical(text: str | None) -> str:
    """Canonical form: one space between words, none at the ends."""
    lines = _lower(text).split("\n")
    return _whole(lines, [_words(x) for x in lines])


def canonical_line(line: str) -> str:
    """Canonical form of a line on its own, a title or not."""
    return _joined(_words(_lower(line)) or [])


def digest(form: str) -> str:
    return hashlib.sha256(form.encode("utf-8", "surrogatepass")).hexdigest()


def known_digests() -> list[tuple[str, str]]:
    """(licence, digest) of the known texts and grants."""
    return [*((name, d) for name, all_ in KNOWN_DIGESTS.items() for d in all_), *((name, digest(canonical_line(x))) for name, x in GRANTS)]


def digest_table(texts: DataFrame) -> DataFrame:
    """(licence, text) to (licence, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(canonical(x)) for x in batch.column(1).to_pylist()], pa.string())], ["licence", "digest"])

    return texts.select("licence", "text").mapInArrow(run, "licence string, digest string")


def _scanner(held):
    """Rows (doc_id, text) with the digest of the whole text, and those of its distinct lines that are in ``held`` (all where it is None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, lines = [], []
            for text in batch.column("text").to_pylist():
                rows = _lower(text).split("\n")
                words = [_words(x) for x in rows]
                whole.append(digest(_whole(rows, words)))
                found = (digest(_joined(list(x))) for x in {tuple(x) for x in words if x})
                lines.append([x for x in found if held is None or x in held.value])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(whole, pa.string()), pa.array(lines, pa.list_(pa.string()))], ["doc_id", "digest", "lines"])

    return run


def scan(docs: DataFrame, scratch: Scratch, known: DataFrame | None = None, broadcast_digests: int = 200_000) -> DataFrame:
    """doc_id, digest, licence, line_licences for every row of ``docs`` (doc_id, text).

    ``known`` is a table (licence, digest). Up to ``broadcast_digests`` of them (some 120 bytes each) go to every
    task, and only lines that are known leave it; above that all lines are joined. ``licence`` is that of the entire text; ``line_licences``
    the sorted, comma-separated ones of granting lines, empty if there is none.
    """
    spark = docs.sparkSession
    if known is None:
        known = spark.createDataFrame(known_digests(), "licence string, digest string")
    table = scratch.save(known.groupBy("digest").agg(F.min("licence").alias("licence")), "known")
    few = table.limit(broadcast_digests + 1).count() <= broadcast_digests
    held = spark.sparkContext.broadcast(frozenset(r.digest for r in table.select("digest").toLocalIterator())) if few else None
    rows = docs.select("doc_id", "text").mapInArrow(_scanner(held), "doc_id long, digest string, lines array<string>")
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "scanned")
    lines = rows.select("row", F.explode("lines").alias("digest")).join(table, "digest")
    granted = lines.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("found"))
    out = rows.select("row", "doc_id", "digest").join(table, "digest", "left").join(granted, "row", "left")
    return out.select("doc_id", "digest", "licence", F.coalesce("found", F.lit("")).alias("line_licences"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def scan_sql() -> str:
    """The scan of ``documents`` in DuckDB."""

    def joined(x: str) -> str:
        out = f"' ' || trim(regexp_replace(regexp_replace({x}, {_quoted('(?m)' + _MARKS)}, '', 'g'), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g'), ' ') || ' '"
        for one, other in {**EQUIVALENT, **SEVERAL}.items():
            out = f"replace({out}, ' {one.replace(' ', '  ')} ', ' {other.replace(' ', '  ')} ')"
        return f"trim(replace({out}, '  ', ' '), ' ')"

    notice = f"regexp_matches(l, {_quoted(_COPYRIGHT)})"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rows = ", ".join(f"({_quoted(n)}, {_quoted(d)})" for n, d in known_digests())
    return f"""
with k as (select digest, min(licence) as licence from (values {rows}) as v(licence, digest) group by 1),
d as (select row_number() over () as rid, doc_id, string_split({low}, chr(10)) as lines, text is null as none from documents),
b as (select rid, doc_id, array_to_string(list_filter(lines, lambda l: not {notice}), chr(10)) as x from d),
t as (select rid, doc_id, x, regexp_extract(x, {_quoted(_TITLE)}) as title from b),
w as (select rid, doc_id, case when title <> '' and not contains(title, ' under ') then substring(x, length(title) + 1) else x end as x from t),
f as (select rid, doc_id, sha256({joined('x')}) as digest from w),
l as (select rid, case when {notice} then '' else {joined('l')} end as form from (select distinct rid, unnest(lines) as l from d where not none)),
g as (select rid, string_agg(distinct licence, ',' order by licence) as found from l join k on k.digest = sha256(form) where form <> '' group by 1)
select doc_id, f.digest, licence, coalesce(found, '') as line_licences from f left join k on k.digest = f.digest left join g on g.rid = f.rid
"""
