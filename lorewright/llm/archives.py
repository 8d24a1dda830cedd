r"""Legacy web archives (ARC) written, read, and converted to WARC.

An ARC file starts with a version block, ``filedesc://...``, whose body names the version and the
fields of the records that follow. Every record has one header line of space-separated fields and a
body of the declared length, so bodies may hold anything, header look-alikes included:

* version 1: URL, IP address, date, content type, length;
* version 2: URL, IP address, date, content type, result code, checksum, location, offset, file
  name, length.

Dates have 14 digits, or 12 in old files. A header line with more fields than declared has spaces in
its URL. Where a header line can't be read, a body is cut off, or does not end where its length says,
the reader skips to the next line that looks like a header, and reports what it skipped: one damaged
record costs itself only (``arc_faults`` lists them). A damaged gzip member costs that member.

The converter gives each record the WARC equivalent: a ``WARC-Record-ID`` derived from its content and
place (the same on every run, so a task that runs again writes the same record), the date in ISO form,
the IP address, SHA-1 payload digests, and a type: ``response`` for HTTP messages fetched over http,
``resource`` with the ARC record's content type otherwise. The version block's text goes into the
``warcinfo`` record of the file, and ARC fields without a WARC name are carried as ``WARC-X-ARC-...``.

Files are made in tasks, ``file_bytes`` of records at a time, one gzip member for each record, and
written by Spark's own text sink, so they go to any store that Spark writes to (which puts one line
feed behind the last member). They are read back by ``binaryFile``, one bounded file at a time, a
record at a time. Of records with equal payloads of ``revisit_bytes`` bytes or more, the one with the
largest page_id stays a ``response`` and the others become ``revisit`` records without a body. The
largest id of each digest is found with a map-side combine, written as a table of digests that really
repeat, and joined to the records; the planner broadcasts it only if small.

Rows: one for each input row, an empty table gives none. Null html is an empty payload; a null url
becomes an empty URL; white space in a url is percent-encoded, as header lines are split at it. Null
page_ids are carried, but refer to nothing and are never referred to: such a record is a response.
Repeated rows with one page_id are all responses if that id is the largest. Very long payloads are one
record in a file of their own. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Record fields of the two ARC versions, in file order.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Fields that WARC has no header for.
ARC_ONLY = ("Result-code", "Checksum", "Location", "Filename")

_ESCAPES = {ord(c): f"%{ord(c):02X}" for c in " \t\n\r\x0b\x0c"}
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122: names that are URLs
# What looks like the header line of an ARC record: a URL, a date of 12 or 14 digits, a length at the end.
_HEADER = re.compile(rb"^[A-Za-z][A-Za-z0-9+.-]*:[^\n]* [0-9]{12}(?:[0-9]{2})? [^\n]*[0-9]\r?$", re.M)


def arc_block(version: int, name: str, date: str) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 lorewright\n{' '.join(ARC_FIELDS[version])}\n".encode()
    rest = {1: "text/plain", 2: "text/plain 200 - - 0 " + name}[version]
    return f"filedesc://{name} 0.0.0.0 {date} {rest} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, body: bytes, offset: int, name: str, ip: str = "0.0.0.0") -> bytes:
    kind = "text/html"
    middle = kind if version == 1 else f"{kind} 200 {hashlib.md5(body).hexdigest()} - {offset} {name}"
    return f"{url.translate(_ESCAPES) or '-'} {ip} {date} {middle} {len(body)}\n".encode() + body + b"\n"


def packed(record: bytes) -> bytes:
    """A record as one gzip member."""
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def unpacked(data: bytes) -> Iterator[bytes | None]:
    """The gzip members of a file, or the file itself if it is not packed; None for a damaged member."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data[at : at + 2] == b"\x1f\x8b":
        start, parts, z = at, [], zlib.decompressobj(31)
        try:
            while not z.eof and at < len(view):
                step = view[at : at + 65536]
                parts.append(z.decompress(step))
                at += len(step) - len(z.unused_data)
        except zlib.error:
            parts = None
        if parts is not None and z.eof:
            yield b"".join(parts)
            continue
        yield None
        at = data.find(b"\x1f\x8b\x08", start + 2)
        if at < 0:
            return


def _fields(line: bytes, names: tuple[str, ...]) -> dict[str, str] | None:
    """A header line by field; spaces beyond the declared fields belong to the URL."""
    values = line.decode("utf-8", "replace").rstrip("\r").split(" ")
    if len(values) < len(names) or not values[-1].isdigit():
        return None
    extra = len(values) - len(names) + 1
    return dict(zip(names, [" ".join(values[:extra]), *values[extra:]], strict=True))


def read_arc(members: Iterable[bytes | None]) -> Iterator[tuple[dict[str, str] | None, bytes | str]]:
    """(fields, body) of every record, version blocks included; (None, fault) for what can't be read."""
    names = ARC_FIELDS[1]
    for data in members:
        if data is None:
            yield None, "damaged gzip member"
            continue
        at = 0
        while at < len(data):
            if data[at : at + 1] in (b"\n", b"\r"):
                at += 1
                continue
            end = data.find(b"\n", at)
            line = data[at : end if end >= 0 else len(data)]
            opens = line.startswith(b"filedesc:")
            # A version block's own line has the fields of its version, which stands in its body.
            named = next((f for v in (2, 1) if (f := _fields(line, ARC_FIELDS[v]))), None) if opens else _fields(line, names)
            length = int(named["Archive-length"]) if named else 0
            stop = end + 1 + length
            fault = None
            if named is None or end < 0:
                fault = "unreadable header line"
            elif stop > len(data):
                fault = "cut off"
            elif stop < len(data) and data[stop : stop + 1] not in (b"\n", b"\r"):
                fault = "length does not fit"
            if fault:
                yield None, f"{fault}: {line[:80].decode('utf-8', 'replace')}"
                found = _HEADER.search(data, at + len(line))
                at = found.start() if found else len(data)
                continue
            body = data[end + 1 : stop]
            if opens:
                version = body.split(b" ", 1)[0]
                names = ARC_FIELDS[2 if version == b"2" else 1]
                named = _fields(line, names) or named
            yield named, body
            at = stop


def iso_date(digits: str) -> str:
    """A 14- or 12-digit ARC date as a WARC date."""
    d = digits.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_payload(body: bytes) -> tuple[bytes, bytes]:
    """(head, payload) of an HTTP message; a body without head is all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    at = body.find(b"\r\n\r\n")
    return (body[: at + 4], body[at + 4 :]) if at >= 0 else (body, b"")


def header_value(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + b"\r\n" + block + b"\r\n\r\n"


def read_warc(members: Iterable[bytes | None]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a WARC file's gzip members."""
    for data in members:
        at = 0
        while data is not None and (at := data.find(b"WARC/1.0\r\n", at)) >= 0:
            end = data.index(b"\r\n\r\n", at)
            headers = {}
            for line in data[at:end].split(b"\r\n")[1:]:
                key, _, value = line.partition(b":")
                headers[key.decode()] = value.strip().decode("utf-8")
            length = int(headers["Content-Length"])
            yield headers, data[end + 4 : end + 4 + length]
            at = end + 4 + length


def record_id(*parts: object) -> str:
    return f"urn:uuid:{uuid.uuid5(_NAMESPACE, chr(31).join(map(str, parts)))}"


def sha1_label(data: bytes) -> str:
    """A digest as WARC files state it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _as_files(records: Iterable[tuple[bytes, bool]], file_bytes: int) -> Iterator[pa.RecordBatch]:
    """(record, may open a file) to file contents of ``file_bytes`` and more, one a batch, cut only before openers."""
    parts, size = [], 0
    for record, opens in records:
        if opens and size >= file_bytes:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["value"])
            parts, size = [], 0
        parts.append(packed(record))
        size += len(record)
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["value"])


def write_files(contents: DataFrame, path: str) -> None:
    """Each ``value`` becomes one file, byte for byte but for one line feed at its end."""
    contents.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def read_files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def pages_to_arc(pages: DataFrame, path: str, file_bytes: int, date: str) -> None:
    """ARC files of ``pages``; versions 1 and 2 alternate every 64 records, so that both readers are in use."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bool]]:
        n = 0
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                version, opens = 1 + n // 64 % 2, n % 64 == 0
                n += 1
                payload = (html or "").encode("utf-8", "surrogatepass")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n"
                if opens:  # a version block may stand anywhere: what follows it has its fields
                    yield arc_block(version, f"v{version}.arc", date), True
                yield arc_record(version, url or "", date, head.encode() + payload, 0, f"v{version}.arc"), False

    write_files(pages.select("page_id", "url", "html").mapInArrow(lambda batches: _as_files(records(batches), file_bytes), "value binary"), path)


_SLIM = "page_id long, url string, date string, sha1 binary, size long, fault string"
_FULL = _SLIM + ", info string, body binary"


def _converted(batches: Iterator[pa.RecordBatch], full: bool) -> Iterator[pa.RecordBatch]:
    """ARC file contents to one row for each record or fault; ``full`` ones with other fields as JSON, and the body."""
    names = ["page_id", "url", "date", "sha1", "size", "fault", *(["info", "body"] if full else [])]
    types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def flush(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

    for batch in batches:
        for content in batch.column("content"):
            rows, size, version = [], 0, ""
            for fields, body in read_arc(unpacked(content.as_py())):
                if fields is None:
                    rows.append((None, None, None, None, None, body, *((None, None) if full else ())))
                    continue
                if fields["URL"].startswith("filedesc:"):
                    version = body.decode("utf-8", "replace")
                    continue
                head, payload = http_payload(body)
                page = header_value(head, "X-Page-Id")
                row = (int(page) if page and re.fullmatch(r"-?[0-9]+", page) else None, fields["URL"], fields["Archive-date"], hashlib.sha1(payload).digest(), len(payload), None)
                if full:
                    info = {k: v for k, v in fields.items() if k in ARC_ONLY or k in ("IP-address", "Content-type")}
                    row += (json.dumps({**info, "version": version}), body)
                rows.append(row)
                size += len(body)
                if size > 4 << 20:
                    yield flush(rows)
                    rows, size = [], 0
            if rows:
                yield flush(rows)


def arc_faults(spark, arc_path: str) -> DataFrame:
    """fault, n: what could not be read in the ARC files below a path."""
    rows = read_files(spark, arc_path).select("content").mapInArrow(lambda b: _converted(b, False), _SLIM)
    return rows.where("fault is not null").groupBy(F.regexp_extract("fault", "^[^:]*", 0).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


def _warc_headers(info: dict, url: str, date: str) -> list[tuple[str, str]]:
    ip = info.get("IP-address", "")
    address = [("WARC-IP-Address", ip)] if ip not in ("", "-", "0.0.0.0") else []
    rest = [(f"WARC-X-ARC-{k}", info[k]) for k in ARC_ONLY if info.get(k, "-") not in ("", "-")]
    return [("WARC-Date", iso_date(date)), ("WARC-Target-URI", url), *address, *rest]


def _warc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
    """Converted rows to (the warcinfo record of a file that starts here, WARC record)."""
    for batch in batches:
        for page_id, url, date, sha1, info, body, kept_id, kept_url, kept_date in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
            info = json.loads(info)
            text = f"software: lorewright\r\nformat: WARC File Format 1.0\r\nconverted-from: ARC {info['version'].split(' ', 1)[0]}\r\narc-version-block: {json.dumps(info['version'])}\r\n".encode()
            opening = warc_record("warcinfo", [("WARC-Record-ID", f"<{record_id('warcinfo', text)}>"), ("WARC-Date", iso_date(date)), ("Content-Type", "application/warc-fields")], text)
            page = [("WARC-X-Page-Id", str(page_id))] if page_id is not None else []
            headers = [("WARC-Record-ID", f"<{record_id(sha1.hex(), url, date, page_id)}>"), *_warc_headers(info, url, date), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode()), *page]
            if body is None:
                headers += [
                    ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", f"<{record_id(sha1.hex(), kept_url, kept_date, kept_id)}>"),
                    ("WARC-Refers-To-Target-URI", kept_url),
                    ("WARC-Refers-To-Date", iso_date(kept_date)),
                    ("WARC-X-Refers-To-Page-Id", str(kept_id)),
                ]
                record = warc_record("revisit", headers, b"")
            elif body.startswith(b"HTTP/") and not re.match(r"(?i)(?!https?:)[a-z][a-z0-9+.-]*:", url):
                record = warc_record("response", [*headers, ("WARC-Block-Digest", sha1_label(body)), ("Content-Type", "application/http; msgtype=response")], body)
            else:
                record = warc_record("resource", [*headers, ("Content-Type", info.get("Content-type", "application/octet-stream"))], body)
            yield opening, record


def arc_to_warc(spark, arc_path: str, warc_path: str, scratch: Scratch, revisit_bytes: int, file_bytes: int) -> None:
    """Convert every ARC file below ``arc_path``; what can't be read is left out (see ``arc_faults``)."""
    slim = read_files(spark, arc_path).select("content").mapInArrow(lambda b: _converted(b, False), _SLIM)
    repeated = (
        slim.where(f"fault is null and size >= {revisit_bytes} and page_id is not null")
        .groupBy("sha1")
        .agg(F.max(F.struct("page_id", "url", "date")).alias("kept"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("sha1", F.col("kept.page_id").alias("kept_id"), F.col("kept.url").alias("kept_url"), F.col("kept.date").alias("kept_date"))
    )
    repeated = scratch.save(repeated, "repeated")
    full = read_files(spark, arc_path).select("content").mapInArrow(lambda b: _converted(b, True), _FULL).where("fault is null")
    marked = full.join(repeated, "sha1", "left")
    revisit = (F.col("size") >= revisit_bytes) & F.col("page_id").isNotNull() & F.col("kept_id").isNotNull() & (F.col("page_id") != F.col("kept_id"))
    body = F.when(revisit, F.lit(None).cast("binary")).otherwise(F.col("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def with_openings() -> Iterator[tuple[bytes, bool]]:
            size = file_bytes  # the first record needs an opening, and so does each one that may start a file
            for opening, record in _warc_records(batches):
                if size >= file_bytes:
                    yield opening, True
                    size = 0
                yield record, False
                size += len(record)

        yield from _as_files(with_openings(), file_bytes)

    columns = marked.select("page_id", "url", "date", "sha1", "info", body.alias("body"), "kept_id", "kept_url", "kept_date")
    write_files(columns.mapInArrow(run, "value binary"), warc_path)


def read_warc_rows(spark, warc_path: str) -> DataFrame:
    """One row for each response or revisit record: page_id, url, record_id, sizes, digest, refers_to.

    A response's digest is computed from its payload and compared with the stated one; a revisit's
    digest is the stated one, and its size comes with the response (see ``archive_report``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column("content"):
                for headers, block in read_warc(unpacked(content.as_py())):
                    if headers["WARC-Type"] not in ("response", "revisit"):
                        continue
                    page, refers = headers.get("WARC-X-Page-Id"), headers.get("WARC-X-Refers-To-Page-Id")
                    stated = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    size = None
                    if headers["WARC-Type"] == "response":
                        payload = http_payload(block)[1]
                        size = len(payload)
                        if hashlib.sha1(payload).hexdigest() != stated:
                            raise ValueError(f"the payload of {headers['WARC-Record-ID']} does not have its digest")
                    rows.append((int(page) if page else None, headers["WARC-Target-URI"], size, stated, headers["WARC-Type"], int(refers) if refers else None, headers["WARC-Record-ID"]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string"
    return read_files(spark, warc_path).select("content").mapInArrow(run, schema)


def archive_report(pages: DataFrame, scratch: Scratch, revisit_bytes: int = 1000, file_bytes: int = 8 << 20, date: str = "20240102030405") -> DataFrame:
    """``pages`` to ARC to WARC and back: one row for each page."""
    spark = pages.sparkSession
    pages_to_arc(pages, scratch.path("arc"), file_bytes, date)
    arc_to_warc(spark, scratch.path("arc"), scratch.path("warc"), scratch, revisit_bytes, file_bytes)
    scratch.drop("arc")
    rows = scratch.save(read_warc_rows(spark, scratch.path("warc")), "records")
    sizes = rows.where("record_type = 'response'").select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), F.col("page_id").alias("p"))
    # A revisit has its payload's size from the response that it refers to: repeated rows of one page have one size.
    sizes = sizes.join(rows.where("record_type = 'revisit'").select(F.col("payload_digest").alias("d")).distinct(), "d", "left_semi")
    sizes = sizes.groupBy("d").agg(F.max("b").alias("b"))
    out = rows.join(sizes, F.col("payload_digest") == F.col("d"), "left")
    return out.select("page_id", F.coalesce("payload_bytes", "b").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


#: The same in DuckDB, from the table itself.
ARCHIVE_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
k as (select payload_digest, max(page_id) as kept from p where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, p.payload_digest,
       case when kept <> page_id then 'revisit' else 'response' end as record_type,
       case when kept <> page_id then kept end as refers_to
from p left join k on k.payload_digest = p.payload_digest and payload_bytes >= 1000
"""
