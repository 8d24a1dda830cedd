"""Main text of web pages by removal of site templates.

A page is read into its blocks of text and its elements, each element with a hash of its subtree
(tag, own text and its children's hashes). Spark counts, for each host, in how many distinct pages a
subtree occurs; subtrees that recur across many pages of the host are template and are deleted.
Pages count as distinct by their remaining main text, so copies of one article don't make its
paragraphs look like template; within an article, and where a subtree has ``long_text`` characters or
more, it has to recur on a large part of the host's pages, so neither do near copies.

Structure is used first: elements that are never main text (scripts, styles, forms, navigation,
asides, footers, page headers, landmarks of those kinds ...) go at once. Names never decide alone. A
class or id that names a menu, advert, reader comment and the like ("ad-slot-3"), or what may as well be
content ("search", "related"), gives its element a shape: its tag and names, whatever its words. A shape
has to recur on the host as a subtree has to, so chrome with varying words is counted too; shapes of
clear names and of comments may as well have been found on ``hosts`` different hosts, so a small host
gets the same verdict as a large one. Within an article only the host's own recurrence counts, and an
element that holds nine tenths of what a page has is never deleted for its names, but for comments
beside an article. If a page marks
articles (``article``, ``main``) and they hold half of what remains, its text is what they hold; else,
as with teasers beside a story, it is all that remains.

Both passes parse pages where they are read. Counting shuffles 64-bit hashes with a map-side
combine, first by (host, subtree, page), then by (host, subtree), so a host with a third of all
pages is no hot spot. The template table is written; below ``broadcast_rows`` it goes to every task
as one sorted array, above it is joined to each page's own elements by shuffle.

Rows: one for each input row, an empty table gives none. Null or empty html gives an empty text. Null
urls form one host. Malformed markup (unclosed or stray tags, quotes that never close) is read as far
as it goes, very long pages are read whole. A subtree on exactly the number of pages asked for is
template. Repeated rows and other columns make no difference.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

# Element names by their role, after the HTML standard, and the words in class, id and
# role attributes that name what is not main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset(
    "head nav aside footer form script style noscript template iframe svg embed applet canvas audio video button select option textarea input noembed noframes title datalist".split()
)
LANDMARKS = frozenset("navigation contentinfo complementary search".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option", "thead": "tbody", "tbody": "thead tbody", "tfoot": "tbody"}
SCOPES = frozenset("html body table td th caption object template article section main ul ol dl".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead topbar toolbar cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login social widget pagination pager toc contentinfo complementary".split()
)
COMMENTS = frozenset("comment comments disqus".split())
DIALOGS = frozenset("dialog menu".split())
DOUBTFUL = frozenset(
    "promo promotion rail notice notices alert related recommended recommendations share sharing skip search disclaimer copyright header reply replies respond discussion".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_ATTRIBUTES = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PARTS = re.compile(r"[a-z]+")


def host_of(url: str | None) -> str:
    at = (url or "").find("://")
    return "" if at < 0 else re.split(r"[/?#]", url[at + 3 :], maxsplit=1)[0].lower()


class _Element:
    __slots__ = ("children", "first", "main", "noise", "shape", "tag")

    def __init__(self, tag: str, first: int, noise: str, shape: bytes = b""):
        self.tag, self.first, self.noise, self.shape = tag, first, noise, shape
        self.children: list[bytes] = []
        self.main = False  # an article or main stands in it


def _is_hidden(attributes: str) -> bool:
    low = attributes.lower()
    if "hidden" not in low and "display" not in low:
        return False
    for name, value in _ATTRIBUTES.findall(low):
        value = value.strip("\"'").strip()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"(?:^|;)\s*display\s*:\s*none", value)):
            return True
    return False


def _noise(tag: str, attributes: str, in_article: bool) -> tuple[str, bytes]:
    """How an element's tag and names speak against it, and its shape where only recurrence can tell.

    always: never main text; comment, clear, doubtful: if its shape recurs.
    """
    if tag in DROPPED or (tag == "header" and not in_article):
        return "always", b""
    if (not attributes and tag not in DIALOGS) or tag in ("html", "body"):
        return "", b""
    if _is_hidden(attributes):
        return "always", b""
    found = [(k.lower(), x) for k, v in _NAMES.findall(attributes) for x in v.strip("\"'").lower().split()]
    if any(k == "role" and (x in LANDMARKS or (x == "banner" and not in_article)) for k, x in found):
        return "always", b""
    names = sorted({x for _, x in found})
    parts = {p for x in names for p in _PARTS.findall(x)}
    kind = "comment" if parts & COMMENTS else "clear" if parts & NOISE or tag in DIALOGS else "doubtful" if parts & DOUBTFUL else ""
    return kind, (xxhash.xxh64_digest("\0".join(["shape", tag, *(re.sub("[0-9]+", "0", x) for x in names)]).encode("utf-8", "surrogatepass")) if kind else b"")


def parse(page: str | None, long_text: int = 240) -> tuple[list[str], list[tuple[int, int, int, bool, str]], list[tuple[int, int]]]:
    """Blocks of text; (hash, first block, end block, part of an article or long, kind) of every element with
    text, a named one also by its shape, whose kind is that of its name; and the block ranges of articles."""
    blocks: list[str] = []
    elements: list[tuple[int, int, int, bool, str]] = []
    spans: list[tuple[int, int]] = []  # block ranges of articles
    pieces: list[str] = []
    stack = [_Element("", 0, "")]
    articles = 0

    def end_block() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                blocks.append(text)
                stack[-1].children.append(text.encode("utf-8", "surrogatepass"))

    def close() -> None:
        nonlocal articles
        end_block()
        e = stack.pop()
        main = e.tag in ("article", "main")
        articles -= main
        parent = stack[-1]
        if e.noise == "always":
            del blocks[e.first :]
            while elements and elements[-1][2] > e.first:
                elements.pop()
            while spans and spans[-1][1] > e.first:
                spans.pop()
            return
        digest = xxhash.xxh64_digest(b"\0".join([e.tag.encode(), *e.children]))
        parent.children.append(digest)
        if len(blocks) > e.first:
            long = sum(map(len, blocks[e.first :])) >= long_text if len(blocks) - e.first <= long_text else True
            elements.append((int.from_bytes(digest, "big", signed=True), e.first, len(blocks), articles > 0 or main or long, ""))
            if e.shape and (e.noise == "comment" or not e.main):
                elements.append((int.from_bytes(e.shape, "big", signed=True), e.first, len(blocks), articles > 0, e.noise))
            if main:
                spans.append((e.first, len(blocks)))
        parent.main |= e.main or (main and len(blocks) > e.first)

    def add(text: str) -> None:
        if text:
            pieces.append(entities.unescape(text) if "&" in text else text)

    page, at = page or "", 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                add(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in VOID:
            if tag in ("br", "hr"):
                pieces.append("\n")
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag in INLINE:
                        # The formatting that an inline end tag closes never ends the blocks around it.
                        if all(e.tag in INLINE for e in stack[i:]):
                            for _ in range(len(stack) - i):
                                _close_inline(stack)
                    else:
                        while len(stack) > i:
                            _close_inline(stack) if stack[-1].tag in INLINE and not stack[-1].noise else close()
                    break
                if stack[i].tag in ("table", "td", "th", "object", "template") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        if attributes.endswith("/") and tag not in INLINE and tag not in CLOSES_P:
            continue
        if tag in CLOSES_P or tag in SIBLINGS:
            wanted = SIBLINGS.get(tag, "p").split()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in wanted:
                    while len(stack) > i:
                        _close_inline(stack) if stack[-1].tag in INLINE and not stack[-1].noise else close()
                    break
                if stack[i].tag not in INLINE and stack[i].tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                    break
        noise, shape = _noise(tag, attributes, articles > 0)
        if tag in INLINE and not noise:
            stack.append(_Element(tag, len(blocks), ""))
            continue
        end_block()
        stack.append(_Element(tag, len(blocks), noise, shape))
        articles += tag in ("article", "main")
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if tag == "textarea" or tag == "title":
                add(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            close()
    while len(stack) > 1:
        _close_inline(stack) if stack[-1].tag in INLINE and not stack[-1].noise else close()
    end_block()
    return blocks, elements, spans


def _close_inline(stack: list[_Element]) -> None:
    """Inline elements leave their text in the block around them."""
    e = stack.pop()
    stack[-1].children += e.children
    stack[-1].main |= e.main


#: In place of a host: all of them.
_EVERYWHERE = "\0"


def _keyed(host: str, digest: int) -> int:
    return xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass") + digest.to_bytes(8, "big", signed=True)) - (1 << 63)


def _keys_of(host: str, element: tuple[int, int, int, bool, str]) -> list[int]:
    """What may mark an element as template: its host's key, for clear names outside articles that of all hosts as well."""
    h, _, _, inside, kind = element
    return [_keyed(host, h)] + ([_keyed(_EVERYWHERE, h)] if kind in ("clear", "comment") and not inside else [])


def _within(n: int, ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(n, bool)
    for a, b in ranges:
        out[a:b] = True
    return out


def _print(blocks: list[str], elements: list, spans: list[tuple[int, int]]) -> int:
    """A digest of what is most likely main text: the articles' blocks, or all, without named elements."""
    own = (_within(len(blocks), spans) if spans else np.ones(len(blocks), bool)) & ~_within(len(blocks), [e[1:3] for e in elements if e[4]])
    main = [x for x, keep in zip(blocks, own, strict=True) if keep] or blocks
    return xxhash.xxh64_intdigest(" ".join(main).encode("utf-8", "surrogatepass")) - (1 << 63)


def subtrees(pages: DataFrame) -> DataFrame:
    """host, key, inside, page for every distinct subtree of every page; a null ``inside`` marks the host's own key.

    Shapes that all hosts count together have no host, and their host's key in place of the page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, int, bool | None, int]] = []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                host = host_of(url)
                blocks, elements, spans = parse(page)
                if not blocks:
                    continue
                mark, own = _print(blocks, elements, spans), _keyed(host, 0)
                found = {(host, own, None, mark)}
                for e in elements:
                    first, *more = _keys_of(host, e)
                    found.add((host, first, e[3], mark))
                    found.update((_EVERYWHERE, k, False, own) for k in more)
                rows += found
            types = {"host": pa.string(), "key": pa.int64(), "inside": pa.bool_(), "page": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], list(types))

    return pages.select("url", "html").mapInArrow(run, "host string, key long, inside boolean, page long")


def template_keys(pages: DataFrame, scratch: Scratch, least: int, share: float, article_share: float, hosts: int) -> DataFrame:
    """Keys of the subtrees and shapes that are template, on their host or everywhere."""
    counted = (
        subtrees(pages).groupBy("host", "key", "inside", "page").agg(F.lit(1).alias("one")).groupBy("host", "key", "inside").agg(F.count(F.lit(1)).alias("n"))
    )
    everywhere = F.col("host") == _EVERYWHERE
    counted = scratch.save(counted.where(F.col("inside").isNull() | (F.col("n") >= F.when(everywhere, hosts).otherwise(least))), "subtrees")
    sizes = counted.where("inside is null").select("host", F.col("n").alias("pages"))
    joined = counted.where(F.col("inside").isNotNull() & ~everywhere).join(sizes, "host")
    enough = F.when(F.col("inside"), F.col("n") >= F.greatest(F.lit(4 * least), F.col("pages") * article_share)).otherwise(F.col("n") >= F.col("pages") * share)
    return scratch.save(joined.where(enough).select("key").union(counted.where(everywhere).select("key")).distinct(), "template")


def _text(parsed: tuple[list[str], list, list[tuple[int, int]]], host: str, template) -> str:
    blocks, elements, spans = parsed
    size = np.fromiter(map(len, blocks), np.int64, len(blocks))
    upto = np.concatenate([[0], np.cumsum(size)])
    dropped, marked = np.zeros(len(blocks), bool), _within(len(blocks), spans)
    for e in elements:
        _, a, b, _, kind = e
        beside = kind == "comment" and (marked[:a].any() or marked[b:].any())
        if kind and not beside and 10 * (upto[b] - upto[a]) >= 9 * upto[-1]:
            continue
        if not dropped[a:b].all() and any(k in template for k in _keys_of(host, e)):
            dropped[a:b] = True
    kept = ~dropped
    main = kept & marked
    if main.any() and 2 * size[main].sum() >= size[kept].sum():
        kept = main
    return " ".join(x for x, keep in zip(blocks, kept, strict=True) if keep)


def extract_text(
    pages: DataFrame, scratch: Scratch, least: int = 5, share: float = 0.02, article_share: float = 0.3, hosts: int = 3, broadcast_rows: int = 500_000
) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    A subtree is template if at least ``least`` distinct pages of its host have it, and the part
    ``share`` of them; within articles four times as many, and the part ``article_share``. A shape of a
    clear name is template as well if ``hosts`` hosts have it.
    """
    template = template_keys(pages, scratch, least, share, article_share, hosts)
    schema = "page_id long, url string, text string, n_chars long"

    def output(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
        )

    if template.count() <= broadcast_rows:
        keys = np.sort(np.fromiter((r.key for r in template.toLocalIterator()), np.int64))
        held = pages.sparkSession.sparkContext.broadcast(keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = frozenset(held.value.tolist())
            for batch in batches:
                texts = [_text(parse(page), host_of(url), known) for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)]
                yield output(batch, texts)

        return pages.select("page_id", "url", "html").mapInArrow(run, schema)

    digest = F.md5(F.concat_ws("\x1f", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))))

    def own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, keys = [], []
            for d, url, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                host = host_of(url)
                own = {k for e in parse(page)[1] for k in _keys_of(host, e)}
                digests += [d] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(keys, pa.int64())], ["digest", "key"])

    rows = pages.select("page_id", "url", "html", digest.alias("digest"))
    drop = rows.select("digest", "url", "html").mapInArrow(own_keys, "digest string, key long").distinct().join(template, "key", "left_semi")
    drop = drop.groupBy("digest").agg(F.collect_list("key").alias("keys"))  # at most as many as the page has elements

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("url", "html", "keys"))
            yield output(batch, [_text(parse(page), host_of(url), frozenset(keys or ())) for url, page, keys in zip(*columns, strict=True)])

    return rows.join(drop, "digest", "left").select("page_id", "url", "html", "keys").mapInArrow(run_joined, schema)
