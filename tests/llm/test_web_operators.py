"""URL rules, HTML extraction and archives."""

import hashlib
import random
from html.parser import HTMLParser
from itertools import chain, combinations

from lorewright.llm import archives, html_extract, url_rules
from lorewright.scratch import Scratch

PAGES = "page_id long, url string, html string, host string, text string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], PAGES).repartition(3)


def test_explicit_rules(spark):
    urls = {
        1: ("https://a.example.org/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
        2: ("HTTP://Example.ORG/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        3: ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        4: ("http://x.com/fr/9", "x.com", "/fr/9", "com/fr/", "allow"),
        5: ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        6: ("http://x.com/en", "x.com", "/en", None, "allow"),
        7: (None, "", "", None, "allow"),
        8: ("no scheme/org/", "", "", None, "allow"),
        9: ("http://org", "org", "", None, "allow"),
        10: ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        11: ("http://ÉX.org?q=/es/", "Éx.org", "", None, "allow"),
        12: ("http://", "", "", None, "allow"),
        13: ("http://a://b.org/es/", "a:", "//b.org/es/", None, "allow"),
    }
    pages = frame(spark, [(i, u[0], "") for i, u in urls.items()])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = url_rules.judge_urls(pages, labels, Scratch(spark, "t2"))
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()} == {i: u[1:] for i, u in urls.items()}
    assert url_rules.judge_urls(pages.where("false"), labels, Scratch(spark, "t2")).count() == 0


def test_mined_rules_equal_brute_force(spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        host = rnd.choice(["www.fine.com", "spam.net", "blog.mixed.com"])
        query = rnd.choice(["", "?utm=1", "?ref=2"])
        bad = host == "spam.net" or (host == "blog.mixed.com" and query == "?ref=2")
        rows.append((i, f"http://{host}/{rnd.choice('ab')}/{i % 9}{query}", ""))
        if i % 2:
            labels.append((i, int(not (bad and rnd.random() < 0.95)), 0))
    rows += [(1, rows[1][1], ""), (None, "http://spam.net/a/1", ""), (900, None, "")]
    pages = frame(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = url_rules.judge_urls(pages, lab, Scratch(spark, "t2"), rules=(), support=0.01, count=3, confidence=0.8)
    items = {r.url: r.t for r in pages.select("url", url_rules.tokens(pages.url).alias("t")).collect()}
    known = dict((i, q) for i, q, _ in labels)
    sets = [(frozenset(items[u]), known[i] == 0) for i, u, _ in rows if i in known and u]
    n = len(sets)
    every = {frozenset(c) for s, _ in sets for c in chain.from_iterable(combinations(sorted(s), k) for k in range(1, len(s) + 1))}
    rules = []
    for a in every:
        hit, all_ = sum(a <= s and b for s, b in sets), sum(a <= s for s, _ in sets)
        if hit / n >= max(0.01, 3 / n) and hit / all_ >= 0.8:
            rules.append(a)
    got = sorted((-1 if r.page_id is None else r.page_id, r.verdict) for r in out.collect())
    expected = sorted(((i if i is not None else -1), "block" if u and any(a <= set(items[u]) for a in rules) else "allow") for i, u, _ in rows)
    assert got == expected and {v for _, v in got} == {"allow", "block"}


def test_tokens(spark):
    urls = {
        "HTTP://www.casino-win.example.com/en/Page-12/7.html?id=3&ref=x#top": {"scheme=http", "d=www.casino-win.example.com", "d=casino-win.example.com", "d=example.com", "s=www", "h=casino", "h=win", "p=en", "p=Page-0", "p=0.html", "e=html", "q=id", "q=ref"},
        "https://localhost": {"scheme=https", "d=localhost"},
        "no scheme": set(),
        "http://a.b/" + "x/" * 5000: {"scheme=http", "d=a.b", "p=x"},
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r.t for r in df.select("url", url_rules.tokens(df.url).alias("t")).collect()}
    assert {u: set(t) for u, t in got.items()} == urls and all(len(t) == len(set(t)) for t in got.values())


def test_planted_signal_over_many_pages(spark):
    """Bad hosts share a word in their names: the mined rule finds those that no label names."""
    rnd = random.Random(21)
    rows, labels = [], []
    for i in range(6000):
        bad = rnd.random() < 0.1
        host = f"{rnd.choice(['free', 'best'])}-bets{rnd.randrange(200)}.net" if bad else f"site{rnd.randrange(300)}.{rnd.choice(['com', 'net'])}"
        host = host.replace("bets", "bets-") if bad else host
        rows.append((i, f"http://{host}/{rnd.choice(['en', 'de'])}/{i}", ""))
        if i % 3 == 0:
            labels.append((i, int(not bad), 0))
    pages = frame(spark, rows)
    out = url_rules.judge_urls(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), Scratch(spark, "t2"), rules=()).collect()
    blocked = {r.page_id for r in out if r.verdict == "block"}
    assert blocked == {i for i, u, _ in rows if "-bets-" in u} and any(i % 3 for i in blocked)
    assert {r.bad_rule for r in out if r.bad_rule} <= {"h=bets", "h=free", "h=best"}


def test_equally_long_rules(spark):
    pages = frame(spark, [(1, "http://a.org/x/y", "")])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = url_rules.judge_urls(pages, labels, Scratch(spark, "t2"), rules=(("block", "org/x/y"), ("allow", "a.org/x"))).collect()
    assert out[0].rule == "org/x/y"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu {n}</a></li></ul></nav><div class="ad">Buy {n}</div><header><h2>Site</h2></header>
<p>Welcome to our fine site.</p>{body}<div id="comments"><article><p>First!</p></article></div>
<aside>Side {n}</aside><form><label>Mail</label><input value="x"></form><footer>&copy; us</footer></body></html>"""


def test_main_text_and_templates(spark):
    rows = []
    for i in range(30):
        body = f"<article><h1>Title&nbsp;{i} &amp; co</h1><p><b>Bold text {i}.<br><p>Second&#33; para\n {i}<p>Third <i>in</i>line{i}</article>"
        rows.append((i, f"http://a.com/{i}", PAGE.format(n=i, body=body)))
    for i in range(30, 60):
        rows.append((i, f"http://b.com/{i}", PAGE.format(n=i, body=f"<div><p>Own text {i} 1 &lt; 2</p><ul><li>one{i}<li>two{i}</ul></div>")))
    rows += [(60, None, None), (61, "http://b.com/e", ""), (62, "x", "plain < text & more"), (63, "x", '<p class="a>broken <b>text'), (64, "http://b.com/30", rows[30][2])]
    rows += [(65, "y", "<article>" + "<p>long é</p>" * 20_000 + "</article>"), (66, "y", "<article><div><p>a</div></div></p>b</article><p>outside</p>")]
    pages = frame(spark, rows)
    expected = {i: f"Title {i} & co Bold text {i}. Second! para {i} Third inline{i}" for i in range(30)}
    expected |= {i: f"Own text {i} 1 < 2 one{i} two{i}" for i in range(30, 60)}
    expected |= {60: "", 61: "", 62: "plain < text & more", 64: expected[30], 65: " ".join(["long é"] * 20_000), 66: "a b outside"}  # the article of 66 holds less than half of its page
    for limit in (500_000, 0):
        out = html_extract.extract_text(pages, Scratch(spark, "t4"), broadcast_rows=limit).collect()
        got = {r.page_id: r.text for r in out}
        assert {i: got[i] for i in expected} == expected
        assert all(r.n_chars == len(r.text) for r in out) and len(out) == len(rows)
    assert html_extract.extract_text(pages.where("false"), Scratch(spark, "t4")).count() == 0


def texts_of(spark, rows, **options):
    return {r.page_id: r.text for r in html_extract.extract_text(frame(spark, rows), Scratch(spark, "t4"), **options).collect()}


def test_recurrence_decides(spark):
    """Chrome without any telling name, and names that tell too little: the same pages with and without recurrence."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    say = lambda n: " ".join(rnd.choices(words, k=n))
    bodies = {i: say(40) for i in range(40)}
    page = '<div class="c1"><p>The site of sites.</p></div><div class="slot ad-{n}"><p>{ad}</p></div><div class="x"><p>{body}</p></div><table><tr><td>Made with care</td></tr></table>'
    rows = [(i, f"http://a.com/{i}", page.format(n=i % 7, ad=say(5), body=b)) for i, b in bodies.items()]
    rows += [(100, "http://a.com/s", '<div class="search-results"><p>main text</p></div><div class="post promo-2024"><p>more</p></div><p title="x hidden y">kept</p><p hidden>gone</p><p style="color:red; display: none">gone</p>')]
    rows += [(101, "http://one.com/", '<section id="promotion-history"><p>history</p></section><div class="left-sidebar"><p>side</p></div><div class="sidebar"><p>side</p></div>')]
    chrome = '<div class="sidebar"><p>{n}</p></div><div class="left-sidebar"><p>{n}</p></div><div class="slot ad-1"><p>{n}</p></div>'
    rows += [(200 + i, f"http://other{i}.com/", chrome.format(n=i) + f"<p>{say(60)}</p>") for i in range(3)]  # names count where other hosts have them
    got = texts_of(spark, rows)
    assert {i: got[i] for i in bodies} == bodies
    assert got[100] == "main text more kept" and got[101] == "history"
    off = texts_of(spark, rows, least=1000)  # nothing can recur: only structure and clear names are left
    assert all(off[i] == f"The site of sites. {b} Made with care" for i, b in bodies.items())
    assert texts_of(spark, rows, broadcast_rows=0) == got


STORY = " ".join(f"story{i}" for i in range(50))


def test_main_text_is_never_lost(spark):
    """Teasers beside a story, names that sound like chrome, elements that belong into sentences, small hosts like large ones."""
    policy = f'<div class="comments-policy-2024"><p>{STORY}</p></div>'
    wrapped = '<div class="story-toolbar-{n}"><p>{text}</p></div>'
    pages = {
        1: ("http://a.com/", f"<div><p>{STORY}</p></div><article><p>teaser one</p></article><article><p>teaser two</p></article>", f"{STORY} teaser one teaser two"),
        2: ("http://b.com/", f'<article><p>{STORY}</p><p id="comment-on-policy">A comment on policy.</p></article>', f"{STORY} A comment on policy."),
        3: ("http://c.com/", policy, STORY),
        4: ("http://d.com/", '<article><p>Energy is <math><mi>E</mi></math> here</p><label>Label</label> <object>fallback</object><map>m</map></article>', "Energy is E here Label fallback m"),
        5: ("http://e.com/", f'<article><p>{STORY}</p><div class="social"><p>Social history.</p></div><div id="toc"><p>Table of contents.</p></div></article>', f"{STORY} Social history. Table of contents."),
        6: ("http://f.com/", f'<article><p>{STORY}</p></article><div role="complementary"><p>aside</p></div><div role="banner">site</div>', STORY),
    }
    n = 10
    for host, many in (("small", 4), ("large", 12)):
        for i in range(many):
            n += 1
            pages[n] = (f"http://{host}.com/{i}", wrapped.format(n=i, text=f"{STORY} {n}"), f"{STORY} {n}")
    for host in "xyz":  # readers' comments longer than what they are about, on few pages of several hosts
        n += 1
        pages[n] = (f"http://{host}.com/", f'<article><p>Article {n} of some length.</p></article><div class="comments"><article><p>{STORY}</p></article></div>', f"Article {n} of some length.")
    rows = [(i, u, h) for i, (u, h, _) in pages.items()]
    want = {i: t for i, (_, _, t) in pages.items()}
    assert texts_of(spark, rows) == want
    assert texts_of(spark, rows, broadcast_rows=0) == want


class Plain(HTMLParser):
    """The text of articles by the standard library's parser: blocks at every tag that is not part of a line."""

    LINE = set("a b i em strong span code sup sub small u q cite abbr mark time".split())
    GONE = set("nav aside form footer script style noscript button select textarea svg iframe".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.piece, self.inside, self.gone = [], "", 0, []

    def end_block(self):
        if self.piece.split():
            self.blocks.append(" ".join(self.piece.split()))
        self.piece = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.GONE:
            self.gone.append(tag)
        if tag == "br":
            self.piece += "\n"
        elif tag not in self.LINE:
            self.end_block()
        self.inside += tag in ("article", "main")

    def handle_endtag(self, tag):
        if tag not in self.LINE:
            self.end_block()
        if self.gone and self.gone[-1] == tag:
            self.gone.pop()
        self.inside -= tag in ("article", "main")

    def handle_data(self, data):
        if self.inside > 0 and not self.gone:
            self.piece += data


def test_equals_another_parser_on_the_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    got = {r.page_id: r.text for r in html_extract.extract_text(rows, Scratch(spark, "t4")).collect()}
    want = {}
    for r in rows.collect():
        parser = Plain()
        parser.feed(r.html or "")
        parser.close()
        parser.end_block()
        want[r.page_id] = " ".join(parser.blocks)
    assert got == want


def test_template_keys_equal_a_plain_count(spark):
    rnd = random.Random(12)
    parts = [f"<div><p>part {i}</p></div>" for i in range(12)]
    rows = [(i, f"http://{'ab'[i % 3 > 0]}.com/{i}", "".join(rnd.choices(parts, k=4)) + f"<p>own {i}</p>") for i in range(90)]
    seen = {}
    for i, u, h in rows:
        for part in {p for p in parts if p in h}:
            seen.setdefault((u[7], part), set()).add(h)
    hosts = {h: sum(u[7] == h for _, u, _ in rows) for h in "ab"}
    least, share = 5, 0.4
    gone = {k for k, pages in seen.items() if len(pages) >= max(least, share * hosts[k[0]])}
    got = texts_of(spark, rows, least=least, share=share)
    for i, u, h in rows:
        kept = [p for p in h.replace("</div>", "</div>\n").split("\n") if p in parts and (u[7], p) not in gone]
        assert got[i] == " ".join([p[8:-10] for p in kept] + [f"own {i}"])
    assert 0 < len(gone) < len(seen)


def test_near_copies_in_plain_markup_stay(spark):
    long = [" ".join(f"w{i}{j}" for j in range(60)) for i in range(4)]
    rows = [(i, f"http://a.com/{i}", "".join(f"<div><p>{x}</p></div>" for x in long) + f"<p>tail {i}</p>") for i in range(8)]
    rows += [(100 + i, f"http://a.com/o{i}", f"<p>other page {i}</p>") for i in range(60)]
    got = texts_of(spark, rows)
    assert all(got[i] == " ".join([*long, f"tail {i}"]) for i in range(8))


def test_copies_of_an_article_are_not_template(spark):
    text = "<article><p>The very same words.</p></article>"
    rows = [(i, "http://a.com/x", f"<html><nav>n{i}</nav>{text}</html>") for i in range(40)]
    out = html_extract.extract_text(frame(spark, rows), Scratch(spark, "t4"))
    assert {r.text for r in out.collect()} == {"The very same words."}


def test_archives_round_trip(spark):
    big = "<p>é payload\nfiledesc://x 0.0.0.0 1 text/plain 5\r\n\r\nWARC/1.0\r\n</p>" * 40
    rows = [(1, "http://a b/\n", "small"), (2, "http://a/", big), (3, "http://b/", big), (9, "http://c/", big), (4, None, None), (5, "http://é/", "small"), (None, "http://n/", big)]
    rows += [(100 + i, f"http://m/{i}", big + str(i % 150)) for i in range(300)]
    rows += [(7, "http://r/", "z" * 2_000_000), (7, "http://r/", "z" * 2_000_000)]
    out = archives.archive_report(frame(spark, rows), Scratch(spark, "t5"), file_bytes=200_000).collect()
    payload = [(h or "").encode() for _, _, h in rows]
    best = {}
    for (i, _, _), p in zip(rows, payload, strict=True):
        if i is not None and len(p) >= 1000:
            best[p] = max(best.get(p, i), i)
    expected = []
    for (i, _, _), p in zip(rows, payload, strict=True):
        refers = best.get(p) if i is not None and best.get(p) != i else None
        expected.append((i or 0, len(p), hashlib.sha1(p).hexdigest(), "revisit" if refers is not None else "response", refers or 0))
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in out) == sorted(expected)
    assert archives.archive_report(frame(spark, rows).where("false"), Scratch(spark, "t5")).count() == 0


def test_negative_and_zero_ids_take_part_in_revisits(spark):
    big = "payload " * 150
    out = archives.archive_report(frame(spark, [(-7, "http://a/", big), (3, "http://b/", big), (0, "http://c/", big), (-9, "http://d/", "small")]), Scratch(spark, "t5")).collect()
    assert {r.page_id: (r.record_type, r.refers_to) for r in out} == {-7: ("revisit", 3), 0: ("revisit", 3), 3: ("response", None), -9: ("response", None)}


def test_arc_versions_and_dates():
    v1 = archives.arc_block(1, "a.arc", "20010203040506") + archives.arc_record(1, "http://a/", "200102030405", b"HTTP/1.0 200 OK\r\n\r\nhi\n\n", 0, "a")
    v2 = archives.arc_block(2, "b.arc", "20010203040506") + archives.arc_record(2, "http://b/", "20010203040506", b"body", 0, "b")
    for members in ([v1 + v2], [v1, v2], list(archives.unpacked(archives.packed(v1) + archives.packed(v2) + b"\n"))):
        records = list(archives.read_arc(members))
        assert [f["URL"] for f, _ in records] == ["filedesc://a.arc", "http://a/", "filedesc://b.arc", "http://b/"]
        assert records[1][1] == b"HTTP/1.0 200 OK\r\n\r\nhi\n\n" and records[3][0]["Checksum"] == hashlib.md5(b"body").hexdigest()
    assert archives.iso_date("200102030405") == "2001-02-03T04:05:00Z"
    assert archives.record_id("x", 1) == archives.record_id("x", 1) != archives.record_id("x", 2)


def test_damaged_archives_cost_only_their_damage(spark, tmp_path):
    block = archives.arc_block(1, "a.arc", "20010203040506")
    good = [archives.arc_record(1, f"http://g/{i}", "20010203040506", f"HTTP/1.1 200 OK\r\n\r\nbody {i}\n".encode(), 0, "a", "10.0.0.7") for i in range(4)]
    spaced = b"http://s/a b c 10.0.0.8 20010203040506 text/plain 5\nplain\n"
    cut = b"http://c/ 10.0.0.9 20010203040506 text/html 5000\nshort\n"
    wrong = b"http://w/ 10.0.0.9 20010203040506 text/html 3\nlonger than three\n"
    odd = b"not a header line\n"
    dns = b"dns:x.org 10.0.0.1 20010203040506 text/dns 9\nHTTP/ not\n"
    data = block + good[0] + spaced + cut + good[1] + wrong + odd + good[2] + dns + good[3] + b"http://t/ 1.1.1.1 20010203040506 text/html 99\ntail"
    folder = tmp_path / "arc"
    folder.mkdir()
    (folder / "part-plain.arc").write_bytes(data)
    v2 = archives.arc_block(2, "b.arc", "20010203040506") + archives.arc_record(2, "http://v2/", "20010203040506", b"HTTP/1.1 200 OK\r\n\r\nv2", 0, "b")
    more = archives.arc_record(2, "http://g/1", "20010203040506", b"HTTP/1.1 200 OK\r\n\r\nbody 1\n", 0, "a", "10.0.0.7")
    broken = bytearray(archives.packed(more))
    broken[20:40] = b"\x00" * 20
    (folder / "part-packed.arc.gz").write_bytes(archives.packed(v2) + bytes(broken) + archives.packed(more) + b"\n")
    scratch = Scratch(spark, "t5")
    archives.arc_to_warc(spark, str(folder), scratch.path("warc"), scratch, 1000, 1 << 20)
    records = []
    for r in archives.read_files(spark, scratch.path("warc")).collect():
        members = list(archives.unpacked(bytes(r.content)))
        assert all(m.count(b"WARC/1.0\r\n") == 1 for m in members)  # one record a member
        records += list(archives.read_warc(members))
    found = sorted((h["WARC-Target-URI"], h["WARC-Type"], h.get("WARC-IP-Address"), h["Content-Type"]) for h, _ in records if h["WARC-Type"] != "warcinfo")
    http = "application/http; msgtype=response"
    assert found == sorted(
        [(f"http://g/{i}", "response", "10.0.0.7", http) for i in range(4)]
        + [("http://s/a b c", "resource", "10.0.0.8", "text/plain"), ("dns:x.org", "resource", "10.0.0.1", "text/dns"), ("http://v2/", "response", None, http)]
        + [("http://g/1", "response", "10.0.0.7", http)]
    )
    assert {r.fault: r.n for r in archives.arc_faults(spark, str(folder)).collect()}.keys() >= {"cut off", "length does not fit", "damaged gzip member"}
    v2_headers = next(h for h, _ in records if h.get("WARC-Target-URI") == "http://v2/")
    assert v2_headers["WARC-X-ARC-Result-code"] == "200" and v2_headers["WARC-X-ARC-Filename"] == "b"
    assert any(b"arc-version-block" in b and b"2 0 lorewright" in b for h, b in records if h["WARC-Type"] == "warcinfo")
