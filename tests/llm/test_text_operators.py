"""Line dedup, quality rules, licences, token counts, decontamination and mixing on small tables."""

import hashlib
import math
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lorewright.llm import decontaminate, licences, line_dedup, mixing, quality_rules, token_counts
from lorewright.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row string"
WS = " \t\n\x0b\f\r"


def frame(spark, texts, langs=("en",), sources=("s",)):
    rows = [(i, t, langs[i % len(langs)], sources[i % len(sources)], len(t or ""), "k", "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def test_line_dedup(spark):
    rnd = random.Random(4)
    common = ["Cookie Notice", " cookie notice\t", "ÉTÉ", "été", "", "only nine"]
    texts = [None, "", "\n", "\n\nx\n", "Cookie notice"] + ["\n".join(rnd.choices(common[:5] + [f"l{i}" for i in range(200)], k=rnd.randint(1, 8))) for _ in range(80)]
    texts += ["only nine"] * 9 + ["long " * 50_000 + "\nCookie Notice"]
    count = Counter(k for t in texts for k in {lower(x.strip(WS)) for x in (t or "").split("\n")} if k)
    expected = {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[lower(x.strip(WS))] < 10]
        expected[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    df = frame(spark, texts)
    for limit in (1_000_000, 0):  # looked up where texts are read, and joined
        out = line_dedup.line_report(df, Scratch(spark, "t9"), broadcast_keys=limit)
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in out.collect()} == expected
        clean = line_dedup.clean_rows(df, Scratch(spark, "t9"), broadcast_keys=limit)
        assert clean.columns == df.columns
        assert {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in clean.collect()} == {i: e[2] for i, e in expected.items()}
    repeated = spark.createDataFrame([(None, "a\nrow")] * 5 + [(1, "a\nrow")] * 5, "doc_id long, text string")  # each row is a document
    assert {r.kept_sha256 for r in line_dedup.line_report(repeated, Scratch(spark, "t9")).collect()} == {hashlib.sha256(b"").hexdigest()}
    assert line_dedup.line_report(df.where("false"), Scratch(spark, "t9")).count() == 0


def base(text):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split(" ") if x]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.strip(WS)]
    n_symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return len(w), sum(map(len, w)), n_symbols, len(lines) - len(set(lines)), len(inside), failed


def test_quality_base_and_limits(spark):
    rnd = random.Random(8)
    words = [f"wort{i}" for i in range(300)]
    texts = [None, "", " \n\t ", "a b c d e " * 40, "x" * 100_000]
    for _ in range(150):
        line = " ".join(rnd.choices(words, k=rnd.randint(5, 30)))
        texts.append("\n".join([line, *[" ".join(rnd.choices(words, k=12)) for _ in range(rnd.randint(0, 4))], *([line] if rnd.random() < 0.1 else [])]))
    junk = len(texts)
    texts.append(" ".join(w + "$$$" for w in rnd.choices(words, k=60)))
    texts.append(" ".join(w.upper() + "!!" for w in rnd.choices(words, k=60)))
    out = quality_rules.judge(frame(spark, texts, ("en", None)), Scratch(spark, "t8"))
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), i
        assert r.kept == (not r.base_failed and i < junk and r.n_dup_lines <= 1), i
    kept = quality_rules.keep_good(frame(spark, texts, ("en", None)), Scratch(spark, "t8"))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality_rules.judge(frame(spark, texts).where("false"), Scratch(spark, "t8")).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_licences(spark):
    texts = [
        None, "", MIT, "Copyright (c) 2020 Somebody\n\n" + MIT.upper(), MIT.replace(" ", "\n\n  "), MIT + " and more",
        "Prose.\nReleased under the MIT Licence!\nMore.", "LICENSED UNDER CC BY-NC 4.0", "© 2021 X\nThis work is licensed under the GNU General Public License, version 3", "prose " * 50_000,
        "MIT License\n\nCopyright (c) 2021 A B\n\n" + MIT, "The MIT License (MIT)\n=====================\n\nCopyright (c) 2015 X\n" + MIT, MIT.replace("sublicense", "sub-license"),
        MIT.replace("COPYRIGHT HOLDERS", "copyright owners").replace("sublicense", "sub license"), "MIT License", MIT, "\n" * 200 + "# MIT License\n" + MIT,
    ]
    rows = frame(spark, texts).union(frame(spark, [MIT]).selectExpr("null as doc_id", "text", *frame(spark, []).columns[2:]))
    got = {r.doc_id: (r.licence, r.line_licences) for r in licences.scan(rows, Scratch(spark, "t1")).collect()}
    assert got == {
        0: (None, ""), 1: (None, ""), 2: ("MIT", ""), 3: ("MIT", ""), 4: ("MIT", ""), 5: (None, ""),
        6: (None, "MIT"), 7: ("CC-BY-NC-4.0", "CC-BY-NC-4.0"), 8: ("GPL-3.0-only", "GPL-3.0-only"), 9: (None, ""),
        10: ("MIT", ""), 11: ("MIT", ""), 12: ("MIT", ""), 13: ("MIT", ""), 14: (None, ""), 15: ("MIT", ""), 16: ("MIT", ""), None: ("MIT", ""),
    }
    assert licences.scan(frame(spark, texts).where("false"), Scratch(spark, "t1")).count() == 0
    own = licences.digest_table(spark.createDataFrame([("Own", "1. Do as you like.\n2. Or not.")], "licence string, text string"))
    got = licences.scan(frame(spark, ["* Do as\nyou like\n* or NOT", MIT]), Scratch(spark, "t1"), own).collect()
    assert [r.licence for r in sorted(got, key=lambda r: r.doc_id)] == ["Own", None]


FSFAP = "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty."


def test_long_lines_and_licences_of_one_digest(spark):
    """A licence in one long line among others, by the known table and a caller's; the first name where two have one digest."""
    line = " ".join(f"w{i}" for i in range(60))
    rows = frame(spark, [f"Prose.\n{FSFAP}\nMore.", FSFAP, f"{line}\nand more"])
    got = {r.doc_id: (r.licence, r.line_licences) for r in licences.scan(rows, Scratch(spark, "t1")).collect()}
    assert got == {0: (None, "FSFAP"), 1: ("FSFAP", "FSFAP"), 2: (None, "")}
    own = spark.createDataFrame([(n, licences.digest(licences.canonical_line(line))) for n in ("Second", "First")], "licence string, digest string")
    for most in (200_000, 0):
        got = {r.doc_id: r.line_licences for r in licences.scan(rows, Scratch(spark, "t1"), own, broadcast_digests=most).collect()}
        assert got == {0: "", 1: "", 2: "First"}


def test_licence_texts_of_this_machine():
    folder = "/usr/share/common-licenses"
    for name, licence in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if os.path.exists(f"{folder}/{name}"):
            with open(f"{folder}/{name}", encoding="utf-8") as f:
                text = f.read()
            for form in (text, text.upper(), "Copyright 2020 Someone\n" + text.replace("\n", "\r\n")):
                assert licences.digest(licences.canonical(form)) in licences.KNOWN_DIGESTS[licence]
    assert len(licences.KNOWN_DIGESTS) >= 25


def test_token_counts_equal_the_library(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rnd = random.Random(6)
    odd = "\x1c\x1d\x85\u00a0\u2028\u3000\u200b ½²٣中文字 é😀'S'ss don't I'LL \r\n\t  _-—\u0301ǅ\x00"
    texts = [None, "", " ", "\n\n  x", "a<|endoftext|>b <|endoftext|>", "<|endoftext|>", "hello  world   again\n\n\n  and 123 4567", odd, odd * 3, "y" * 3000]
    texts += ["".join(rnd.choices(odd + "abc  12 ", k=40)) for _ in range(300)] + ["the cat sat on the mat. " * 4000]
    tokenizer = Tokenizer.from_file(path)
    expected = {i: (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    for table_size, more in ((30_000, {}), (3, {"cache_bytes": 900, "encode_rows": 2, "slice_chars": 50, "longest": 4})):
        out = token_counts.token_counts(frame(spark, texts), path, table_size=table_size, **more).collect()
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in out} == expected
        assert all(r.over_limit == (r.n_tokens > 1024) for r in out)
    assert token_counts.token_counts(frame(spark, texts).where("false"), path).count() == 0


def test_first_tier_comes_from_rows_of_every_partition(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["x" * 300_000 + " start" * 50] + [f" word{i % 7}" * 3 for i in range(400)] + [" last" * 40] * 3
    tier = token_counts.frequent_lengths(frame(spark, texts), path, 404, 30_000, 64)
    assert " start" in tier and " last" in tier and " word" in tier and max(map(len, tier)) <= 64
    assert len(token_counts.frequent_lengths(frame(spark, texts), path, 404, 2, 64)) == 2
    assert token_counts.frequent_lengths(frame(spark, texts).where("false"), path, 10, 10, 64) == {}


def windows(text, k=5):
    w = lower(text or "").split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_decontamination(spark):
    rnd = random.Random(7)
    v = [f"v{i}" for i in range(500)]
    items = [" ".join(rnd.choices(v, k=n)) for n in (3, 4, 5, 6, 9, 20, 35, 80, 200)] + ["", None, "v1"]
    texts = [None, "", "v2 v3"]
    for _ in range(120):
        body = rnd.choices(v, k=rnd.randint(1, 300))
        if rnd.random() < 0.6:
            piece = (rnd.choice(items) or "").upper().split()
            for _ in range(rnd.randint(0, 3)):
                if piece:
                    piece[rnd.randrange(len(piece))] = rnd.choice(v)
            at = rnd.randrange(len(body))
            body[at:at] = piece
        texts.append(" ".join(body))
    expected = set()
    for i, t in enumerate(texts):
        for j, b in enumerate(items):
            w = (lower(b or "")).split()
            mine, whole = windows(b), (windows(t) if len(w) >= 5 else windows_of(t, len(w)))
            if mine and 100 * len(mine & whole) >= 80 * len(mine):
                expected.add((i, j, len(mine), len(mine & whole)))
    texts += [" ".join(rnd.choices(v, k=60_000)) + " " + (items[8] or "")] + ["x y z " + (items[6] or "")] * 20  # a very long text, copies
    for i in range(len(texts) - 21, len(texts)):
        for j, b in enumerate(items):
            w = lower(b or "").split()
            mine, whole = windows(b), (windows(texts[i]) if len(w) >= 5 else windows_of(texts[i], len(w)))
            if mine and 100 * len(mine & whole) >= 80 * len(mine):
                expected.add((i, j, len(mine), len(mine & whole)))
    b = spark.createDataFrame([*enumerate(items), (8, items[8]), (None, items[8])], "item_id long, text string")
    df = frame(spark, texts)
    assert {tuple(r) for r in decontaminate.leaks(df, b, Scratch(spark, "t7"), probes=3).collect()} <= expected
    got = {tuple(r) for r in decontaminate.leaks(df, b, Scratch(spark, "t7")).collect()}
    assert got == expected and len(expected) > 30
    clean = decontaminate.clean(df, b, Scratch(spark, "t7"))
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {e[0] for e in expected}
    assert decontaminate.leaks(df, b.where("false"), Scratch(spark, "t7")).count() == 0
    assert decontaminate.clean(df.where("false"), b, Scratch(spark, "t7")).count() == 0


def test_items_of_one_id_are_one(spark):
    v = [f"v{i}" for i in range(40)]
    b = spark.createDataFrame([(1, " ".join(v[:20])), (1, " ".join(v[20:]))], "item_id long, text string")
    texts = [" ".join(v[:20]), " ".join([*v[:20], "and", *v[20:]]), " ".join(v[:20]) + " and " + " ".join(v[20:34])]
    got = {tuple(r) for r in decontaminate.leaks(frame(spark, texts), b, Scratch(spark, "t7")).collect()}
    assert got == {(1, 1, 32, 32), (2, 1, 32, 26)}  # 26 of 32 shingles are 81 %


def windows_of(text, k):
    w = lower(text or "").split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def test_mixing_meets_its_targets(spark):
    rnd = random.Random(10)
    v = [f"v{i}" for i in range(300)]
    texts, labels = [None, ""], []
    for i in range(2, 400):
        kind = rnd.choices(("good", "poor", "toxic"), (0.6, 0.3, 0.1))[0]
        extra = {"good": [], "poor": ["cheap", "click"], "toxic": ["idiot", "moron"]}[kind]
        texts.append(" ".join(rnd.choices(v, k=rnd.randint(20, 80)) + extra * 6))
        if i % 2:
            labels.append((i, 0 if kind == "poor" else 1, 1 if kind == "toxic" else 0))
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mix(frame(spark, texts), lab, Scratch(spark, "t10"), steps=40).toPandas()
    assert len(out) == len(texts) and (out.rate >= 0).all()
    total = out.n_words.sum()
    for name, target in zip(mixing.DOMAINS, mixing.TARGETS, strict=True):
        share = (out.n_words / total * out.rate * out[f"p_{name}"]).sum()
        assert math.isclose(share, target, abs_tol=0.01), name
    held_out = [(i, t) for i, t in enumerate(texts) if i > 1 and i % 2 == 0]
    p = dict(zip(out.doc_id, out.p_toxic, strict=True))
    right = sum((p[i] > 0.5) == ("idiot" in t) for i, t in held_out)
    assert right / len(held_out) > 0.95
    assert mixing.mix(frame(spark, texts), lab.where("false"), Scratch(spark, "t10"), steps=3).count() == len(texts)
    assert mixing.mix(frame(spark, texts).where("false"), lab, Scratch(spark, "t10"), steps=3).count() == 0
    copies = out.copies.sum() / out.rate.sum()
    assert 0.9 < copies < 1.1


@pytest.mark.parametrize(("poor", "toxic"), [(0.3, 0.002), (0.3, 0.0005), (0.3, 0.0001), (0.001, 0.1)])
def test_mixing_meets_its_targets_on_rare_domains(spark, monkeypatch, poor, toxic):
    n = 20_000
    kind = F.when(F.col("doc_id") < n * toxic, 2).when(F.col("doc_id") < n * (toxic + poor), 1).otherwise(0)
    p = F.array(*[F.when(kind == i, 0.9998).otherwise(0.0001) for i in range(3)])
    monkeypatch.setattr(mixing, "fit_domains", lambda *_: None)
    monkeypatch.setattr(mixing, "posteriors", lambda docs, _: docs.select("*", F.lit(10.0).alias("_tokens"), p.alias("_p")))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    out = mixing.mix(docs, None, Scratch(spark, "t10"))
    got = out.agg(F.min("rate"), *[F.sum(F.col("rate") * F.col(f"p_{d}")) / n for d in mixing.DOMAINS]).first()
    assert got[0] >= 0
    for share, target in zip(got[1:], mixing.TARGETS, strict=True):
        assert math.isclose(share, target, abs_tol=2e-4)


def test_mixing_reports_what_it_cannot_meet(spark, caplog):
    mixing.mix(frame(spark, ["one good text"] * 3), spark.createDataFrame([], "doc_id long, quality int, toxic int"), Scratch(spark, "t10"))
    assert "missed by up to 0.09" in caplog.text


def test_rates_equal_plain_least_squares(spark):
    """The fitted rates against projected gradient steps over all documents, on any posteriors."""
    import numpy as np

    rnd = np.random.default_rng(8)
    p = rnd.dirichlet([4, 1, 0.3], 300)
    w = rnd.integers(1, 200, 300).astype(float)
    rows = spark.createDataFrame([(i, float(n), [float(x) for x in q]) for i, (n, q) in enumerate(zip(w, p, strict=True))], "key long, _tokens double, _p array<double>")
    targets, ridge = (0.5, 0.45, 0.05), 1e-2
    out = mixing.fit_rates(rows, targets, ridge, steps=64, tolerance=2e-4).collect()
    got = np.array([r.rate for r in sorted(out, key=lambda r: r.key)])
    share = w / w.sum()
    ridge *= (share[:, None] * p).sum(axis=0).min()
    rate = np.ones(300)
    for _ in range(20_000):
        slope = p @ ((share * rate) @ p - np.array(targets)) + ridge * (rate - 1)  # of each document, by its weight
        rate = np.maximum(0, rate - 0.9 * slope)
    assert np.abs(got - rate).max() < 1e-3 and got.min() == 0


def test_copies_of_a_text_are_rounded_apart(spark):
    rows = [(i, "one and the same text of several words") for i in range(400)] + [(1000 + i, f"other words number {i} here") for i in range(100)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(1000 + i, 0, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string"), labels, Scratch(spark, "t10"), targets=(0.5, 0.45, 0.05)).where("doc_id < 1000").collect()
    assert len({round(r.rate, 9) for r in out}) == 1 and len({r.copies for r in out}) == 2
    assert abs(sum(r.copies for r in out) / 400 - out[0].rate) < 0.1


def test_repeated_rows_ties_and_limits(spark):
    """Ratios on the limit are fine, repeated rows get equal results, a text of exactly the limit is not over it."""
    plain = "a b c d e f g h i j k l"
    rows = [(i, plain + (" ##" if i == 99 else ""), "en", "s") for i in range(100)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality_rules.judge(df, Scratch(spark, "t8")).collect()
    assert len(got) == 200 and {(r.doc_id, r.kept) for r in got} == {(i, i != 99) for i in range(100)}
    on_limit = [(i, "x" * 9 + " " + " ".join("abcdefghij") + (" #" if i == 99 else ""), "en", "s") for i in range(100)]
    share = 1 / 20  # 1 of 20 characters, below the least distance of 0.1
    assert share < quality_rules.FLOORS["symbol_ratio"]
    assert all(r.kept for r in quality_rules.judge(spark.createDataFrame(on_limit, df.schema), Scratch(spark, "t8")).collect())
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = token_counts.token_counts(df.select("doc_id", "text"), path).collect()
    n = next(r.n_tokens for r in out if r.doc_id == 0)
    assert len(out) == 200 and not any(r.over_limit for r in token_counts.token_counts(df.where("doc_id = 0"), path, limit=n).collect())
    assert all(r.over_limit for r in token_counts.token_counts(df.where("doc_id = 0"), path, limit=n - 1).collect())


def test_mixing_of_long_and_repeated_rows(spark):
    long = "fine words " * 60_000
    rows = [(i, f"good text number {i} of many") for i in range(40)] + [(100, long), (100, long), (None, "odd one")] + [(200 + i, f"bad cheap click {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(200 + i, 0, 0) for i in range(30)] + [(5, 1, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string"), labels, Scratch(spark, "t10"), targets=(0.8, 0.19, 0.01)).collect()
    assert len(out) == len(rows) and {r.n_words for r in out if r.doc_id == 100} == {120_000}
    assert len({r.rate for r in out if r.doc_id == 100}) == 1 and all(r.rate >= 0 for r in out)
