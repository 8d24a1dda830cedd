"""Fill-in-middle text against plain Python on strings."""

import hashlib
import random
import re

from lorewright.llm.fill_in_middle import fill_in_middle

SCHEMA = "doc_id long, text string, n long, output string"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = TOKEN.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    rnd = random.Random(3)
    out = [(i, "".join(rnd.choices(["wörd", " ", "\n", "\t", "<P", "S>", "<", "🙂", "x", "\x0b\x0c", " ", "\0"], k=rnd.randint(0, 40))), 7, "own") for i in range(400)]
    out += [(1, None, 7, "own"), (2, "", 7, None), (None, "no id here", 7, "own"), (5, " \n ", 7, "own"), (9, "a <P> b", 7, "x"), (-3, "below zero", None, "x")]
    return out + out[:5]


def test_equals_plain_python(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    want = sorted(((i, *plain(i, t), t or "") for i, t, *_ in data), key=repr)
    for size in (4_000_000, 50):
        got = [tuple(r) for r in fill_in_middle(df, slice_bytes=size).collect()]
        assert sorted(got, key=repr) == want
    assert {x[2] for x in want} == {"plain", "spm", "psm"}


def test_digests_and_parameters(spark):
    data = rows()
    got = fill_in_middle(spark.createDataFrame(data, SCHEMA), seed=7, rate=100, spm=30, digests=True).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, *(w := plain(i, t, 7, 100, 30))[:4], sha(w[4]), sha(t or "")) for i, t, *_ in data]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_long_text_and_empty_table(spark):
    text = "lörem ipsum\n" * 200_000
    df = spark.createDataFrame([(i, text, 1, "") for i in range(4)], SCHEMA)
    assert sorted((r.doc_id, *r[1:6]) for r in fill_in_middle(df).collect()) == sorted((i, *plain(i, text)) for i in range(4))
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
