"""The chosen-path join against brute force on full sets."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lorewright.llm.minhash_join import components, minhash_components
from lorewright.scratch import Scratch

SCHEMA = "doc_id long, text string, cid string, node long"


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k):
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    at = {i: i for i in sets}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("k", [4, 5])
def test_equals_brute_force(spark, k):
    rnd = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0

    def add(words):
        nonlocal n
        rows.append((n, " ".join(words), "x", 1))
        n += 1

    for _ in range(25):
        add(rnd.choices(vocabulary, k=rnd.randint(1, 60)))
    base = rnd.choices(vocabulary, k=120)
    for _ in range(30):  # a large group of near copies, some beyond the threshold of others
        copy = list(base)
        for _ in range(rnd.randint(0, 6)):
            copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
        add(copy)
    for _ in range(15):  # a passage that many share
        add(base[:12] + rnd.choices(vocabulary, k=40))
    for _ in range(5):
        add(base)
    rows += [(n, None, "x", 1), (n + 1, "", "x", 1), (n + 2, " \n\t", "x", 1), (n + 3, "Two Words", None, None), (n + 4, "two words", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for more in ({}, {"leaf": 6, "depth": 3, "group_limit": 8, "rounds": 1}) if k == 4 else ({"leaf": 5, "depth": 5},):
        assert got(minhash_components(df, Scratch(spark, "t3"), k=k, **more)) == brute(rows, k)


def test_large_group_that_drifts(spark):
    rnd = random.Random(1)
    words, rows = rnd.choices([f"w{i}" for i in range(5000)], k=100), []
    for i in range(400):  # one chain: neighbours are similar, far members share nothing
        rows.append((i, " ".join(words), "x", 1))
        words[rnd.randrange(len(words))] = f"w{rnd.randrange(5000)}"
    expected = brute(rows, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    for rounds in (3, 1):
        assert got(minhash_components(df, Scratch(spark, "t3"), k=4, group_limit=50, rounds=rounds)) == expected


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1), (2, "A b c\nd e f", "x", 1), (3, None, "x", 1)]
    out = minhash_components(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t3"), k=4).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert minhash_components(spark.createDataFrame([], SCHEMA), Scratch(spark, "t3")).count() == 0


def test_long_text(spark):
    text = " ".join(f"w{i * 7919 % 10007}" for i in range(60_000))
    rows = [(1, text, "x", 1), (2, text + " tail", "x", 1), (3, "short one here now", "x", 1)]
    assert got(minhash_components(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t3"), k=4)) == brute(rows, 4)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(200)]
    rnd = random.Random(1)
    names = list(range(2000))
    rnd.shuffle(names)
    edges = [(names[a], names[b]) for a, b in chain + star]
    df = spark.createDataFrame(edges, "a long, b long").select(*[F.col(c).cast("string").cast("binary").alias(c) for c in "ab"])
    groups = defaultdict(set)
    for r in components(df, Scratch(spark, "cc")).collect():
        groups[bytes(r.root)].add(int(bytes(r.node)))
    assert sorted(map(len, groups.values())) == [201, 301]
