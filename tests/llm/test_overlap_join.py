"""The T-occurrence join against brute force on full sets."""

import random

import numpy as np
import pytest

from lorewright.llm.overlap_join import InvertedLists, overlap_components, overlap_roots
from lorewright.scratch import Scratch

from .test_minhash_join import brute, got

SCHEMA = "doc_id long, text string, key string, token long"


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary, rows = [f"w{i}" for i in range(500)], []

    def add(words):
        rows.append((len(rows), " ".join(words), "x", 1))

    for n in [*range(1, 14)] * 4 + [60] * 20:
        add(rnd.choices(vocabulary, k=n))
    base = rnd.choices(vocabulary, k=160)
    for _ in range(60):  # near copies, some beyond the threshold of others
        copy = list(base)
        for _ in range(rnd.randint(0, 5)):
            copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
        add(copy[: rnd.randint(125, 160)])
    for n in range(8, 60):  # each shares at least four fifths with its neighbours
        add(base[:n])
    for _ in range(40):  # a passage that many share
        add(rnd.choices(vocabulary, k=40) + base[:60] + rnd.choices(vocabulary, k=30))
    for _ in range(5):
        add(base)
    rows += [(len(rows), None, "x", 1), (len(rows) + 1, "", "x", 1), (len(rows) + 2, " \n\t", "x", 1), (len(rows) + 3, "Two Words", None, None), (len(rows) + 4, "two words", "x", 1)]
    return rows


@pytest.mark.parametrize("more", [{}, {"group_limit": 20, "rounds": 1}])
def test_equals_brute_force(spark, more):
    rows = corpus(4)
    assert got(overlap_components(spark.createDataFrame(rows, SCHEMA).repartition(3), Scratch(spark, "t13"), **more)) == brute(rows, 5)


def test_similarity_of_exactly_the_threshold_links(spark):
    words = [f"v{i}" for i in range(30)]
    rows = [(1, " ".join(words[:13]), "", 0), (2, " ".join(words[:12]), "", 0)]  # 8 of 9
    rows += [(3, " ".join(words[14:23]), "", 0), (4, " ".join(words[14:22]), "", 0)]  # 4 of 5
    rows += [(5, "a b c d e f g h", "", 0), (6, "a b c d e f g", "", 0)]  # 3 of 4
    assert got(overlap_components(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t13"))) == {1: (9, 1), 2: (8, 1), 3: (5, 3), 4: (4, 3), 5: (4, 5), 6: (3, 6)}


def test_search_finds_what_counting_finds():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 90, rnd.integers(1, 90)).astype(np.uint64)) for _ in range(80)]
    sets += [np.unique(np.concatenate([s[1:], s[-1:] + np.uint64(1)])) for s in sets[:60]]
    lists, everything = InvertedLists(sets, 80), np.ones(len(sets), bool)
    for s in sets:
        want = [i for i, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= 80 * len(np.union1d(s, o))]
        for mu in (0.0085, 1.0, 50.0):  # from most lists probed to all of them merged
            assert lists.similar(s, everything, mu).tolist() == want
    roots = overlap_roots(sets, 80)
    assert all(roots[i] <= i and roots[roots[i]] == roots[i] for i in range(len(sets)))


def test_drifting_group(spark):
    rnd = random.Random(1)
    words, rows = rnd.choices([f"w{i}" for i in range(5000)], k=100), []
    for i in range(300):
        rows.append((i, " ".join(words), "", 0))
        words[rnd.randrange(len(words))] = f"w{rnd.randrange(5000)}"
    for more in ({}, {"group_limit": 50}):
        assert got(overlap_components(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t13"), **more)) == brute(rows, 5)


def test_nulls_repeats_long_texts_and_empty_tables(spark):
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(50_000))
    rows = [(None, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1), (2, "A b c\nd e f", "x", 1), (3, None, "x", 1), (4, long, "", 1), (5, long + " tail", "", 1), (1, "another text of the same id", "", 1)]
    out = overlap_components(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t13")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in out if r.doc_id not in (4, 5)) == [(0, 2, 0), (1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert {r.component_id for r in out if r.doc_id in (4, 5)} == {4}
    assert overlap_components(spark.createDataFrame([], SCHEMA), Scratch(spark, "t13")).count() == 0
