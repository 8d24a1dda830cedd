"""Searches and term matching against brute force, over more queries and terms than one block holds."""

import random

import numpy as np

from lorewright.operators import retrieval as R
from lorewright.scratch import Scratch


def test_terms_in_text(spark, monkeypatch):
    rnd = random.Random(3)
    terms = [f"term{i:05d}" for i in range(2497)] + ["é", "ab", "TERM00007", ""]
    texts = [(i, " ".join(rnd.choices(terms, k=rnd.randint(0, 8))) + " Café") for i in range(60)] + [(100, None), (101, "")]
    df = spark.createDataFrame(texts, "id long, text string")
    listed = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "pos long, term string")
    expected = sorted((i, p) for i, t in texts for p, w in enumerate(terms) if w and t and w.lower() in t.lower())
    for block in (100_000, 600):
        monkeypatch.setattr(R, "TERM_BLOCK", block)
        got = R.terms_in_text(df, "id", "text", listed, "term", "pos", Scratch(spark, "t"))
        assert sorted((r.id, r.pos) for r in got.collect()) == expected
    assert R.terms_in_text(df, "id", "text", listed.where("false"), "term", "pos", Scratch(spark, "t")).count() == 0


def test_first_concept_prefers_names(spark):
    texts = spark.createDataFrame([(1, "Alpha beta"), (2, "gamma"), (3, "none")], "id long, text string")
    concepts = spark.createDataFrame([(3_000_000_000, "BETA", None), (1, "delta", "gamma"), (2, "other", "alpha")], "pos long, name string, alias string")
    got = R.first_concept(texts, "id", "text", concepts, Scratch(spark, "t")).collect()
    assert sorted((r.id, r.name, r.by) for r in got) == [(1, "BETA", "name"), (2, "delta", "alias")]


def test_first_concept_meets_repeated_terms_once(spark, monkeypatch):
    asked, real = [], R.terms_in_text
    monkeypatch.setattr(R, "terms_in_text", lambda *a: asked.append(a[3].collect()) or real(*a))
    texts = spark.createDataFrame([(i, "Alpha of beta") for i in range(3)], "id long, text string")
    concepts = spark.createDataFrame([(p, n, a) for p in range(50, 0, -1) for n, a in (("Beta", None), ("BETA", "alpha"), ("delta", "Alpha"))], "pos long, name string, alias string")
    got = R.first_concept(texts, "id", "text", concepts, Scratch(spark, "t")).collect()
    assert sorted((r.id, r.name, r.by) for r in got) == [(i, "BETA", "name") for i in range(3)]
    assert sorted(r.term for r in asked[0]) == ["alpha", "beta", "delta"]


def test_top_k_in_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    vectors = rnd.normal(size=(300, 8)).round(3)
    vectors[7] = 0
    vectors[20] = vectors[21] = vectors[22]
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900, None)], "id long, v array<double>").repartition(3)
    queries = rows.where("id % 5 = 0").selectExpr("id as query_id", "v as q")
    norms = np.maximum(np.sqrt((vectors**2).sum(axis=1)), 1e-10)
    expected = {}
    for q in range(0, 300, 5):
        score = np.round((vectors / norms[:, None]) @ (vectors[q] / norms[q]), 6)
        expected[q] = sorted(((-s, i) for i, s in enumerate(score)))[:4]
    for block in (2048, 7):
        monkeypatch.setattr(R, "QUERY_BLOCK", block)
        got = R.similarity_top_k(rows, "id", "v", queries, 4, Scratch(spark, "t")).collect()
        assert len(got) == 240
        assert {(r.query_id, r["rank"]): (r.id, r.score) for r in got} == {(q, n + 1): (i, -s) for q, best in expected.items() for n, (s, i) in enumerate(best)}
    assert R.similarity_top_k(rows, "id", "v", queries.where("false"), 4, Scratch(spark, "t")).count() == 0


def test_exact_percentiles(spark):
    from lorewright.operators.aggregates import exact_percentiles

    rnd = np.random.default_rng(2)
    groups = {"hot": np.concatenate([np.zeros(400), rnd.normal(size=600).round(2)]), "one": np.array([3.5]), "two": np.array([1.0, 2.0]), "few": rnd.integers(0, 4, 37).astype(float)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: tuple(r)[1:] for r in exact_percentiles(df, "g", "v", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 0.99, "e": 1.0}, splits=8).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert np.allclose(got[g], np.quantile(v, [0.0, 0.37, 0.5, 0.99, 1.0]))
