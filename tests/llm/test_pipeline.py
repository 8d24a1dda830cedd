"""The five stages against brute force, each on its own input."""

import random

import pytest

from lorewright.llm import mixing
from tests.llm.test_minhash_join import brute
from tests.llm.test_text_operators import base, lower, windows, windows_of

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def rows_of(path, spark):
    return {r.doc_id: r for r in spark.read.parquet(path).collect()}


def test_stages(spark, tmp_path):
    rnd = random.Random(11)
    v = [f"wort{i}" for i in range(600)]
    items = [" ".join(rnd.choices(v, k=n)) for n in (12, 30)]
    rows = []

    def add(lines):
        text = "\n".join(" ".join(x) for x in lines)
        rows.append((len(rows), text, rnd.choice(["en", "de"]), rnd.choice(["a", "b"]), len(text)))

    for i in range(120):
        lines = [rnd.choices(v, k=rnd.randint(8, 20)) for _ in range(rnd.randint(2, 5))]
        if i % 5 == 0:
            lines.insert(1, ["the", "common", "line", "of", "all"])
        if i % 17 == 0:
            lines.append(rnd.choice(items).split())
        add(lines)
        if i % 10 == 0:
            add([*lines[:-1], lines[-1][:-1]])
            add(lines)
    add([[w + "$$$" for w in rnd.choices(v, k=40)]])
    add([["few", "words"]])
    rows += [(len(rows), None, "en", "a", None), rows[3]]
    sf = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, i % 3 != 0, i % 7 == 0) for i in range(100)], "doc_id long, quality boolean, toxic boolean").selectExpr("doc_id", "int(quality) quality", "int(toxic) toxic").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    current, inputs = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append({r.doc_id: r for r in current.collect()})
        out = stage(spark, current, sf)
        assert i == 4 or out.columns == docs.columns
        out.write.parquet(f"{sf}/out-{i}")
        current = spark.read.parquet(f"{sf}/out-{i}")
    outputs = [*inputs[1:], {r.doc_id: r for r in current.collect()}]

    passed = {i for i, r in inputs[0].items() if not base(r.text)[5]}
    assert set(outputs[0]) <= passed and len(passed - set(outputs[0])) == 1  # the document of symbols

    keys = {}
    for r in spark.read.parquet(f"{sf}/out-0").collect():
        for k in {lower(x.strip()) for x in r.text.split("\n")} - {""}:
            keys[k] = keys.get(k, 0) + 1
    for i, r in inputs[1].items():
        kept = "\n".join(x for x in r.text.split("\n") if keys.get(lower(x.strip()), 0) < 10)
        assert (outputs[1][i].text, outputs[1][i].n_chars) == (kept, len(kept))

    groups = brute([(i, r.text) for i, r in inputs[2].items()], 5)
    assert set(outputs[2]) == {i for i, (_, root) in groups.items() if i == root}
    assert spark.read.parquet(f"{sf}/out-2").count() == len(outputs[2])

    def leaks(text):
        return any(100 * len(windows(b) & (windows(text) if len(b.split()) >= 5 else windows_of(text, len(b.split())))) >= 80 * len(windows(b)) for b in items)

    assert set(outputs[3]) == {i for i, r in inputs[3].items() if not leaks(r.text)} != set(inputs[3])
    assert set(outputs[4]) == set(inputs[4])
    total = sum(r.n_words for r in outputs[4].values())
    for name, target in zip(mixing.DOMAINS, mixing.TARGETS, strict=True):
        assert abs(sum(r.n_words / total * r.rate * r[f"p_{name}"] for r in outputs[4].values()) - target) < 0.02


def test_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, digest string, at string"
    rnd = random.Random(5)
    v = [f"w{i}" for i in range(300)]
    long = " ".join(rnd.choices(v, k=40_000))
    rows = [(i, " ".join(rnd.choices(v, k=30)), "en", "a", 1, "r", "k", "d", "x") for i in range(20)]
    rows += [(50, long, None, None, None, None, None, None, None), (None, " ".join(rnd.choices(v, k=30)), "en", "a", 1, "r", "k", "d", "x"), (60, "", "en", "a", 0, "r", "k", "d", "x"), rows[3]]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "not in any text at all")], "item_id long, text string")
    for name, docs in (("odd", spark.createDataFrame(rows, schema)), ("empty", spark.createDataFrame([], schema))):
        sf = f"{tmp_path}/{name}"
        for table, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
            df.write.parquet(f"{sf}/{table}.parquet")
        current = spark.read.parquet(f"{sf}/documents.parquet")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, current, sf)
            assert i == 4 or out.columns == docs.columns
            out.write.parquet(f"{sf}/out-{i}")
            current = spark.read.parquet(f"{sf}/out-{i}")
        left = current.collect()
        assert not left if name == "empty" else sorted(r.doc_id if r.doc_id is not None else -1 for r in left) == [-1, *range(20), 50]
