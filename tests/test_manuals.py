"""Captions, semantic pieces, anchors and plans against plain Python."""

import random
import time

from pyspark.sql import functions as F

from lorewright.functions import captions as C
from lorewright.operators.books import best_increasing
from lorewright.operators.semantic import semantic_pieces
from lorewright.operators.structure import candidate_scores, structure_plan, top_candidates


def test_captions(spark):
    rows = [
        ("图 3－2 轮轴 作者：王", "图3-2", "轮轴", "轮轴", "轮轴"), ("图1 - 1", "图1-1", None, "", None), ("A wheel by hand", None, "A wheel", "awheel", "A wheel"), ("nearby trees", None, "nearby trees", "nearbytrees", "nearby trees"),
        ("图片", None, None, "", None), ("0a1b2c3d4e", None, "0a1b2c3d4e", "0a1b2c3d4e", None), ("cut.JPG", None, "cut.JPG", "cutjpg", None), (None, None, None, "", None), ("：图注。", None, "图注", "图注", "图注"),
    ]
    df = spark.createDataFrame(rows, "raw string, no string, caption string, key string, alt string")
    for r in df.select("*", C.figure_number(F.col("raw")).alias("a"), C.caption_text(F.col("raw")).alias("b"), C.compare_key(F.col("raw")).alias("c"), C.meaningful_alt(F.col("raw")).alias("d")).collect():
        assert (r.a, r.b, r.c, r.d) == (r.no, r.caption, r.key, r.alt), r
    pairs = [("abc", "abc", True), ("abcdefgh", "abcdefghij", True), ("abcdefg", "abcdefghij", False), ("abcdefghijklmn", "abcdefghijklmo", True), ("abcdefghij", "abcdefghix", False), ("", "", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", C.captions_match(F.col("a"), F.col("b"))).collect())


def quadratic(lines, confidence):
    best, before = [], []
    for i, line in enumerate(lines):
        top, prev = (0, 0.0), -1
        for j in range(i):
            if lines[j] < line and best[j] > top:
                top, prev = best[j], j
        best.append((top[0] + 1, top[1] + confidence[i]))
        before.append(prev)
    end = max(range(len(best)), key=lambda i: (best[i], -i)) if best else -1
    out = []
    while end >= 0:
        out.append(end)
        end = before[end]
    return out[::-1]


def test_increasing_chain_equals_all_pairs():
    rnd = random.Random(5)
    for n in [*range(12)] * 20 + [200]:
        lines, confidence = [rnd.randint(1, 30) for _ in range(n)], [rnd.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(n)]
        assert best_increasing(lines, confidence) == quadratic(lines, confidence)
    began = time.time()
    assert len(best_increasing([rnd.randint(1, 10**6) for _ in range(100_000)], [0.5] * 100_000)) > 500
    assert time.time() - began < 20


def plain_plan(items, lines):
    """items: (level, start), lines: numbers of body lines."""
    out = []
    for i, (level, start) in enumerate(items):
        if start is None:
            continue
        rest = items[i + 1 :]
        close = next((j for j, (x, _) in enumerate(rest) if x <= level), len(rest))
        bound = next((s for _, s in rest[:close] if s is not None), None)
        if bound is None:
            bound = next((s for x, s in rest[close:] if s is not None and x <= level), None)
        end = 1000 if bound is None else bound - 1
        parent = bool(rest) and rest[0][0] > level
        scope = "leaf" if not parent else "direct" if any(start <= x <= end for x in lines) else "structural"
        out.append((i + 1, start, end, scope))
    return out


def test_structure_plan_equals_plain_python(spark):
    rnd, catalogs, bodies, want = random.Random(8), [], [], []
    for doc in range(40):
        items = [(rnd.randint(1, 5), rnd.choice([None, 10 * i + 5])) for i in range(rnd.randint(1, 30))]
        lines = rnd.sample(range(1, 320), rnd.randint(0, 20))
        catalogs += [(doc, i + 1, level, start, 1000) for i, (level, start) in enumerate(items)]
        bodies += [(doc, x, "text") for x in lines] + [(doc, 1, "# heading"), (doc, 6, "![image](x)"), (doc, 16, "  ")]
        want += [(doc, *r) for r in plain_plan(items, lines)]
    catalog = spark.createDataFrame(catalogs, "doc_id long, catalog_index long, level int, start long, last long")
    got = structure_plan(catalog, spark.createDataFrame(bodies, "doc_id long, line_no long, text string"))
    assert sorted((r.doc_id, r.catalog_index, r.start, r.end, r.scope) for r in got.collect()) == sorted(want)
    assert structure_plan(catalog.limit(0), spark.createDataFrame(bodies, "doc_id long, line_no long, text string")).count() == 0


def test_semantic_pieces(spark):
    x, y = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, i, x, 60) for i in range(4)] + [(1, 4 + i, y, 60) for i in range(4)] + [(1, 8, x, 60)] + [(2, i, [0.0, 0.0] if i == 1 else None if i == 2 else x, 200) for i in range(5)] + [(3, 0, y, 1)]
    got = {(r.doc, r.at): (r.piece, r.part) for r in semantic_pieces(spark.createDataFrame(rows, "doc long, at long, v array<float>, n long"), "doc", "at", "v", "n").collect()}
    pieces = [got[1, i][0] for i in range(9)]
    assert pieces == [0] * 4 + [1] * 5  # the last sentence is too short for a piece
    assert [got[2, i] for i in range(5)] == [(0, 0), (0, 0), (0, 0), (0, 1), (0, 1)] and got[3, 0] == (0, 0)


def test_repeated_title_pairs_are_compared_once(monkeypatch):
    import pandas as pd

    from lorewright.operators import books

    asked, real = [], books.ratio
    monkeypatch.setattr(books, "ratio", lambda a, b: asked.append((a, b)) or real(a, b))
    got = books.title_ratio.func(pd.Series(["ab", "ab", None, "ab"] * 5), pd.Series(["abc", "x", "x", "abc"] * 5))
    assert got.tolist() == [0.8, 0.0, 0.0, 0.8] * 5 and len(asked) == 3


def test_top_candidates_equal_all_pairs(spark):
    rnd = random.Random(4)
    words = ["轮", "轴", "wheel", "axle", "保养", "安全", "检查", "of", "the", "机"]
    title = lambda: (rnd.choice(["", "1.2 ", "3 ", "第4章 "]) + "".join(rnd.choices(words, k=rnd.randint(0, 4))))
    catalog = spark.createDataFrame([(d, i + 1, 12, title()) for d in range(6) for i in range(12)], "doc_id long, catalog_index long, n_items long, title string")
    kinds = ["chapter_group", "markdown_heading", "numbered_line", "short_title", "other"]
    found = spark.createDataFrame([(d, i + 1, rnd.choice(kinds), title()) for d in range(6) for i in range(40)], "doc_id long, line_no long, kind string, text string")
    spans = spark.createDataFrame([(d, 1, 40) for d in range(6)], "doc_id long, first long, last long")
    every = candidate_scores(catalog, found, spans).collect()
    for k in (1, 3, 100):
        want = []
        for item in {(r.doc_id, r.catalog_index) for r in every}:
            mine = sorted((r for r in every if (r.doc_id, r.catalog_index) == item), key=lambda r: (-r.score, r.line_no))
            want += [tuple(r) for i, r in enumerate(mine) if i < k or r.exact]
        assert sorted(map(tuple, top_candidates(catalog, found, spans, k).collect())) == sorted(want)


def test_similarities_that_columns_tell(spark):
    from pyspark.sql import functions as F

    from lorewright.operators import books, structure

    rnd = random.Random(6)
    titles = lambda: "".join(rnd.choices("ab.1车", k=rnd.randint(0, 6)))
    rows = [(titles(), titles()) for _ in range(600)] + [("1.aa", "2.aaa"), ("1.aa", "1.bbb"), ("1.aa", "2.b")]
    a, b = F.col("a"), F.col("b")
    within = F.contains(a, b) | F.contains(b, a)
    told = spark.createDataFrame(rows, "a string, b string").withColumn("n", structure._shared(a, b, within)).withColumn("known", structure._as_many(a, b, F.col("n"))).collect()
    for r in told:
        matched = books.ratio(r.a, r.b) * (len(r.a) + len(r.b)) / 2 if r.a or r.b else 0
        assert round(matched) == r.n if r.known else 1 <= matched <= r.n + 1e-9
    assert all(r.known for r in told[-3:]) and 0 < sum(r.known for r in told) < len(told)
    catalog = spark.createDataFrame([(1, 1, 1, "1.aa")], "doc_id long, catalog_index long, n_items long, title string")
    found = spark.createDataFrame([(1, 1, "other", "2.aaa")], "doc_id long, line_no long, kind string, text string")
    top = top_candidates(catalog, found, spark.createDataFrame([(1, 1, 1)], "doc_id long, first long, last long"), 2)
    assert top._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 2  # pairs are made once


def test_queries_equal_plain_python(spark, sf):
    """Order-dependent queries over a whole table, by another way of working them out."""
    from lorewright.plans.registry import QUERIES

    lines = spark.read.parquet(f"{sf}/lineitem.parquet").collect()
    orders = {}
    for r in lines:
        orders.setdefault(r.l_orderkey, []).append(r)
    got = {}
    for r in QUERIES["win13_consistent_anchors"](spark, sf).collect():
        got.setdefault(r.doc_id, []).append(r)
    for key, rows in orders.items():
        mine = sorted(((r.l_linenumber, r.l_partkey, r.l_discount) for r in rows))
        kept = set(quadratic([x[1] for x in mine], [x[2] for x in mine])) if len(mine) > 1 else {0}
        assert sorted((r.pos, r.line, r.confidence) for r in got[key] if r.kept) == sorted(x for i, x in enumerate(mine) if i in kept)
    blocks = {}
    for r in QUERIES["s15_unique_blocks"](spark, sf).collect():
        blocks.setdefault(r.doc_id, []).append((r.start, r.end, r.block_id, r.title, r.confidence))
    for key, rows in orders.items():
        kept = []
        spans = sorted((r.l_partkey % 50, r.l_partkey % 50 + int(r.l_quantity), str(r.l_linenumber), r.l_returnflag, r.l_discount) for r in rows)
        for new in spans:
            lengths = lambda old: min(new[1] - new[0], old[1] - old[0]) + 1  # noqa: B023, E731
            same = [i for i, old in enumerate(kept) if new[2] == old[2] or (new[3] == old[3] and (min(new[1], old[1]) - max(new[0], old[0]) + 1) / lengths(old) >= 0.7)]
            if not same:
                kept.append(new)
            elif (new[4], new[1] - new[0]) > (kept[same[0]][4], kept[same[0]][1] - kept[same[0]][0]):
                kept[same[0]] = new
        assert sorted(blocks[key]) == sorted(kept)
