"""Book structure and graph rules against plain Python."""

import random

from lorewright.operators import books as B
from lorewright.operators import graph as G
from lorewright.operators import structure as S


def test_best_increasing_against_all_subsets():
    rnd = random.Random(4)
    for _ in range(60):
        n = rnd.randint(1, 9)
        lines, confidence = [rnd.randint(1, 12) for _ in range(n)], [rnd.choice([0.1, 0.5, 0.9]) for _ in range(n)]
        chains = [c for m in range(1, 1 << n) for c in [[i for i in range(n) if m >> i & 1]] if all(lines[a] < lines[b] for a, b in zip(c, c[1:], strict=False))]
        best = max((len(c), round(sum(confidence[i] for i in c), 9)) for c in chains)
        got = B.best_increasing(lines, confidence)
        assert got in chains and (len(got), round(sum(confidence[i] for i in got), 9)) == best


def test_greedy_blocks_by_example():
    rows = [("a", "Intro", 1, 10, 0.5), ("b", "Intro", 2, 10, 0.9), ("c", "Other", 2, 10, 0.9), ("d", "Intro", 30, 40, 0.1), ("d", "x", 50, 60, 0.2)]
    assert B.greedy_blocks(rows) == [("b", "Intro", 2, 10, 0.9), ("c", "Other", 2, 10, 0.9), ("d", "x", 50, 60, 0.2)]


def test_merged_images(spark):
    items = [("a", None, ""), ("", 3, "c3"), ("a", 3, "late"), (None, 3, ""), ("b", 4, "x"), ("b", 5, None)]
    assert G.merge_in_order(items) == [("a", 3, "late"), ("", 3, "c3"), ("b", 4, "x")]
    rnd = random.Random(6)
    rows = [(k, i, rnd.choice(["", "p", "q", None]), rnd.choice([None, 1, 2]), rnd.choice(["", "cap"])) for k in range(40) for i in range(6)]
    df = spark.createDataFrame(rows, "chunk long, at long, path string, line_no long, caption string").repartition(3)
    got = sorted(map(repr, (tuple(r) for r in G.merged_images(df, "chunk", ["at"], ["path", "line_no", "caption"]).collect())))

    def plain(items):
        """Groups of positions first, then the first filled value of each field."""
        groups, names = [], []
        for i, (path, line, _) in enumerate(items):
            lines = [next((items[j][1] for j in g if items[j][1] is not None), None) for g in groups]
            at = [g for g in range(len(groups)) if (path and names[g] == path) or (line is not None and lines[g] == line)]
            if at:
                groups[at[0]].append(i)
            else:
                groups.append([i])
                names.append(path)
        first = lambda values: next((v for v in values if v not in (None, "")), values[0])
        return [tuple(first([items[i][f] for i in g]) for f in range(3)) for g in groups]

    expected = sorted(repr((k, *m)) for k in range(40) for m in plain([r[2:] for r in rows if r[0] == k]))
    assert got == expected


def test_candidates(spark):
    lines = [(1, 1, "# CHAPTER 3"), (1, 2, ""), (1, 3, "# Forces"), (1, 4, "3.1 Weight"), (1, 5, "long " * 30), (1, 6, "12."), (1, 7, "# 4 More"), (1, 8, "第 5 章 Heat"), (2, 1, "第 1 章 A"), (2, 2, "# B")]
    df = spark.createDataFrame(lines, "doc_id long, line_no long, text string")
    got = {(r.doc_id, r.line_no): (r.priority, r.text) for r in S.candidates(df).collect()}
    assert got[(1, 1)] == (40, "# CHAPTER 3") and got[(1, 3)][0] == 30 and got[(1, 4)][0] == 20 and got[(1, 8)][0] == 40
    assert (1, 5) not in got and (1, 6) not in got and (1, 2) not in got
    assert got[(2, 1)] == (40, "第 1 章 A | # B")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, line_no long, text string")
    assert S.candidates(none).count() == 0
    c = spark.createDataFrame([], "doc_id long, catalog_index long, level long, start long, last long")
    assert S.structure_plan(c, none).count() == 0
