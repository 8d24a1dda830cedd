"""Values that lie exactly on a threshold."""

from lorewright.llm import decontaminate, minhash_join, quality_rules
from lorewright.scratch import Scratch


def test_similarity_of_exactly_the_threshold_links(spark):
    w = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(w[:8])), (2, " ".join(w[:7])), (3, " ".join(w[10:17])), (4, " ".join(w[10:16]))]  # 4 of 5 shingles, 3 of 4
    rows += [(5, " ".join(w[20:33])), (6, " ".join(w[20:31]))]  # 8 of 10
    out = minhash_join.minhash_components(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t3"), k=4)
    assert {r.doc_id: r.component_id for r in out.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}


def test_containment_of_exactly_the_threshold_is_a_leak(spark):
    w = [f"w{i}" for i in range(30)]
    items = spark.createDataFrame([(1, " ".join(w[:14]))], "item_id long, text string")  # ten shingles of five words
    docs = spark.createDataFrame([(1, "before " + " ".join(w[:12]) + " after"), (2, "before " + " ".join(w[:11]) + " after")], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.leaks(docs, items, Scratch(spark, "t7")).collect()] == [1]


def test_ratio_of_exactly_the_limit_is_kept(spark):
    """99 documents without symbols: the limit is the least distance, a tenth of the characters."""
    plain = "xxxxxx a b c d e f g h i j k l"
    rows = [(i, plain, "en", "s") for i in range(98)] + [(98, plain + " ##", "en", "s"), (99, plain + " ###", "en", "s")]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), Scratch(spark, "t8")).collect()
    assert {r.doc_id for r in got if not r.kept} == {99}
    assert next(r.n_symbols / r.word_chars for r in got if r.doc_id == 98) == quality_rules.FLOORS["symbol_ratio"]
