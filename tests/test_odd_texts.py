"""Queries against their SQL twins on texts that the given tables lack."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lorewright.functions.text import first_line
from lorewright.plans.registry import ORACLES, QUERIES
from verify import normal

TEXTS = ("12 34", "", "...", "é ñ", None, "日本", "A b", " c ")


@pytest.mark.parametrize("name", ["st16_clean_outputs", "st18_choice_lines"])
def test_texts_without_letters(spark, tmp_path, name):
    rows = [(i, TEXTS[i // 12]) for i in range(12 * len(TEXTS))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert normal(QUERIES[name](spark, str(tmp_path)).toPandas()) == normal(db.execute(ORACLES[name]).df())


ENDS = ("", " ", "a ", " c ", 'a "', "'", "‘a’ ", "a\n", "a \nb", "\t", None, "a b")


def test_first_lines_without_spaces_at_the_ends(spark, tmp_path):
    spark.createDataFrame([(i, "en", ENDS[i // 12]) for i in range(12 * len(ENDS))], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert normal(QUERIES["st47_first_line"](spark, str(tmp_path)).toPandas()) == normal(db.execute(ORACLES["st47_first_line"]).df())
    said = {'" a b " \nmore': "a b", "“ x”": "x", "plain ": "plain", '"': ""}
    rows = spark.createDataFrame(list(enumerate(said)), "i long, t string").select("i", first_line(F.col("t")).alias("out")).orderBy("i").collect()
    assert [r.out for r in rows] == list(said.values())


def test_questions_of_texts_with_other_white_space(spark, tmp_path):
    texts = ("a\x0b", "\x0ba", "a\x0bb", "a\x0b b", "a\u00a0", "\u3000a", "a \u2003", "\u205fa\u00a0 (\u202f", "\x0b", "a\u3000b", "a\u0085", "a\u2028", "a (1) b", "\ta\f\r\n")
    spark.createDataFrame([(i, texts[i // 4]) for i in range(4 * len(texts))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert normal(QUERIES["st19_split_question"](spark, str(tmp_path)).toPandas()) == normal(db.execute(ORACLES["st19_split_question"]).df())


def test_sensitive_words_read_texts_once(spark, tmp_path):
    said = ["an idiot!", "idiots", "Ouan", "xOUANx", "CAFÉ", "idiot_", "idiot字", "(idiot)", "", None, "a seven b", "seventy", "不好的"]
    spark.createDataFrame([(i, t) for i, t in enumerate(said)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x y Seven"), (2, "x y seven z"), (3, "x y 好"), (4, "x"), (5, "x y  z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df = QUERIES["jn11_sensitive_words"](spark, str(tmp_path))
    assert normal(df.toPandas()) == normal(db.execute(ORACLES["jn11_sensitive_words"]).df()) and df.count() > 6
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not any("text#" in line for line in plan.split("\n") if "Join" in line) and "RLIKE" not in plan
