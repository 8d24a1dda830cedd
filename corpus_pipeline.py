"""A training corpus from ``documents``: five stages, each written and read again before the next.

Quality rules, line dedup, MinHash near-dedup, benchmark decontamination, and mixing to target
weights. Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept;
the first four return the columns of ``documents``, the last one the mixing rate of every document.

Every stage gives an empty table for an empty one, keeps rows with a null doc_id as documents of their
own, and passes further columns through untouched, whatever their names. Null and empty texts fail the
quality rules. Rows that repeat a doc_id and its text count as documents in the first two stages and
become one in the third. Very long texts are read whole throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorewright.llm import decontaminate, line_dedup, minhash_join, mixing, quality_rules
from lorewright.scratch import Scratch, temporary
from lorewright.session import let_workers_import, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, Scratch(spark, "pipeline-quality"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; every document stays."""
    return line_dedup.clean_rows(docs, Scratch(spark, "pipeline-lines"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8)."""
    let_workers_import(spark)
    return minhash_join.keep_one(docs, Scratch(spark, "pipeline-minhash"), k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "pipeline-leaks"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixing rate of every document; none goes."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), Scratch(spark, "pipeline-mixing"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixture),
]

#: MinHash components and the fitted classifier have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has written for itself goes when its result is written."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        with temporary():
            docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{i}")
        scratch.keep_only(f"stage-{i}")
    return docs
