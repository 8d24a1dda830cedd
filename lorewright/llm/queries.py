"""The registered queries of this package: one function for each operator, and the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..scratch import Scratch
from ..session import table
from .archives import ARCHIVE_SQL, archive_report
from .conversation_trie import TRIE_SQL, prefix_trie
from .decontaminate import LEAK_SQL, leaks
from .fill_in_middle import FIM_SQL, fill_in_middle
from .html_extract import extract_text
from .licences import scan, scan_sql
from .line_dedup import LINE_SQL, line_report
from .minhash_join import minhash_components
from .mixing import mix
from .overlap_join import overlap_components
from .quality_rules import QUALITY_SQL, judge
from .token_counts import token_counts
from .url_rules import judge_urls


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that each document is, and those that its lines grant."""
    return scan(table(spark, sf_dir, "documents"), Scratch(spark, "op1"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, explicit rule and verdict of every page's URL."""
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), Scratch(spark, "op2"))


def op3_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` over 4-word shingles at similarity 0.8."""
    return minhash_components(table(spark, sf_dir, "documents"), Scratch(spark, "op3"), k=4, percent=80)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(table(spark, sf_dir, "pages"), Scratch(spark, "op4"))


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as ARC files, converted to WARC, and read back."""
    return archive_report(table(spark, sf_dir, "pages"), Scratch(spark, "op5"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document contains."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op7"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base columns and verdict of every document."""
    return judge(table(spark, sf_dir, "documents"), Scratch(spark, "op8"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing common lines leaves of every document."""
    return line_report(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and mixing rate of every document."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op10"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts, form and digests of every document as fill-in-middle text."""
    return fill_in_middle(table(spark, sf_dir, "documents"), digests=True)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"), Scratch(spark, "op12"))


def op13_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` linked by exact Jaccard similarity of 5-word shingles."""
    return overlap_components(table(spark, sf_dir, "documents"), Scratch(spark, "op13"), k=5, percent=80)


QUERIES = {
    f.__name__: f
    for f in (
        op1_licence_scan,
        op2_url_rules,
        op3_minhash_components,
        op4_html_text,
        op5_arc_to_warc,
        op6_token_counts,
        op7_benchmark_leaks,
        op8_quality_rules,
        op9_line_dedup,
        op10_mixing,
        op11_fill_in_middle,
        op12_prefix_trie,
        op13_overlap_join,
    )
}

ORACLES: dict[str, str] = {
    "op1_licence_scan": scan_sql(),
    "op5_arc_to_warc": ARCHIVE_SQL,
    "op7_benchmark_leaks": LEAK_SQL,
    "op8_quality_rules": QUALITY_SQL,
    "op9_line_dedup": LINE_SQL,
    "op11_fill_in_middle": FIM_SQL,
    "op12_prefix_trie": TRIE_SQL,
}
