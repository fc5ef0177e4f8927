"""The registered queries of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, contamination, html_text, jaccard, negatives, packing, pieces, pii, prefix_tree, quality, repeats, secrets, toxicity
from .common import documents, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return pieces.count_tokens(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures of every document and whether it is kept."""
    return quality.judge(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 200 bytes that occur more than once."""
    return repeats.remove_repeats(documents(spark, sf_dir))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and the digest of their ids and of the bytes they decode to."""
    return byte_bpe.encode_decode(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels that are not held out."""
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents."""
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item, whatever the order of its passages."""
    return contamination.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find(documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.find(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector."""
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document and the sequences they are packed into."""
    return packing.pack(documents(spark, sf_dir))


def op13_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the tree of shared conversation prefixes."""
    return prefix_tree.prefix_tree(table(spark, sf_dir, "conversations"))


_ALL = (
    op1_token_counts, op2_quality_rules, op3_suffix_dedup, op4_html_text, op5_byte_bpe, op6_toxicity, op7_jaccard_join, op8_decontamination, op9_pii,
    op10_secrets, op11_hard_negatives, op12_packing, op13_prefix_tree,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality.oracle()}
