"""A corpus made ready for training: toxic documents, near copies and benchmark passages go, personal data is masked, the rest is tokenized.

Every stage takes the documents that its predecessor kept and reads each of them whole. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurifit.functions.sizing import broadcast_if_small
from plurifit.llm import byte_bpe, contamination, jaccard, pii, toxicity
from plurifit.llm.common import documents, table, use_package
from plurifit.session import materialise, settings

BROADCAST_KEYS = 1_000_000
# Whole texts travel to Python a few at a time: what executors and workers hold of them does not grow with the rows of a batch.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written out under ``SETTINGS``, which do not reach frames that a stage's caller runs later."""
    with settings(df.sparkSession, SETTINGS):
        return materialise(df, name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score reaches the threshold. Rows with null or empty texts stay.

    A model that saw no example of both classes cannot tell documents apart, so then all of them stay.
    """
    weights, bias, n_clean, n_toxic = toxicity.fit_counted(docs, table(spark, sf_dir, "labels"))
    if not (n_clean and n_toxic):
        return docs
    scored = toxicity.score(docs, weights, bias, keep=docs.columns)
    kept = scored.filter((F.col("_predicted_") == 0) | (F.coalesce(F.length("text"), F.lit(0)) == 0)).select(docs.columns)
    return stored(kept, "not-toxic")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least key. Rows without a key and rows that repeat the kept key stay."""
    use_package(spark)
    groups = jaccard.near_duplicates(docs)
    gone = materialise(groups.filter("component_id < doc_id").select("doc_id").distinct(), "copies")
    return docs.join(broadcast_if_small(gone, BROADCAST_KEYS), "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold half or more of a benchmark item. The text decides, so rows without a key are judged too."""
    digest = F.xxhash64("text")
    found = contamination.contaminated(docs.withColumn("_digest_", digest), table(spark, sf_dir, "benchmark"), key="_digest_")
    gone = stored(found.select("_digest_").distinct(), "contaminated")
    return docs.withColumn("_digest_", digest).join(broadcast_if_small(gone, BROADCAST_KEYS), "_digest_", "left_anti").select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the new text. Null texts stay null."""
    use_package(spark)
    masked = pii.find(docs, keep=docs.columns, masked="_masked_")
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("_masked_"))
    made = {"text": text, "n_chars": F.when(F.col("n_chars").isNotNull(), F.length(text).cast("long"))}
    return stored(masked.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns]), "masked")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every remaining document and the digests of its ids and of the bytes they decode to."""
    use_package(spark)
    return stored(byte_bpe.encode_decode(docs), "tokenized")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("byte_bpe", tokenize),
]

#: Learned scores and spans and byte-pair merges are not SQL; the pipeline is tested by stage on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
