"""Readers. Every schema is declared or checked; keys come from the source, never from row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prepare import labelled
from ..schema import FINGERPRINTS, REJECTS, REQUEST_COLUMNS, require_columns


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Share a frame out when its scan has fewer splits than there are cores.

    That is the case of a small single-file table; a large table has more splits
    than cores and passes through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def compounds(df: DataFrame, id_col: str, structure_col: str) -> DataFrame:
    """Items to encode or to score: ``(row_id, structure)``."""
    require_columns(df, [id_col, structure_col], "compound table")
    return df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(structure_col).alias("structure"))


def assays(df: DataFrame, id_col: str, structure_col: str, assay_cols: Sequence[str]) -> DataFrame:
    """Wide assay table: key, structure, one nullable 0/1 column per assay."""
    require_columns(df, [id_col, structure_col, *assay_cols], "assay table")
    return df.select(
        F.col(id_col).cast("bigint").alias("row_id"), F.col(structure_col).alias("structure"),
        *[F.col(c).cast("double").alias(c) for c in assay_cols],
    )


def assays_csv(spark: SparkSession, path: str, id_col: str, structure_col: str, assay_cols: Sequence[str]) -> DataFrame:
    """The same from CSV with a header, without type inference over the data."""
    raw = spark.read.csv(path, header=True)
    return assays(raw, id_col, structure_col, assay_cols)


def fingerprints(spark: SparkSession, path: str, family: str) -> DataFrame:
    """Stored fingerprints of one family; the others are pruned by partition."""
    return spark.read.schema(FINGERPRINTS).parquet(path).filter(F.col("fp") == family)


def rejects(spark: SparkSession, path: str, family: str | None = None) -> DataFrame:
    """Stored rejects. No table means nothing was rejected."""
    try:
        stored = spark.read.schema(REJECTS).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], REJECTS)
    return stored if family is None else stored.filter(F.col("fp") == family)


def request(df: DataFrame) -> DataFrame:
    """Prediction request with the place of each row.

    A ``request_pos`` column is kept if there is one; otherwise rows are numbered
    in the order of the (small, single-file) source.
    """
    require_columns(df, REQUEST_COLUMNS, "prediction request")
    place = F.col("request_pos") if "request_pos" in df.columns else F.monotonically_increasing_id()
    return df.select(*REQUEST_COLUMNS, place.cast("bigint").alias("request_pos"))


def columns_to_bits(df: DataFrame, family: str, id_col: str = "row_id") -> DataFrame:
    """Fingerprint table given as 0/1 columns ``<family>_1 …`` turned into set positions."""
    prefix = f"{family.lower()}_"
    names = sorted((c for c in df.columns if c.startswith(prefix)), key=lambda c: int(c[len(prefix):]))
    if not names:
        raise KeyError(f"no column starts with {prefix}")
    marks = F.array(*[F.when(F.col(c) == 1, F.lit(i)) for i, c in enumerate(names)])
    return df.select(F.col(id_col).alias("row_id"), F.array_compact(marks).alias("bits"), F.lit(family).alias("fp"))


def known_hits(df: DataFrame) -> DataFrame:
    """Long outcomes without the missing ones."""
    return labelled(df)
