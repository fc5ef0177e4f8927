"""Writers, and reading back what they wrote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import METRICS, to_wide
from ..operators.prepare import attach
from ..schema import RESULTS

# The levels of the folder tree in which splits are kept.
SPLIT_LEVELS = ("data_name", "assay", "fp", "model", "run_date", "run_time", "split")


def _replace_partitions(df: DataFrame, path: str, levels: Sequence[str]) -> None:
    """Write the partitions that ``df`` has rows for; those of other families or runs stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*levels).parquet(path)


def write_fingerprints(df: DataFrame, path: str) -> None:
    _replace_partitions(df, path, ["fp"])


def write_rejects(df: DataFrame, path: str) -> None:
    _replace_partitions(df, path, ["fp"])


def write_split(df: DataFrame, path: str) -> None:
    """Split rows below ``data_name=…/assay=…/…/split=…`` in one write; a repeated run replaces its own rows."""
    _replace_partitions(df, path, SPLIT_LEVELS)


def append_results(df: DataFrame, path: str) -> None:
    df.select(*RESULTS.names).write.mode("append").parquet(path)


def stored_results(spark: SparkSession, path: str) -> DataFrame:
    """Results written so far; none yet gives an empty frame."""
    try:
        return spark.read.schema(RESULTS).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RESULTS)


def pending(candidates: DataFrame, done: DataFrame) -> DataFrame:
    """Candidates without stored results: what a restarted run has left to do."""
    on = [c for c in ("assay", "fp", "model", "param_idx") if c in candidates.columns]
    return candidates.join(done.select(*on).distinct(), on, "left_anti")


def metric_rows(validation: DataFrame, test: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ten rows per run: the five metrics of validation and of the hold-out."""
    def long(df: DataFrame, part: str) -> DataFrame:
        return df.select(*by, *METRICS).unpivot(list(by), list(METRICS), "metric", "value").withColumn("part", F.lit(part))

    return long(validation, "validation").unionByName(long(test, "test"))


def log_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def wide_predictions(predictions: DataFrame, compounds: DataFrame, assays: Sequence[str]) -> DataFrame:
    """Structure first, then one column per assay."""
    wide = attach(to_wide(predictions, assays), compounds)
    return wide.select("row_id", "structure", *assays)


def write_predictions(df: DataFrame, folder: str, run_date: str | None = None, run_time: str | None = None) -> str:
    """Write the wide table, below a dated folder when a run is named; returns the path."""
    path = "/".join([folder.rstrip("/"), *[p for p in (run_date, run_time) if p], "predictions"])
    df.write.mode("overwrite").parquet(path)
    return path
