"""Declared schemas and the checks made at the boundary."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FINGERPRINTS = T.StructType([
    T.StructField("row_id", T.LongType(), False),
    T.StructField("bits", T.ArrayType(T.IntegerType(), False), False),
    T.StructField("fp", T.StringType(), False),
])

REJECTS = T.StructType([
    T.StructField("row_id", T.LongType(), False),
    T.StructField("reason", T.StringType(), False),
    T.StructField("fp", T.StringType(), False),
])

# The columns a prediction request must have.
REQUEST_COLUMNS = ("assay_name", "Model", "MF")

RESULTS = T.StructType([
    T.StructField("assay", T.StringType(), False),
    T.StructField("fp", T.StringType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("param_idx", T.IntegerType(), False),
    T.StructField("fold", T.IntegerType(), False),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("roc_auc", T.DoubleType()),
])

REGISTRY = T.StructType([
    T.StructField("assay", T.StringType(), False),
    T.StructField("fp", T.StringType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
])


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """``df`` itself, or ``KeyError`` naming every column it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{what} lacks the columns {missing}")
    return df
