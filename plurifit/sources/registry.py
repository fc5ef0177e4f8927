"""Fitted models on disk and the table that says where they are."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession

from ..plans.estimators import BoostFit, ForestFit, PlsFit, SparkFit, TreeFit
from ..schema import REGISTRY


def entry_path(root: str, assay: str, family: str, model: str) -> str:
    return f"{root.rstrip('/')}/models/{assay}/{assay}_{family}_{model}/{assay}_best_model_{family}_{model}"


def save_model(spark: SparkSession, fitted, root: str, assay: str, family: str, model: str) -> str:
    """Save a model and add its registry row; returns the path."""
    path = entry_path(root, assay, family, model)
    fitted.save(path)
    row = [(assay, family, model, fitted.kind, path)]
    spark.createDataFrame(row, REGISTRY).write.mode("append").parquet(f"{root.rstrip('/')}/registry")
    return path


def registry(spark: SparkSession, root: str) -> DataFrame:
    """One row per saved model; saving again replaces the files, not the row."""
    try:
        return spark.read.schema(REGISTRY).parquet(f"{root.rstrip('/')}/registry").distinct()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], REGISTRY)


def load_model(spark: SparkSession, kind: str, path: str, width: int):
    if kind == "tree":
        return TreeFit(spark.read.parquet(path))
    if kind == "forest":
        return ForestFit.load(spark, path)
    if kind == "boost":
        stored = json.loads(spark.read.parquet(path).first()["model"])
        return BoostFit(stored["base"], stored["bits"], stored["values"], width, spark=spark)
    if kind == "pls":
        stored = json.loads(spark.read.parquet(path).first()["model"])
        return PlsFit(stored["b"], stored["a"], spark=spark)
    return SparkFit(DefaultParamsReader.loadParamsInstance(path, spark.sparkContext), width)
