"""Partial least squares discriminant analysis from one distributed Gram matrix.

All the method needs from the data are inner products of columns.  Each task
adds up the Gram matrix of its rows, the per-task matrices are added up on the
executors in two steps, so no task meets a row of every matrix, and only the
final matrix, whose size depends on the number of bits alone, reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import add_rows, gram_of_bits, pls_coefficients


def gram(df: DataFrame, width: int) -> DataFrame:
    """``(i, row array<double>)`` of X'X, where X holds the bits, then one-hot y (2), then ones."""
    size, slim = width + 3, df.select("bits", "hit")
    partial = slim.mapInArrow(gram_of_bits(width), "i int, row array<double>")
    salts = math.isqrt(slim.rdd.getNumPartitions()) + 1
    salted = partial.withColumn("salt", F.spark_partition_id() % salts).groupBy("i", "salt")
    return salted.applyInArrow(add_rows(size), "i int, row array<double>").groupBy("i").applyInArrow(add_rows(size), "i int, row array<double>")


def gram_entries(df: DataFrame, width: int) -> DataFrame:
    """Upper triangle of the bit-by-bit part as ``(i, j, n)``, zeros left out."""
    entry = F.posexplode("row").alias("j", "n")
    return gram(df, width).filter(F.col("i") < width).select("i", entry).filter(
        (F.col("j") < width) & (F.col("i") <= F.col("j")) & (F.col("n") > 0)
    ).select("i", "j", F.col("n").cast("bigint").alias("n"))


def fit(df: DataFrame, width: int, components: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (width × 2) and intercepts (2) of the discriminant."""
    rows = gram(df, width).toPandas()  # width + 3 rows
    full = np.zeros((width + 3, width + 3))
    for i, row in zip(rows["i"], rows["row"]):
        full[i] = row
    return pls_coefficients(full, width, components)


def score(df: DataFrame, coefficients: Sequence[Sequence[float]], intercepts: Sequence[float]) -> DataFrame:
    """Adds both fitted values, ``score`` (that of class 1) and the arg-max ``prediction``."""
    def fitted(c: int):
        weights = F.lit([float(row[c]) for row in coefficients])
        return F.aggregate("bits", F.lit(float(intercepts[c])), lambda total, bit: total + F.get(weights, bit))

    out = df.withColumn("fit_0", fitted(0)).withColumn("fit_1", fitted(1))
    return out.withColumn("score", F.col("fit_1")).withColumn(
        "prediction", (F.col("fit_1") > F.col("fit_0")).cast("int")
    )
