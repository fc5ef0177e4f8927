"""Metrics and selection."""

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from plurifit.operators import metrics


def scored(spark, rows):
    return spark.createDataFrame([("g", y, float(s), int(s > 0.5)) for y, s in rows], "g string, y int, score double, prediction int")


@pytest.mark.parametrize("rows, auc", [
    ([(0, 0.3), (1, 0.3), (0, 0.3)], 0.5), ([(0, 0.1), (1, 0.9)], 1.0), ([(0, 0.9), (1, 0.1)], 0.0), ([(1, 0.5)], None),
    ([(0, -3.0), (1, 0.0), (0, 1.0), (1, 7.5)], 0.75),
])
def test_auc_cases(spark, rows, auc):
    assert metrics.roc_auc(scored(spark, rows), ["g"]).first()["roc_auc"] == auc


def test_auc_agrees_with_spark_and_flips(spark):
    df = spark.range(500).selectExpr(
        "'g' AS g", "int(pmod(hash(id), 3) = 0) AS y", "double(pmod(hash(id, 1), 40)) / 39 AS score"
    ).cache()
    ours = metrics.roc_auc(df, ["g"]).first()["roc_auc"]
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0).evaluate(df)
    assert abs(ours - theirs) < 1e-12
    flipped = metrics.roc_auc(df.withColumn("score", 1 - F.col("score")), ["g"]).first()["roc_auc"]
    assert abs(ours + flipped - 1) < 1e-12


def test_undefined_ratios_are_zero(spark):
    row = metrics.all_metrics(scored(spark, [(1, 0.1), (0, 0.2)]), ["g"]).first()
    assert (row.precision, row.recall, row.f1, row.accuracy) == (0.0, 0.0, 0.0, 0.5)


def test_first_candidate_wins_and_nan_never(spark):
    rows = [("a", 0, float("nan")), ("a", 1, 0.5), ("a", 2, 0.5), ("a", 3, 0.2)]
    df = spark.createDataFrame(rows, "assay string, param_idx int, f1 double")
    assert metrics.best_candidate(df, ["assay"]).first()["param_idx"] == 1


def test_only_mean_and_median(spark):
    with pytest.raises(ValueError):
        metrics.summarise(spark.createDataFrame([(0, 1.0)], "p int, f1 double"), ["p"], "max", ["f1"])
