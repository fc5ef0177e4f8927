"""Binary-classification metrics as grouped aggregations.

Every function reads rows with the true class ``y``, the hard class
``prediction`` and the class-1 probability ``score``.  Ratios that are undefined
are 0; the area under the ROC curve of a group with one class is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("precision", "recall", "f1", "accuracy", "roc_auc")

# Scores are spread over this many buckets per unit of log odds.
BUCKETS_PER_LOGIT = 128


def _count_if(condition: Column, weight: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0)).cast("bigint")


def confusion(df: DataFrame, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    """``n_tp, n_fp, n_fn, n_tn`` per group, from rows or (``weight``) from counted rows."""
    w = F.lit(1).cast("bigint") if weight is None else weight
    y, p = F.col("y") == 1, F.col("prediction") == 1
    return df.groupBy(*by).agg(
        _count_if(y & p, w).alias("n_tp"),
        _count_if(~y & p, w).alias("n_fp"),
        _count_if(y & ~p, w).alias("n_fn"),
        _count_if(~y & ~p, w).alias("n_tn"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def precision() -> Column:
    return _ratio(F.col("n_tp"), F.col("n_tp") + F.col("n_fp"))


def recall() -> Column:
    return _ratio(F.col("n_tp"), F.col("n_tp") + F.col("n_fn"))


def f1() -> Column:
    return _ratio(2 * F.col("n_tp"), 2 * F.col("n_tp") + F.col("n_fp") + F.col("n_fn"))


def accuracy() -> Column:
    return _ratio(F.col("n_tp") + F.col("n_tn"), F.col("n_tp") + F.col("n_fp") + F.col("n_fn") + F.col("n_tn"))


def _score_bucket(score: Column) -> Column:
    """Non-decreasing bucket number of a score, fine where probabilities crowd.

    Inside (0, 1) it follows the log odds; scores outside that range follow the
    logarithm of their distance from it.
    """
    eps = 1e-300
    inside = F.floor(F.log(F.greatest(score, F.lit(eps)) / (1.0 - score)) * BUCKETS_PER_LOGIT)
    below = -1_000_000 - F.floor(F.log1p(-score) * BUCKETS_PER_LOGIT)
    above = 1_000_000 + F.floor(F.log1p(score - 1.0) * BUCKETS_PER_LOGIT)
    return F.when(score <= 0, below).when(score >= 1, above).otherwise(inside).cast("bigint")


def auc_from_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact AUC from ``(by…, score, pos, neg)``, tied scores counted half.

    Rows are first added up per distinct score, then ranked inside buckets of
    the score, so one large group is spread over many tasks; only the bucket
    totals are put in order as a whole.
    """
    by = list(by)
    distinct = (
        counts.groupBy(*by, "score")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .withColumn("_bucket", _score_bucket(F.col("score")))
    )
    lower = Window.partitionBy(*by, "_bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    pairs = F.col("pos").cast("double") * (F.col("_below") + F.col("neg") / 2.0)
    buckets = (
        distinct.withColumn("_below", F.coalesce(F.sum("neg").over(lower), F.lit(0)).cast("double"))
        .groupBy(*by, "_bucket")
        .agg(F.sum(pairs).alias("_pairs"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        buckets.withColumn("_before", F.coalesce(F.sum("neg").over(earlier), F.lit(0)).cast("double"))
        .groupBy(*by)
        .agg(
            F.sum(F.col("_pairs") + F.col("pos").cast("double") * F.col("_before")).alias("_pairs"),
            F.sum("pos").cast("bigint").alias("n_pos"),
            F.sum("neg").cast("bigint").alias("n_neg"),
        )
        .select(
            *by, "n_pos", "n_neg",
            F.when(
                (F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                F.col("_pairs") / (F.col("n_pos").cast("double") * F.col("n_neg").cast("double")),
            ).alias("roc_auc"),
        )
    )


def roc_auc(df: DataFrame, by: Sequence[str]) -> DataFrame:
    counts = df.groupBy(*by, "score").agg(
        _count_if(F.col("y") == 1, F.lit(1)).alias("pos"), _count_if(F.col("y") == 0, F.lit(1)).alias("neg")
    )
    return auc_from_counts(counts, by)


def all_metrics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The five metrics per group in one aggregation tree.

    Rows are added up per (group, score, prediction) once; confusion counts and
    AUC are both read off those sums.
    """
    counted = df.groupBy(*by, "score", "prediction").agg(
        _count_if(F.col("y") == 1, F.lit(1)).alias("pos"), _count_if(F.col("y") == 0, F.lit(1)).alias("neg")
    )
    return metrics_from_counts(counted, by)


def metrics_from_counts(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """The five metrics from ``(by…, score, prediction, pos, neg)``."""
    by = list(by)
    if not by:
        return metrics_from_counts(counted.withColumn("_all", F.lit(0)), ["_all"]).drop("_all")
    hit = F.col("prediction") == 1
    matrix = counted.groupBy(*by).agg(
        _count_if(hit, F.col("pos")).alias("n_tp"), _count_if(hit, F.col("neg")).alias("n_fp"),
        _count_if(~hit, F.col("pos")).alias("n_fn"), _count_if(~hit, F.col("neg")).alias("n_tn"),
    )
    ratios = matrix.select(
        *by, precision().alias("precision"), recall().alias("recall"), f1().alias("f1"), accuracy().alias("accuracy")
    )
    return ratios.join(auc_from_counts(counted, by).select(*by, "roc_auc"), by)


def summarise(results: DataFrame, by: Sequence[str], how: str = "mean", metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean or median of each metric over the folds of a candidate."""
    if how == "mean":
        agg = F.avg
    elif how == "median":
        agg = F.median
    else:
        raise ValueError(f"folds are summed up by 'mean' or 'median', not {how!r}")
    return results.groupBy(*by).agg(*[agg(m).alias(m) for m in metrics])


def best_candidate(
    results: DataFrame, by: Sequence[str], metric: str = "f1", how: str = "mean", index: str = "param_idx"
) -> DataFrame:
    """Candidate with the highest summed-up metric of each campaign.

    The first one wins a tie, and a candidate without a number never wins.
    """
    score = F.col(metric)
    fair = summarise(results, [*by, index], how, [metric]).filter(score.isNotNull() & ~F.isnan(score))
    top = F.max(F.struct(score.alias("s"), (-F.col(index)).alias("i")))
    return fair.groupBy(*by).agg(top.alias("_top")).select(
        *by, (-F.col("_top.i")).alias(index), F.col("_top.s").alias("best_score")
    )


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("fp").agg(F.count(F.lit(1)).alias("n_rejects"))


def last_wins(predictions: DataFrame, by: Sequence[str] = ("row_id", "assay")) -> DataFrame:
    """One prediction per item and assay: that of the latest request row."""
    return predictions.groupBy(*by).agg(F.max_by("prediction", "request_pos").alias("prediction"))


def to_wide(predictions: DataFrame, assays: Sequence[str]) -> DataFrame:
    """One column per assay."""
    return predictions.groupBy("row_id").pivot("assay", list(assays)).agg(F.first("prediction"))
