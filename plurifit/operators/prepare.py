"""Projection, cleaning and keyed alignment of items, features and outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sizing import broadcast_if_small
from ..schema import require_columns

FIRST_ASSAY_POSITION = 2  # id, structure, then the assays


def require(df: DataFrame, column: str) -> DataFrame:
    """One column that has to be there."""
    return require_columns(df, [column]).select(column)


def assay_columns(df: DataFrame) -> list[str]:
    return df.columns[FIRST_ASSAY_POSITION:]


def assay_by_number(df: DataFrame, number: int, id_col: str = "row_id") -> DataFrame:
    """The ``number``-th assay, counted from 1, with its row key."""
    names = assay_columns(df)
    if not 1 <= number <= len(names):
        raise IndexError(f"assay {number} asked for, the table has {len(names)}")
    name = names[number - 1]
    return df.select(F.col(id_col).alias("row_id"), F.lit(name).alias("assay"), F.col(name).alias("hit"))


def assay_names(df: DataFrame) -> DataFrame:
    """Number, name and count of outcomes of every assay column, in one scan."""
    names = assay_columns(df)
    counted = df.agg(*[F.count(n).alias(n) for n in names])
    entries = F.array(*[
        F.struct(F.lit(i).alias("assay_num"), F.lit(n).alias("assay"), F.col(n).alias("n_hits"))
        for i, n in enumerate(names, start=1)
    ])
    return counted.select(F.inline(entries))


def melt(df: DataFrame, id_col: str = "row_id", assays: Sequence[str] | None = None) -> DataFrame:
    """Every assay column as rows ``(row_id, assay, hit)``; missing outcomes, null or NaN, become null. Values other than 0 and 1 are an error."""
    names = list(assays or assay_columns(df))

    def outcome(name: str):
        value = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
        wrong = F.raise_error(F.concat(F.lit(f"{name} holds an outcome other than 0 and 1: "), value.cast("string"))).cast("int")
        return F.when(value.isNull(), F.lit(None).cast("int")).when(value.isin(0.0, 1.0), value.cast("int")).otherwise(wrong).alias(name)

    slim = df.select(F.col(id_col).alias("row_id"), *[outcome(n) for n in names])
    return slim.unpivot("row_id", names, "assay", "hit")


def labelled(df: DataFrame, column: str = "hit") -> DataFrame:
    """Rows whose outcome is known (neither null nor NaN)."""
    known = F.col(column).isNotNull()
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        known = known & ~F.isnan(column)
    return df.filter(known)


def parseable(structure: Column, min_length: int = 30) -> Column:
    """Whether a structure text can be encoded: not null, not blank, long enough."""
    return F.coalesce((F.length(structure) >= min_length) & (F.length(F.trim(structure)) > 0), F.lit(False))


def reject_reason(structure: Column, min_length: int = 30) -> Column:
    """Why a text cannot be encoded; null when it can."""
    return (
        F.when(structure.isNull(), "missing")
        .when(F.length(F.trim(structure)) == 0, "blank")
        .when(F.length(structure) < min_length, "too short")
    )


def drop_rejects(df: DataFrame, rejects: DataFrame) -> DataFrame:
    on = [c for c in ("row_id", "fp") if c in df.columns and c in rejects.columns]
    return df.join(rejects.select(*on), on, "left_anti")


def align(features: DataFrame, hits: DataFrame) -> DataFrame:
    """Features and known outcomes side by side, matched by key."""
    return features.join(labelled(hits), "row_id", "inner")


def min_support(hits: DataFrame, at_least: int = 5) -> DataFrame:
    """Outcomes of assays with at least ``at_least`` positives."""
    keep = hits.groupBy("assay").agg(F.sum("hit").alias("_pos")).filter(F.col("_pos") >= at_least)
    return hits.join(broadcast_if_small(keep.select("assay")), "assay", "left_semi")


def main_fragment(structure: Column, separator: str = ".") -> Column:
    """Longest part of a multi-part structure; the earliest of equally long ones."""
    parts = F.transform(
        F.split(structure, f"[{separator}]"),
        lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("place"), p.alias("part")),
    )
    return F.array_max(parts)["part"]


def has_symbol(structure: Column, pattern: str) -> Column:
    return structure.rlike(pattern)


def class_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Both class sizes and the number of synthetic rows that would level them."""
    pos = F.coalesce(F.sum((F.col("hit") == 1).cast("bigint")), F.lit(0))
    neg = F.coalesce(F.sum((F.col("hit") == 0).cast("bigint")), F.lit(0))
    return df.groupBy(*by).agg(pos.alias("n_pos"), neg.alias("n_neg")).withColumn(
        "n_new", F.abs(F.col("n_pos") - F.col("n_neg"))
    )


def gate(folded: DataFrame, by: Sequence[str], neighbours: int = 5) -> DataFrame:
    """Whether each campaign can be balanced in every fold, and if not, why.

    ``folded`` has one row per training item with ``hit`` and ``fold``.  The
    training part of a fold needs both classes and, in the smaller one,
    ``neighbours`` rows besides the row whose neighbours are sought.
    """
    per_fold = folded.groupBy(*by, "fold").agg(
        F.sum("hit").cast("bigint").alias("p"), F.count(F.lit(1)).alias("n")
    )
    folds = F.collect_list(F.struct("p", "n"))  # one entry per fold
    total = per_fold.groupBy(*by).agg(
        F.sum("p").alias("n_pos"), (F.sum("n") - F.sum("p")).alias("n_neg"), folds.alias("_folds")
    )
    left = F.transform(
        "_folds",
        lambda f: F.least(F.col("n_pos") - f["p"], F.col("n_neg") - (f["n"] - f["p"])),
    )
    smallest = F.array_min(left)
    return total.select(
        *by, "n_pos", "n_neg", smallest.alias("min_minority"),
        (smallest >= neighbours + 1).alias("open"),
        F.when(F.least("n_pos", "n_neg") == 0, "one class")
        .when(smallest < 1, "a fold has one class")
        .when(smallest < neighbours + 1, "too few minority rows")
        .otherwise("ok").alias("reason"),
    )


def attach(predictions: DataFrame, compounds: DataFrame) -> DataFrame:
    """Predictions with the structure they belong to."""
    return predictions.join(compounds.select("row_id", "structure"), "row_id", "inner")


def run_matrix(assays: DataFrame, models: Sequence[str], families: Sequence[str], seeds: Sequence[int] = (42,)) -> DataFrame:
    """Every run of a campaign: assay × model × family × seed.

    The three lists are exploded in the row of their assay, so nothing is joined.
    """
    def options(values):
        return F.explode(F.array(*[F.lit(v) for v in values]))

    return (
        assays.withColumn("model", options(models))
        .withColumn("fp", options(families))
        .withColumn("seed", options(seeds))
    )


def usable_requests(request: DataFrame, registry: DataFrame, families: DataFrame) -> DataFrame:
    """Request rows marked with what keeps them from being scored, if anything."""
    known = broadcast_if_small(registry.select(
        F.col("assay").alias("assay_name"), F.col("model").alias("Model"), F.col("fp").alias("MF"),
        F.lit(True).alias("_model"),
    ).distinct())
    encoded = broadcast_if_small(families.select(F.col("fp").alias("MF"), F.lit(True).alias("_fp")).distinct())
    return (
        request.join(known, ["assay_name", "Model", "MF"], "left")
        .join(encoded, "MF", "left")
        .withColumn(
            "reason",
            F.when(F.col("_model").isNull(), "no model").when(F.col("_fp").isNull(), "no features").otherwise("ok"),
        )
        .withColumn("usable", F.col("reason") == "ok")
        .drop("_model", "_fp")
    )


def resolve(request: DataFrame, registry: DataFrame) -> DataFrame:
    """Each request row with the registry entry of its model."""
    entry = registry.select(
        F.col("assay").alias("assay_name"), F.col("model").alias("Model"), F.col("fp").alias("MF"), "kind", "path"
    )
    return request.join(broadcast_if_small(entry), ["assay_name", "Model", "MF"], "inner")


def bits_to_columns(df: DataFrame, family: str, width: int) -> DataFrame:
    """One 0/1 column per bit, ``<family>_1 … <family>_<width>``; for export only."""
    prefix = family.lower()
    return df.select(
        "row_id",
        *[F.array_contains("bits", i).cast("int").alias(f"{prefix}_{i + 1}") for i in range(width)],
    )
