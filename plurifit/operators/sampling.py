"""Exact, repeatable hold-out splits and folds.

Every split is decided by comparing a row's key with the cuts of its group, so
no row moves between executors to be split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import shuffle_key
from ..functions.sizing import broadcast_if_small
from .ranks import id_span, place_among_cuts, rank_cuts

DEFAULT_SEED = 42
TEST_FRACTION = 0.2


def _test_size(n: Column, fraction: float) -> Column:
    """ceil(fraction · n), with the product rounded first so that 0.2 · 15 is 3."""
    return F.ceil(F.round(n.cast("double") * F.lit(float(fraction)), 9)).cast("bigint")


def train_test_split(
    df: DataFrame,
    by: Sequence[str],
    seed: Column | int = DEFAULT_SEED,
    fraction: float = TEST_FRACTION,
) -> DataFrame:
    """Adds ``split``: the first ``ceil(fraction · n)`` rows of the shuffle are ``test``."""
    by = list(by)
    key = shuffle_key(seed, F.col("row_id"))

    def targets(totals: DataFrame) -> DataFrame:
        return totals.select(*by, F.array(_test_size(F.col("n"), fraction)).alias("targets"))

    cuts = rank_cuts(df, by, key, targets)
    place = place_among_cuts(key, F.col("row_id"), F.col("cuts"))
    return (
        df.join(broadcast_if_small(cuts), by)
        .withColumn("split", F.when(place == 0, "test").otherwise("train"))
        .drop("cuts")
    )


def repeated_holdout(df: DataFrame, by: Sequence[str], seeds: Sequence[int], fraction: float = TEST_FRACTION) -> DataFrame:
    """All hold-outs of a repeated split in one job; adds ``seed`` and ``split``."""
    repeated = df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)).cast("bigint") for s in seeds])))
    return train_test_split(repeated, [*by, "seed"], F.col("seed"), fraction)


def stratified_split(
    df: DataFrame,
    by: Sequence[str],
    seed: int = DEFAULT_SEED,
    fraction: float = TEST_FRACTION,
    label: str = "hit",
) -> DataFrame:
    """Hold-out of exactly ``ceil(fraction · n)`` rows with class shares kept.

    Class sizes are rounded down and the rows still missing go to the classes
    with the largest remainders, the lower label first when they are equal.
    """
    by = list(by)
    key = shuffle_key(seed, F.col("row_id"))

    def targets(totals: DataFrame) -> DataFrame:
        group = Window.partitionBy(*by)
        share = F.col("n").cast("double") * F.col("_test") / F.col("_all")
        return (
            totals.withColumn("_all", F.sum("n").over(group))
            .withColumn("_test", _test_size(F.col("_all"), fraction))
            .withColumn("_share", F.round(share, 9))
            .withColumn("_floor", F.floor("_share"))
            .withColumn("_missing", F.col("_test") - F.sum("_floor").over(group))
            .withColumn("_order", F.row_number().over(group.orderBy(F.desc(F.col("_share") - F.col("_floor")), label)))
            .select(
                *by, label,
                F.array(F.col("_floor") + (F.col("_order") <= F.col("_missing")).cast("bigint")).alias("targets"),
            )
        )

    cuts = rank_cuts(df, [*by, label], key, targets)
    place = place_among_cuts(key, F.col("row_id"), F.col("cuts"))
    return (
        df.join(broadcast_if_small(cuts), [*by, label])
        .withColumn("split", F.when(place == 0, "test").otherwise("train"))
        .drop("cuts")
    )


def stratified_folds(
    df: DataFrame,
    by: Sequence[str],
    k: int = 5,
    seed: int = DEFAULT_SEED,
    shuffle: bool = True,
    label: str = "hit",
) -> DataFrame:
    """Adds ``fold`` 0…k-1 with class sizes and fold sizes that differ by at most one.

    Lay the classes end to end, in the order of their first row, and deal the
    places out to the folds in turn: that fixes how many rows of a class each
    fold gets.  Inside a class the folds are consecutive stretches, of the
    shuffled order or (``shuffle=False``) of the order of ``row_id``.
    """
    by = list(by)
    if shuffle:
        key, bits = shuffle_key(seed, F.col("row_id")), 60
    else:
        lo, hi = id_span(df)
        key, bits = F.col("row_id") - F.lit(lo), max(1, (hi - lo).bit_length())

    def targets(totals: DataFrame) -> DataFrame:
        earlier = Window.partitionBy(*by).orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum("n").over(earlier), F.lit(0))

        def upto(places: Column, fold: Column) -> Column:
            """Places below ``places`` that belong to folds 0…fold."""
            whole = F.floor(places / k)
            return whole * (fold + 1) + F.least(F.pmod(places, F.lit(k)), fold + 1)

        return totals.withColumn("_start", start).select(
            *by, label,
            F.transform(
                F.sequence(F.lit(0), F.lit(k - 2)),
                lambda f: (
                    upto(F.col("_start") + F.col("n"), f.cast("bigint")) - upto(F.col("_start"), f.cast("bigint"))
                ).cast("bigint"),
            ).alias("targets"),
        )

    cuts = rank_cuts(df, [*by, label], key, targets, key_bits=bits, hashed=shuffle)
    return (
        df.join(broadcast_if_small(cuts), [*by, label])
        .withColumn("fold", place_among_cuts(key, F.col("row_id"), F.col("cuts")))
        .drop("cuts")
    )


def training_parts(folded: DataFrame, k: int = 5) -> DataFrame:
    """Each row once per fold it trains in; ``cv_fold`` is the fold left out."""
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))
    return folded.withColumn("cv_fold", F.explode(others)).drop("fold")
