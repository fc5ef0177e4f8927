"""Scalar helpers used around a campaign: seeds, stamps, keys, small arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted clock format, and the distance in seconds between
# 1900-01-01 00:00:00 UTC and the Unix epoch.
CLOCK_PATTERN = r"^([01]?[0-9]|2[0-3])-[0-5]?[0-9]-[0-5]?[0-9]$"
SECONDS_1900_TO_EPOCH = 2208988800


def time_seed(clock: Column, strict: bool = True) -> Column:
    """Seed for a run started at ``HH-MM-SS``: |epoch seconds| of that time on 1900-01-01 UTC.

    A text in any other format raises when ``strict``, and is null otherwise.
    """
    part = F.split(clock, "-")
    seconds = (
        part.getItem(0).cast("bigint") * 3600
        + part.getItem(1).cast("bigint") * 60
        + part.getItem(2).cast("bigint")
    )
    seed = F.when(clock.rlike(CLOCK_PATTERN), F.lit(SECONDS_1900_TO_EPOCH).cast("bigint") - seconds)
    if not strict:
        return seed
    message = F.concat(F.lit("not a HH-MM-SS time: "), F.coalesce(clock, F.lit("null")))
    return F.when(seed.isNotNull(), seed).otherwise(F.raise_error(message).cast("bigint"))


def run_date(ts: Column, dashed: bool = False) -> Column:
    """Date stamp of a run, ``YYYYMMDD`` or ``YYYY-MM-DD``."""
    return F.date_format(ts, "yyyy-MM-dd" if dashed else "yyyyMMdd")


def linspace(lo: Column, hi: Column, n: int) -> Column:
    """``n`` evenly spaced doubles from ``lo`` to ``hi``, both included."""
    lo, hi = lo.cast("double"), hi.cast("double")
    if n == 1:
        return F.array(lo)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: lo + i.cast("double") * (hi - lo) / F.lit(float(n - 1)),
    )


def argmax(values: Column) -> Column:
    """0-based place of the largest element; the first one wins a tie."""
    return F.array_position(values, F.array_max(values)) - 1


def one_hot(label: Column, classes: Sequence[int]) -> Column:
    return F.array(*[F.when(label == F.lit(c), 1).otherwise(0) for c in classes])


def model_key(assay: Column, family: Column, model: Column) -> Column:
    """Name under which the best model of a campaign is kept."""
    return F.concat_ws("_", assay, F.lit("best_model"), family, model)


def class1_probability(probability: Column) -> Column:
    """Probability of class 1 out of a ``spark.ml`` probability vector."""
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(probability)[1]


def results_json(*fields: Column | str) -> Column:
    return F.to_json(F.struct(*fields))
