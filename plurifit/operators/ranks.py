"""Exact order statistics without sorting the data in one place.

``rank_cuts`` finds the rows at given ranks of every group by counting rows per
bucket of the key, and sorts only the buckets in which a wanted rank falls.  The
data itself is never shuffled: callers compare each row with the few cuts of its
group.  ``dense_rank_ids`` gives every row its rank from a sort inside buckets of
the key plus one running count over the buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import KEY_BITS
from ..functions.sizing import broadcast_if_small, pinned

DIGIT_BITS = 12
DIRECT_BITS = 20  # a bucket this narrow holds at most 2**20 unique keys
DENSE_BUCKETS = 16_384
COUNT_ROWS = 500_000  # bucket counts up to this many are kept as literal rows


def rank_cuts(
    df: DataFrame,
    by: Sequence[str],
    key: Column,
    targets: Callable[[DataFrame], DataFrame],
    key_bits: int = KEY_BITS,
    hashed: bool = True,
) -> DataFrame:
    """Rows at wanted ranks of each group.

    ``key`` is a non-negative bigint of at most ``key_bits`` bits; equal keys are
    ordered by ``row_id``.  ``targets`` receives ``(by…, n, first_id)`` per group
    and returns ``(by…, targets array<bigint>)`` with 1-based ranks; rank 0 stands
    for "before every row".  The result has one row per group with ``cuts``, the
    array of ``(key, row_id)`` in the order of ``targets``.

    A hashed key spreads evenly, so one round of counting leaves 1/4096 of a
    group to be sorted.  Any other key is narrowed 12 bits per round until a
    bucket cannot hold more than 2**20 of its unique values.
    """
    by = list(by)
    base = df.select(*by, "row_id", key.alias("_key"))
    rounds = 1 if hashed else max(1, -(-(key_bits - DIRECT_BITS) // DIGIT_BITS))

    shift = max(0, key_bits - DIGIT_BITS)
    counts = base.groupBy(*by, F.shiftright("_key", shift).alias("_bucket")).agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("row_id").alias("_first")
    )
    counts, small = pinned(counts, COUNT_ROWS)
    totals = counts.groupBy(*by).agg(F.sum("_cnt").alias("n"), F.min("_first").alias("first_id"))
    wanted = targets(totals).select(*by, F.posexplode("targets").alias("cut_no", "rank"))

    running = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_cnt").over(running), F.lit(0)))
    inside = (F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_cnt"))
    spot = before.join(wanted, by, "inner").filter(inside).select(
        *by, "cut_no", "_bucket", (F.col("rank") - F.col("_before")).alias("_within")
    )

    for _ in range(rounds - 1):
        spot, small = pinned(spot, COUNT_ROWS)
        finer = max(0, shift - DIGIT_BITS)
        hint = F.broadcast(spot) if small else spot
        counts = (
            base.withColumn("_bucket", F.shiftright("_key", shift))
            .join(hint, [*by, "_bucket"], "inner")
            .groupBy(*by, "cut_no", "_within", F.shiftright("_key", finer).alias("_bucket"))
            .agg(F.count(F.lit(1)).alias("_cnt"))
        )
        running = Window.partitionBy(*by, "cut_no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        before = counts.withColumn("_before", F.coalesce(F.sum("_cnt").over(running), F.lit(0)))
        inside = (F.col("_within") > F.col("_before")) & (F.col("_within") <= F.col("_before") + F.col("_cnt"))
        spot = before.filter(inside).select(
            *by, "cut_no", "_bucket", (F.col("_within") - F.col("_before")).alias("_within")
        )
        shift = finer

    # no more rows than the counts they were found in
    spot = F.broadcast(spot) if small and rounds == 1 else broadcast_if_small(spot)
    order = Window.partitionBy(*by, "cut_no").orderBy("_key", "row_id")
    found = (
        base.withColumn("_bucket", F.shiftright("_key", shift))
        .join(spot, [*by, "_bucket"], "inner")
        .withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") == F.col("_within"))
        .select(*by, "cut_no", F.col("_key").alias("key"), F.col("row_id").alias("id"))
    )
    zero = wanted.filter("rank <= 0").select(
        *by, "cut_no", F.lit(-1).cast("bigint").alias("key"), F.lit(-1).cast("bigint").alias("id")
    )
    cut = F.array_sort(F.collect_list(F.struct("cut_no", "key", "id")))  # as many as targets per group
    return found.unionByName(zero).groupBy(*by).agg(
        F.transform(cut, lambda c: F.struct(c["key"].alias("key"), c["id"].alias("id"))).alias("cuts")
    )


def place_among_cuts(key: Column, row_id: Column, cuts: Column) -> Column:
    """Number of cuts that lie before the row: 0 for a row at or before the first cut."""
    row = F.struct(key.alias("key"), row_id.alias("id"))
    return F.size(F.filter(cuts, lambda c: c < row))


def id_span(df: DataFrame, column: str = "row_id") -> tuple[int, int]:
    """Smallest and largest key (two numbers, from one aggregation)."""
    row = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    return (row["lo"], row["hi"]) if row["lo"] is not None else (0, 0)


def dense_rank_ids(df: DataFrame, column: str = "row_id", name: str = "row_no") -> DataFrame:
    """0-based compact row numbers in the order of a unique key.

    Rows are sorted inside at most ``DENSE_BUCKETS`` equal slices of the key
    range; the running count over the slices is a table of that many rows.
    """
    lo, hi = id_span(df, column)
    width = max(1, -(-(hi - lo + 1) // DENSE_BUCKETS))
    bucketed = df.withColumn("_bucket", F.floor((F.col(column) - F.lit(lo)) / F.lit(width)).cast("int"))
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_cnt")).select(
        "_bucket", F.coalesce(F.sum("_cnt").over(running), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_bucket").orderBy(column)
    return (
        bucketed.withColumn("_rn", F.row_number().over(inside).cast("bigint"))
        .join(F.broadcast(offsets), "_bucket")  # at most DENSE_BUCKETS rows
        .withColumn(name, F.col("_before") + F.col("_rn") - 1)
        .drop("_bucket", "_rn", "_before")
    )


def hashed_rank(df: DataFrame, by: Sequence[str], key: Column, name: str = "rank") -> DataFrame:
    """0-based rank of every row inside its group by ``(key, row_id)``.

    Groups are cut into buckets of a hashed key so that one large group is
    sorted by many tasks; offsets come from the bucket counts.
    """
    by = list(by)
    bucketed = df.withColumn("_key", key).withColumn("_bucket", F.shiftright("_key", KEY_BITS - DIGIT_BITS))
    running = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_cnt")).select(
        *by, "_bucket", F.coalesce(F.sum("_cnt").over(running), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy("_key", "row_id")
    return (
        bucketed.withColumn("_rn", F.row_number().over(inside).cast("bigint"))
        .join(offsets, [*by, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_rn") - 1)
        .drop("_key", "_bucket", "_rn", "_before")
    )
