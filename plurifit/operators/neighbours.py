"""Exact k nearest neighbours inside groups, without listing all pairs.

Vectors are integer grids: 0/1 bits (squared distance = Hamming distance) or
real features rounded to a grid.  The work goes in five steps.

1. Equal vectors collapse.  No answer can need more than ``k + 1`` of them, so
   the ``k + 1`` lowest row ids stand for all copies.
2. Distinct vectors are laid out in slices of their norm and, inside a slice,
   in blocks of bounded size picked by a hash.
3. Every block is compared with itself, which bounds the distance of the k-th
   neighbour of each of its vectors.
4. The norms of two vectors bound their distance from below.  A block is paired
   only with blocks of slices that this bound cannot rule out.
5. Every block pair yields at most ``k + 1`` rows per vector; the best ``k + 1``
   over all pairs are the answer, ties going to the lower row id.

Steps 3 and 4 hand Spark-built blocks to a small numpy kernel, one matrix
product per pair.  The slices and blocks are derived from counts, so no group is
ever held by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import text_key
from ..functions.sizing import broadcast_if_small, pinned_table, shuffled
from ..session import materialise
from .fingerprint import WORD_BITS, packed
from .kernels import nearest_in_blocks

BLOCK_ROWS = 512
MAX_SLICES = 2048
COPY_SALTS = 8
PAIR_FIELDS = [T.StructField("q", T.LongType()), T.StructField("d", T.LongType()), T.StructField("id", T.LongType())]


def _across_blocks(vectors, span, by, keep, unpack, block_rows, schema) -> DataFrame:
    """Steps 2 to 4: candidates of every vector from its own block and those in reach."""
    # 2. slices of the norm and blocks inside them
    slices = F.least(F.ceil(F.col("_m") / block_rows), F.lit(MAX_SLICES))
    width = F.greatest((F.col("_hi") - F.col("_lo")) / slices, F.lit(1e-9))

    def slice_of(value: Column) -> Column:
        return F.least(F.greatest(F.floor((value - F.col("_lo")) / F.col("_width")), F.lit(0)), F.col("_slices") - 1).cast("int")

    sliced = (
        vectors.join(span, by).withColumn("_slices", slices).withColumn("_width", width)
        .withColumn("slice", slice_of(F.col("norm")))
    )
    filled = broadcast_if_small(
        sliced.groupBy(*by, "slice").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("bigint").alias("_blocks"))
    )
    spread = text_key(F.concat_ws(",", F.col("words").cast("array<string>")))
    blocks = materialise(
        sliced.join(filled, [*by, "slice"])
        .withColumn("block", F.pmod(spread, F.col("_blocks")).cast("int"))
        .groupBy(*by, "slice", "block")
        .agg(F.collect_list(F.struct("words", "ids", "norm")).alias("items")),  # about block_rows by construction
        "blocks",
    )

    # 3. inside each block
    own = materialise(blocks.select(*by, "items").mapInArrow(nearest_in_blocks(by, keep, unpack, False), schema), "own")
    bound = own.groupBy(*by, "q").agg(
        F.when(F.count(F.lit(1)) >= keep, F.max("d")).otherwise(F.lit(2**62)).alias("far")
    )

    # 4. blocks that may hold something nearer
    item = F.explode("items")
    flat = blocks.select(*by, "slice", "block", item.alias("v")).select(
        *by, "slice", "block", F.col("v.words").alias("words"), F.col("v.ids").alias("ids"),
        F.col("v.norm").alias("norm"), F.col("v.ids")[0].alias("q"),
    )
    reach = F.least(F.col("far").cast("double"), F.lit(1e18))
    if not unpack:
        reach = F.sqrt(reach) + F.lit(1e-6)
    queries = (
        shuffled(flat).join(bound, [*by, "q"]).join(span, by)
        .withColumn("_slices", slices).withColumn("_width", width)
        .groupBy(*by, "slice", "block", "_slices", "_lo", "_width")
        .agg(
            F.collect_list(F.struct("words", "ids", "far")).alias("items"),
            F.min(F.col("norm") - reach).alias("_from"), F.max(F.col("norm") + reach).alias("_to"),
        )
        .withColumn("ref_slice", F.explode(F.sequence(slice_of(F.col("_from")), slice_of(F.col("_to")))))
        .select(*by, F.col("slice").alias("q_slice"), F.col("block").alias("q_block"), "items", "ref_slice")
    )
    refs = blocks.select(*by, F.col("slice").alias("ref_slice"), F.col("block").alias("ref_block"), F.col("items").alias("ref_items"))
    other = (F.col("q_slice") != F.col("ref_slice")) | (F.col("q_block") != F.col("ref_block"))
    across = (
        shuffled(queries).join(refs, [*by, "ref_slice"]).filter(other)
        .select(*by, "items", "ref_items")
        .mapInArrow(nearest_in_blocks(by, keep, unpack, True), schema)
    )
    return own.unionByName(across)


def knn(
    df: DataFrame,
    by: Sequence[str],
    words: Column,
    norm: Column,
    k: int,
    packed_bits: bool,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(by…, row_id, neighbours array<struct<d, id>>)``: the k nearest other rows of each row.

    ``norm`` is a number whose difference between two vectors bounds their
    distance from below: the count of set bits for Hamming distance (bound
    ``|a - b|``), the Euclidean norm otherwise (bound ``(a - b)²``).
    """
    by, keep = list(by), k + 1
    unpack = WORD_BITS if packed_bits else 0
    rows = df.select(*by, "row_id", words.alias("words"), norm.cast("double").alias("norm"))

    # 1. copies
    first = Window.partitionBy(*by, "words").orderBy("row_id")
    vectors = (
        rows.withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= keep)
        .groupBy(*by, "words")
        .agg(F.array_sort(F.collect_list("row_id")).alias("ids"), F.first("norm").alias("norm"))  # at most k + 1
    )
    vectors = materialise(vectors, "vectors")  # read three times below

    schema = T.StructType([*[df.schema[c] for c in by], *PAIR_FIELDS])
    span, table = pinned_table(vectors.groupBy(*by).agg(
        F.min("norm").alias("_lo"), F.max("norm").alias("_hi"), F.count(F.lit(1)).alias("_m")
    ))
    if table is not None and max(table.column("_m").to_pylist(), default=0) <= block_rows:
        # every group fits one block: there is nothing to slice and nothing to pair
        blocks = vectors.groupBy(*by).agg(F.collect_list(F.struct("words", "ids")).alias("items"))
        found = blocks.mapInArrow(nearest_in_blocks(by, keep, unpack, False), schema)
    else:
        found = _across_blocks(vectors, span, by, keep, unpack, block_rows, schema)

    # 5. the best of all
    order = Window.partitionBy(*by, "q").orderBy("d", "id")
    best = (
        found.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= keep)
        .groupBy(*by, "q").agg(F.array_sort(F.collect_list(F.struct("d", "id"))).alias("_near"))
    )
    # back to rows: copies of one vector may be many, so their key is salted
    salts = F.explode(F.sequence(F.lit(0), F.lit(COPY_SALTS - 1)))
    answers = (
        shuffled(vectors.select(*by, "words", F.col("ids")[0].alias("q"))).join(best, [*by, "q"])
        .withColumn("_salt", salts).drop("q")
    )
    others = F.filter("_near", lambda n: n["id"] != F.col("row_id"))
    return (
        shuffled(rows.withColumn("_salt", F.pmod(F.col("row_id"), F.lit(COPY_SALTS)).cast("int")))
        .join(answers, [*by, "words", "_salt"])
        .select(*by, "row_id", F.slice(others, 1, k).alias("neighbours"))
    )


def knn_hamming(df: DataFrame, by: Sequence[str], k: int = 5, width: int = 167, **options) -> DataFrame:
    """k nearest rows by the number of differing bits."""
    return knn(df, by, packed(F.col("bits"), width), F.size("bits"), k, True, **options)


def on_grid(features: Column, scale: float = 1000.0) -> Column:
    """Real features rounded to whole multiples of ``1 / scale``."""
    return F.transform(features, lambda x: F.round(x.cast("double") * F.lit(scale)).cast("bigint"))


def knn_euclid(df: DataFrame, by: Sequence[str], k: int = 5, scale: float = 1000.0, **options) -> DataFrame:
    """k nearest rows by squared Euclidean distance on the rounded grid."""
    gridded = df.withColumn("_grid", on_grid(F.col("features"), scale))
    squares = F.aggregate("_grid", F.lit(0).cast("bigint"), lambda a, x: a + x * x)
    return knn(gridded, by, F.col("_grid"), F.sqrt(squares.cast("double")), k, False, **options)


def ranked(neighbours: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per neighbour: ``(by…, row_id, nn_rank, neighbour_id, distance)``."""
    return neighbours.select(*by, "row_id", F.posexplode("neighbours").alias("_pos", "n")).select(
        *by, "row_id", (F.col("_pos") + 1).alias("nn_rank"),
        F.col("n.id").alias("neighbour_id"), F.col("n.d").alias("distance"),
    )
