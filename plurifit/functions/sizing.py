"""Broadcasts behind a check of the row count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000


def pinned(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Evaluate ``df`` once if it has at most ``max_rows`` rows.

    Returns the frame to use from here on and whether it is known to be small.
    A small one comes back as literal rows: it is not computed again by later
    jobs, and Spark knows its true size.  A larger one comes back unchanged, so
    the joins that use it stay shuffled joins.
    """
    frame, table = pinned_table(df, max_rows)
    return frame, table is not None


def pinned_table(df: DataFrame, max_rows: int = BROADCAST_ROWS):
    """Like ``pinned``, with the Arrow table of the rows (``None`` for a large frame)."""
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df, None
    return df.sparkSession.createDataFrame(rows, df.schema), rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when its counted size allows one."""
    frame, small = pinned(df, max_rows)
    return F.broadcast(frame) if small else frame


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for joins of rows that grow with the data: neither side is broadcast, however small the planner takes it for."""
    return df.hint("merge")
