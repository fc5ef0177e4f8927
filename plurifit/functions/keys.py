"""Deterministic hashed keys.

All pseudo-random choices hang on md5 of plain text, which every SQL engine
computes the same way, and never on row order or partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_BITS = 60


def text_key(*parts: Column | str | int) -> Column:
    """First 60 bits of md5 over the parts joined by ``:``, as a bigint."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def shuffle_key(seed: Column | int, row_id: Column) -> Column:
    """The place of a row in the shuffle that belongs to ``seed``."""
    return text_key(seed if isinstance(seed, Column) else F.lit(seed), row_id)
