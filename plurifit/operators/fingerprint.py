"""Hashed 0/1 fingerprints of a text column, five families.

These are text analogues of the five families the names stand for: same widths,
same column names, same treatment of texts that cannot be encoded, but they read
characters and tokens and carry no chemistry.

A row depends on its own text alone: keys are looked for by built-in functions,
the hashed families are worked out batch by batch (``fingerprint_kernels``), so
encoding is one pass over the scan and shuffles nothing.  A fingerprint is the
sorted array of its set positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fingerprint_kernels import encoder
from .prepare import parseable, reject_reason

# Family names and widths.
WIDTHS = {"MACCS": 167, "Morgan": 1024, "RDKit": 2048, "Layered": 2048, "Pattern": 2048}

# The hash is polynomial over a Mersenne prime, so that any engine
# with 64-bit integers gives the same bits.
PRIME = 2147483647
BASE = 1000003
MAX_PATH = 7
LAYER_PATH = 3
RADIUS = 2
LENGTH_CLASSES = 12
WORD_BITS = 62

LETTERS = "etaoinshrdlu"
DIGITS = "0123456789"
MARKS = ".,;:!?-'\"()#"


def default_keys() -> list[str]:
    """166 literal keys: pairs of the twelve commonest letters, the digits, twelve marks."""
    return [a + b for a in LETTERS for b in LETTERS] + list(DIGITS) + list(MARKS)


def dictionary_bits(structure: str, keys: Sequence[str] | None = None, regex: bool = False) -> Column:
    """Position ``i`` is set when key ``i`` (from 1) occurs; position 0 stays unused."""
    keys = list(keys or default_keys())
    if len(keys) > WIDTHS["MACCS"] - 1:
        raise ValueError(f"at most {WIDTHS['MACCS'] - 1} keys, got {len(keys)}")
    test = "rlike" if regex else "contains"
    quoted = [key.replace("\\", "\\\\").replace("'", "\\'") for key in keys]
    hits = ", ".join(f"IF({test}({structure}, '{key}'), {i}, NULL)" for i, key in enumerate(quoted, start=1))
    return F.expr(f"array_compact(array({hits}))")


def _check(family: str) -> None:
    if family not in WIDTHS:
        raise ValueError(f"unknown fingerprint family {family!r}; known: {', '.join(WIDTHS)}")


def fingerprint(compounds: DataFrame, family: str = "MACCS", min_length: int = 30) -> DataFrame:
    """``(row_id, bits, fp)`` of every structure that can be encoded."""
    return fingerprints(compounds, [family], min_length)


def fingerprints(compounds: DataFrame, families: Sequence[str] = tuple(WIDTHS), min_length: int = 30) -> DataFrame:
    """Several families from one pass: texts are read and split once.

    * MACCS: the keys that occur in the lower-case text, folded once per row.
    * Morgan: windows of radius 0, 1 and 2 around every token, clipped at the ends. Inside a text these are its runs of 1, 3 and 5
      tokens; at the ends they are the shorter runs that start or finish it.
    * RDKit: runs of one to seven tokens.
    * Layered: runs of one to three tokens seen through three layers: as they are, case folded, by length.
    * Pattern: runs of three characters.
    """
    families = list(families)
    for family in families:
        _check(family)
    good = compounds.select("row_id", "structure").filter(parseable(F.col("structure"), min_length))
    lower = good.withColumn("lower", F.lower("structure"))
    keys = dictionary_bits("lower")
    if set(families) <= {"MACCS"}:
        return lower.select("row_id", keys.alias("bits"), F.lit("MACCS").alias("fp"))
    # only what a wanted family reads goes to the task
    read = ["row_id", "structure", *(["lower"] if "Layered" in families else [])]
    ready = lower.select(*read, *([keys.alias("dictionary")] if "MACCS" in families else []))
    work = encoder(families, WIDTHS, BASE, PRIME, MAX_PATH, LAYER_PATH, RADIUS, LENGTH_CLASSES)
    return ready.mapInArrow(work, f"row_id {compounds.schema['row_id'].dataType.simpleString()}, bits array<int>, fp string")


def rejects(compounds: DataFrame, families: Sequence[str] = tuple(WIDTHS), min_length: int = 30) -> DataFrame:
    """Structures no fingerprint was made for, once per family."""
    bad = compounds.select("row_id", reject_reason(F.col("structure"), min_length).alias("reason"))
    return bad.filter("reason IS NOT NULL").withColumn("fp", F.explode(F.array(*[F.lit(f) for f in families])))


def n_words(width: int) -> int:
    return -(-width // WORD_BITS)


def packed(bits: Column, width: int) -> Column:
    """All ``ceil(width / 62)`` words of a fingerprint, zero words included."""
    def word(w: Column) -> Column:
        mine = F.filter(bits, lambda b: F.floor(b / WORD_BITS) == w)
        return F.aggregate(
            mine, F.lit(0).cast("bigint"),
            lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b % WORD_BITS)),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(n_words(width) - 1)), word)


def feature_vector(df: DataFrame, width: int, bits: str = "bits", name: str = "features") -> DataFrame:
    """Adds a sparse ``spark.ml`` vector of the set positions, without leaving the JVM."""
    from pyspark.ml.feature import CountVectorizerModel

    model = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(width)], inputCol="_terms", outputCol=name, binary=True
    )
    return model.transform(df.withColumn("_terms", F.col(bits).cast("array<string>"))).drop("_terms")
