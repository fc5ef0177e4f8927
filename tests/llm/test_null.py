"""The null of the randomness battery: counted in part, with the decisions of the whole null."""

import random

import pytest
from pyspark.sql import functions as F

from plurifit.llm import secrets


def prose(rng, n):
    return "".join(rng.choice("eeeettaaoinshrdlucmfwypvbgkqjxz") for _ in range(n))


def run_of(rng, n, kind):
    if kind == "prose":
        return prose(rng, n)
    if kind == "near":
        return "".join(rng.choice(secrets.ALPHABET[:36]) for _ in range(n))
    return "".join(rng.choice({"hex": "0123456789abcdef", "upper": secrets.BASE32}.get(kind, secrets.ALPHABET)) for _ in range(n))


@pytest.mark.parametrize("seed, kinds, rate", [
    (1, ["prose"], 0.05), (2, ["prose", "random"], 0.05), (3, ["prose", "near", "near"], 0.05), (4, ["random"], 0.05), (5, ["prose", "hex", "upper"], 0.2), (6, ["near"], 0.5),
])
def test_counted_in_part_decides_like_the_whole(spark, seed, kinds, rate):
    rng = random.Random(seed)
    stretches = spark.createDataFrame([(c, run_of(rng, c, rng.choice(kinds))) for c in (20, 32, 64) for _ in range(400)], "class int, run string").cache()
    found = [(c, run_of(rng, c, rng.choice(["prose", "near", "random", "random", "hex", "upper"]))) for c in (20, 32, 48) for _ in range(12)]
    candidates = spark.createDataFrame(found, "class int, run string").select("class", secrets.deviate(F.col("run")).alias("deviate")).cache()
    whole = stretches.select("class", secrets.deviate(F.col("run")).alias("deviate"))

    def chosen(limits):
        limits = {r["class"]: r["most"] for r in limits.collect()}
        return sorted((r["class"], r["deviate"]) for r in candidates.collect() if r["deviate"] <= limits.get(r["class"], -1))

    assert chosen(secrets.discoveries(stretches, candidates, rate)) == chosen(secrets.discoveries(whole, candidates, rate))
    assert secrets.discoveries(stretches, candidates.limit(0), rate).count() == 0
    assert secrets.discoveries(stretches.limit(0), candidates, rate).count() == secrets.discoveries(whole.limit(0), candidates, rate).count()


def test_parts_never_exceed_the_deviate(spark):
    rng = random.Random(9)
    runs = [run_of(rng, n, k) for n in secrets.LENGTHS for k in ("prose", "near", "random", "hex", "upper") for _ in range(8)] + ["a" * 20, "0" * 24, "A7" * 16, "ab+/" * 8]
    made = spark.createDataFrame([(r,) for r in runs], "run string").select(
        secrets.lopsided(F.col("run")).alias("lopsided"), secrets.uneven(F.col("run")).alias("uneven"), secrets.deviate(F.col("run")).alias("deviate")
    ).collect()
    assert all(max(r.lopsided, r.uneven) <= r.deviate for r in made)
    assert any(r.lopsided == r.deviate for r in made) and any(r.uneven == r.deviate for r in made)
