"""Splits, folds, neighbours and balancing."""

import random

import pytest
from pyspark.sql import functions as F

from plurifit.operators import balance, neighbours, sampling


def hits(spark, n, positives):
    return spark.range(n).selectExpr("id AS row_id", "'a' AS assay", f"int(id < {positives}) AS hit")


@pytest.mark.parametrize("n, test", [(314, 63), (15, 3), (1, 1), (10, 2)])
def test_split_sizes(spark, n, test):
    split = sampling.train_test_split(hits(spark, n, 3), ["assay"])
    assert split.filter("split = 'test'").count() == test and split.count() == n


def test_split_does_not_depend_on_order(spark):
    df = hits(spark, 200, 20)
    one = {tuple(r) for r in sampling.train_test_split(df, ["assay"]).select("row_id", "split").collect()}
    other = {tuple(r) for r in sampling.train_test_split(df.orderBy(F.desc("row_id")).repartition(3), ["assay"]).select("row_id", "split").collect()}
    assert one == other
    third = {tuple(r) for r in sampling.train_test_split(df, ["assay"], 7).select("row_id", "split").collect()}
    assert third != one


def test_stratified_split_is_exact(spark):
    rows = sampling.stratified_split(hits(spark, 101, 13), ["assay"]).groupBy("split", "hit").count().collect()
    got = {(r.split, r.hit): r["count"] for r in rows}
    assert got[("test", 0)] + got[("test", 1)] == 21 and got[("test", 1)] == 3


@pytest.mark.parametrize("shuffle", [True, False])
def test_folds_are_even(spark, shuffle):
    rows = sampling.stratified_folds(hits(spark, 103, 17), ["assay"], shuffle=shuffle).collect()
    for label in (0, 1):
        sizes = [sum(r.fold == f and r.hit == label for r in rows) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    totals = [sum(r.fold == f for r in rows) for f in range(5)]
    assert len(rows) == 103 and max(totals) - min(totals) <= 1


def test_ordered_folds_with_scattered_ids(spark):
    """Keys far apart need several rounds of narrowing."""
    ids = sorted({random.Random(1).randrange(2**50) for _ in range(200)} | set(range(100)))
    df = spark.createDataFrame([(i, "a", 1) for i in ids], "row_id long, assay string, hit int")
    got = {r.row_id: r.fold for r in sampling.stratified_folds(df, ["assay"], shuffle=False).collect()}
    sizes = [len(range(f, len(ids), 5)) for f in range(5)]
    expected = [f for f, size in enumerate(sizes) for _ in range(size)]
    assert [got[i] for i in ids] == expected


def brute(rows, k, distance):
    out = {}
    for i, a in rows.items():
        near = sorted((distance(a, b), j) for j, b in rows.items() if j != i)[:k]
        out[i] = near
    return out


@pytest.mark.parametrize("block", [512, 7])
def test_hamming_neighbours_against_brute_force(spark, block):
    rng = random.Random(3)
    rows = {i: sorted(rng.sample(range(70), rng.randrange(0, 30))) for i in range(120)}
    for i in range(40):  # a third of all rows are copies of one
        rows[200 + i] = rows[0]
    df = spark.createDataFrame([("a", i, b) for i, b in rows.items()], "assay string, row_id long, bits array<int>")
    got = {r.row_id: [(n.d, n.id) for n in r.neighbours] for r in neighbours.knn_hamming(df, ["assay"], 5, 70, block_rows=block).collect()}
    assert got == brute(rows, 5, lambda a, b: len(set(a) ^ set(b)))


@pytest.mark.parametrize("block", [512, 7])
def test_euclidean_neighbours_against_brute_force(spark, block):
    rng = random.Random(4)
    rows = {i: [rng.gauss(0, 1) for _ in range(5)] for i in range(100)}
    df = spark.createDataFrame([("a", i, v) for i, v in rows.items()], "assay string, row_id long, features array<double>")
    grid = {i: [int(x * 1000 + (0.5 if x > 0 else -0.5)) for x in v] for i, v in rows.items()}
    got = {r.row_id: [(n.d, n.id) for n in r.neighbours] for r in neighbours.knn_euclid(df, ["assay"], 4, block_rows=block).collect()}
    assert got == brute(grid, 4, lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)))


def test_balanced_classes_and_bits(spark):
    rng = random.Random(5)
    data = [("a", i, int(i < 12), sorted(rng.sample(range(40), 15))) for i in range(60)]
    df = spark.createDataFrame(data, "assay string, row_id long, hit int, bits array<int>")
    out = balance.balanced(df, ["assay"], width=40).collect()
    assert sum(r.hit for r in out) == 48 and len(out) == 96
    bits = {i: set(b) for _, i, _, b in data}
    for r in balance.synthetic_rows(df, ["assay"], width=40).collect():
        assert set(r.bits) == bits[r.base_id] & bits[r.neighbour_id] and r.hit == 1


def test_too_small_a_class_yields_nothing(spark):
    df = spark.createDataFrame([("a", i, int(i < 5), [i]) for i in range(30)], "assay string, row_id long, hit int, bits array<int>")
    assert balance.synthetic_rows(df, ["assay"], width=40).count() == 0


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        balance.synthetic_rows(hits(spark, 3, 1), ["assay"], mode="swap")
