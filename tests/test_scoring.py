"""Packed models: the same scores as one model at a time, in plans that do not grow."""

import random

import numpy as np
import pyarrow as pa
import pytest

from plurifit.operators import trees
from plurifit.operators.fingerprint import WIDTHS
from plurifit.plans import campaign, estimators, forest, scoring
from plurifit.session import scratch_path
from plurifit.sources import registry

WIDTH = 12


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = []
    for i in range(300):
        bits = sorted(rng.sample(range(WIDTH), rng.randint(0, 7)))
        made.append((i, int((2 in bits) != (7 in bits)) if i % 9 else i % 2, bits))
    return spark.createDataFrame(made, "row_id long, hit int, bits array<int>").cache()


def plain_walk(nodes, bits):
    """Score of the leaf that a set of bits reaches, by name."""
    import hashlib

    by_name, at = {r.node: r for r in nodes}, trees.ROOT
    while by_name[at].bit is not None:
        bit = by_name[at].bit
        at = hashlib.md5(f"{at}>{bit}>{int(bit in bits)}".encode()).hexdigest()
    return by_name[at].n1 / by_name[at].n


@pytest.mark.parametrize("depth", [0, 1, 3, None])
def test_packed_tree_against_plain_walk_and_joins(rows, depth):
    fitted = estimators.fit(rows, "dt", {"max_depth": depth}, WIDTH)
    nodes = fitted.nodes.collect()
    got = {r.row_id: (r.score, r.prediction) for r in fitted.score(rows).collect()}
    assert len(got) == 300
    for r in rows.collect():
        expected = plain_walk(nodes, set(r.bits))
        assert got[r.row_id] == (expected, int(expected > 0.5))
    joined = trees.predict_by_level(rows, fitted.nodes).select("row_id", "score", "prediction")
    assert {r.row_id: (r.score, r.prediction) for r in joined.collect()} == got


def test_a_tree_too_large_to_send_is_walked_by_joins(rows, monkeypatch):
    fitted = estimators.fit(rows, "dt", {"max_depth": 3}, WIDTH)
    nodes = fitted.nodes.cache()
    expected = {r.row_id: r.score for r in trees.predict(rows, nodes).collect()}
    monkeypatch.setattr(trees, "ACTIVE_NODES", 3)
    assert trees.packed(nodes) is None
    assert {r.row_id: r.score for r in trees.predict(rows, nodes).collect()} == expected


def test_odd_rows(spark, rows):
    """No bits, bits beyond every model, null bits, no rows, clashing names."""
    fitted = estimators.fit(rows, "dt", {"max_depth": 2}, WIDTH)
    odd = spark.createDataFrame([(1, []), (2, [900]), (3, None)], "row_id long, bits array<int>")
    got = {r.row_id: r.score for r in fitted.score(odd).collect()}
    assert got[1] == got[2] == plain_walk(fitted.nodes.collect(), set()) and got[3] is None
    assert fitted.score(odd.limit(0)).count() == 0


def test_models_of_all_kinds_in_one_pass(rows):
    models = [
        estimators.fit(rows, "dt", {"max_depth": 4}, WIDTH),
        estimators.fit(rows, "logistic", {"C": 1, "penalty": "l2"}, WIDTH),
        estimators.fit(rows, "gbt", {"learning_rate": 0.1, "n_estimators": 5, "max_depth": 2}, WIDTH),
        estimators.fit(rows, "xgb", {"min_child_weight": 1, "max_depth": 3, "gamma": 0.0, "n_estimators": 5}, WIDTH),
        estimators.fit(rows, "pls", {"n_components": 2}, WIDTH),
    ]
    together = trees.scored_by(rows, [m.packed() for m in models]).orderBy("row_id").collect()
    for i, m in enumerate(models):
        alone = m.score(rows).orderBy("row_id").collect()
        assert [r._scores[i].score for r in together] == pytest.approx([r.score for r in alone], abs=1e-9)
        assert [r._scores[i].prediction for r in together] == [r.prediction for r in alone]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_grows_neither_with_depth_nor_with_models(spark):
    width = WIDTHS["MACCS"]
    rng = random.Random(5)
    data = spark.createDataFrame(
        [(i, rng.randint(0, 1), sorted(rng.sample(range(width), 20))) for i in range(200)], "row_id long, hit int, bits array<int>"
    ).cache()
    compounds = spark.range(20).selectExpr("id AS row_id", "concat(repeat('many plain words here ', 3), id) AS structure")
    root, seen = scratch_path(spark, "models"), []
    for n, depth in ((2, 1), (6, None)):
        for i in range(n):
            registry.save_model(spark, estimators.fit(data, "dt", {"max_depth": depth}, width), root, f"a{i}", "MACCS", "dt")
        asked = spark.createDataFrame([(f"a{i}", "dt", "MACCS", i) for i in range(n)], "assay_name string, Model string, MF string, request_pos bigint")
        wide = scoring.score_wide(compounds, asked, registry.registry(spark, root))
        assert wide.columns == ["row_id", "structure", *[f"a{i}" for i in range(n)]] and wide.count() == 20
        text = plan(wide)
        seen.append((text.count("ArrowEvalPython"), text.count("Join"), text.count("Exchange"), text.count("Project")))
    assert seen[0] == seen[1] and seen[0][0] == 1


def test_packing_level_order():
    from plurifit.operators import score_kernels as kernels

    tree, = kernels.pack_levels([[3, -1, 1, -1, -1, -1, -1]], [[0.0, 5.0, 0.0, 0.0, 0.0, 7.0, 9.0]])
    model = kernels.tree_model([tree], "logit")

    class Sent:
        value = [model]

    got = kernels.scorer(Sent)(pa.array([[1], [3], [1, 3]], pa.list_(pa.int32()))).to_pylist()
    assert [r[0]["score"] for r in got] == pytest.approx([1 / (1 + np.exp(-v)) for v in (5.0, 7.0, 9.0)])


@pytest.mark.parametrize("rows_per_task", [40, 16_384])
def test_refitted_forest_is_the_searched_one(spark, rows, monkeypatch, rows_per_task):
    monkeypatch.setattr(forest, "ROWS_PER_TASK", rows_per_task)
    monkeypatch.setattr(forest, "TREES_AT_ONCE", 4)
    params = {"n_estimators": 6, "max_features": "sqrt", "min_samples_split": 8, "min_samples_leaf": 2}
    parts = rows.selectExpr("'a' AS assay", "row_id", "hit", "bits", "row_id % 3 > 0 AS train")
    searched = forest.forest_scores(parts, ["assay"], [params], WIDTH, True, 42)
    expected = {r.row_id: r.score for r in searched.collect()}
    fitted, tested = campaign.fit_final(rows.filter("row_id % 3 > 0"), rows.filter("row_id % 3 = 0"), "rf", params, WIDTH)
    assert fitted.kind == "forest" and tested["accuracy"] > 0.5
    assert {r.row_id: r.score for r in fitted.score(rows).collect()} == expected
    root = scratch_path(spark, "models")
    registry.save_model(spark, fitted, root, "a", "MACCS", "rf")
    entry = registry.registry(spark, root).first()
    again = registry.load_model(spark, entry.kind, entry.path, WIDTH)
    assert {r.row_id: r.score for r in again.score(rows).collect()} == expected


def test_a_forest_that_draws_no_row_scores_zero(spark):
    none = spark.createDataFrame([], "row_id long, hit int, bits array<int>")
    fitted, tested = campaign.fit_final(none, none, "rf", {"n_estimators": 2}, WIDTH)
    one = spark.createDataFrame([(1, [3])], "row_id long, bits array<int>")
    assert [r.score for r in fitted.score(one).collect()] == [0.0]
