"""Trees, estimators, search, registry and scoring."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from plurifit.operators import fingerprint, sampling, trees
from plurifit.operators import forest_kernels
from plurifit.plans import campaign, estimators, forest, joint, scoring, search
from plurifit.session import scratch_path
from plurifit.sources import registry

WIDTH = 12


@pytest.fixture(scope="module")
def planted(spark):
    """Label = bit 5, except for a few rows."""
    rng = random.Random(6)
    rows = []
    for i in range(150):
        bits = sorted(rng.sample(range(WIDTH), 5))
        rows.append(("a", "MACCS", i, int(5 in bits) if i % 15 else int(5 not in bits), bits))
    return spark.createDataFrame(rows, "assay string, fp string, row_id long, hit int, bits array<int>").cache()


def grown(rows, need, leaf, depth, criterion="gini"):
    """Plain recursive tree: leaves as (rows, positives)."""
    n, n1 = len(rows), sum(y for y, _ in rows)
    if depth == 0 or n1 in (0, n) or n < need:
        return [(n, n1)]

    def impurity(part):
        p = sum(y for y, _ in part) / len(part)
        return 2 * p * (1 - p)

    best = None
    for bit in range(WIDTH):
        on, off = [r for r in rows if bit in r[1]], [r for r in rows if bit not in r[1]]
        if min(len(on), len(off)) < max(leaf, 1):
            continue
        g = round(impurity(rows) - (len(on) * impurity(on) + len(off) * impurity(off)) / n, 10)
        if best is None or g > best[0]:
            best = (g, on, off)
    if best is None:
        return [(n, n1)]
    return grown(best[1], need, leaf, depth - 1) + grown(best[2], need, leaf, depth - 1)


@pytest.mark.parametrize("leaf, split, depth", [(1, 2, 3), (3, 2, None), (1, 4, None)])
def test_levelwise_tree_against_recursion(planted, leaf, split, depth):
    params = [{"min_samples_leaf": leaf, "min_samples_split": split, "max_depth": depth}]
    rules = trees.growth_rules(params)
    nodes = trees.grow(planted.withColumn("train", F.lit(True)), ["assay"], rules)
    got = sorted((r.n, r.n1) for r in trees.cut_off(nodes, depth).collect())
    rows = [(r.hit, set(r.bits)) for r in planted.collect()]
    assert got == sorted(grown(rows, max(split, 2 * leaf), leaf, depth or 99))


def test_joint_refit_equals_single_refit(planted):
    keyed = planted.withColumn("fp", F.lit("MACCS"))
    both = keyed.unionByName(keyed.withColumn("assay", F.lit("b")).withColumn("hit", F.col("bits")[0] % 2))
    train, test = both.filter("row_id % 5 <> 0").cache(), both.filter("row_id % 5 = 0").cache()
    params = [{"max_depth": 1}, {"max_depth": None, "criterion": "entropy", "min_samples_leaf": 2}]
    chosen = {("a", "MACCS"): {"param_idx": 0}, ("b", "MACCS"): {"param_idx": 1}}
    for (assay, fp), (fitted, tested) in campaign.final_trees(train, test, chosen, params).items():
        mine = F.col("assay") == assay
        single, expected = campaign.fit_final(
            train.filter(mine), test.filter(mine), "dt", params[chosen[(assay, fp)]["param_idx"]], WIDTH
        )
        assert tested == pytest.approx(expected)
        assert campaign.evaluate(fitted, test.filter(mine)) == pytest.approx(expected)


def test_best_bit_agrees_with_spark_tree(planted):
    best = trees.best_split(trees.split_scan(planted, ["assay"]), ["assay"]).first()
    data = fingerprint.feature_vector(planted, WIDTH).withColumn("label", F.col("hit").cast("double"))
    model = DecisionTreeRegressor(maxDepth=1, maxBins=2, labelCol="label").fit(data)
    assert best.bit == 5 and "feature 5" in model.toDebugString
    entropy = trees.best_split(trees.split_scan(planted, ["assay"], "entropy"), ["assay"]).first()
    assert entropy.bit == 5


def test_tree_scores_are_leaf_shares(planted):
    fitted = estimators.fit(planted, "dt", {"max_depth": 2}, WIDTH)
    scored = fitted.score(planted).select("hit", "score", "prediction").collect()
    assert len(scored) == 150 and all(0 <= r.score <= 1 and r.prediction == int(r.score > 0.5) for r in scored)
    assert sum(r.hit == r.prediction for r in scored) >= 135


@pytest.mark.parametrize("model, params", [
    ("logistic", {"C": 1, "penalty": "l2"}),
    ("rf", {"n_estimators": 5, "max_features": "sqrt"}),
    ("gbt", {"learning_rate": 0.1, "n_estimators": 5, "max_depth": 2}),
    ("xgb", {"min_child_weight": 1, "max_depth": 3, "gamma": 0.0, "n_estimators": 5}),
    ("pls", {"n_components": 2}),
])
def test_families_learn_the_rule_and_survive_saving(spark, planted, model, params):
    fitted = estimators.fit(planted, model, params, WIDTH)
    scored = fitted.score(planted.select("row_id", "hit", "bits")).cache()
    assert scored.filter("hit = prediction").count() > 120
    root = scratch_path(spark, "models")
    registry.save_model(spark, fitted, root, "a", "MACCS", model)
    entry = registry.registry(spark, root).first()
    again = registry.load_model(spark, entry.kind, entry.path, WIDTH).score(planted.select("row_id", "bits"))
    assert again.select("row_id", "prediction").exceptAll(scored.select("row_id", "prediction")).count() == 0


def test_any_estimator_with_and_without_seed(planted):
    for estimator in (LogisticRegression(), RandomForestClassifier(numTrees=3)):
        fitted = estimators.fit(planted, estimator, {"regParam": 0.1} if not estimator.hasParam("seed") else {"maxDepth": 2}, WIDTH, seed=7)
        assert fitted.score(planted).count() == 150


def test_unknown_model():
    with pytest.raises(ValueError):
        estimators.spark_estimator("svm", {}, 1)


def test_search_keeps_synthetic_rows_out_of_validation(spark, planted):
    folded = sampling.stratified_folds(planted, ["assay", "fp"], 3)
    parts = search.fold_parts(folded, ["assay", "fp"], 3, width=WIDTH).cache()
    assert parts.filter("NOT train AND row_id < 0").count() == 0
    counts = {(r.cv_fold, r.hit): r["count"] for r in parts.filter("train").groupBy("cv_fold", "hit").count().collect()}
    assert all(counts[(f, 0)] == counts[(f, 1)] for f in range(3))
    overlap = parts.filter("train").select("cv_fold", "row_id").intersect(parts.filter("NOT train").select("cv_fold", "row_id"))
    assert overlap.count() == 0
    params = [{"max_depth": d, "min_samples_leaf": leaf} for d in (1, None) for leaf in (1, 3)]
    found = search.cross_validate(folded, ["assay", "fp"], [], "dt", params, 3, parts=parts)
    assert found.count() == 12


def boosted(rows, rule, rounds, measured):
    """Plain boosting: scores of ``measured`` rows after each round."""
    p = sum(y for y, _ in rows) / len(rows)
    start = math.log(p / (1 - p))
    margins, out, scored = [start] * len(rows), [start] * len(measured), []
    for _ in range(rounds):
        ps = [1 / (1 + math.exp(-m)) for m in margins]
        stats = [(y - q, q * (1 - q)) for (y, _), q in zip(rows, ps)]
        penalty = rule.get("leaf_penalty", 0.0)

        def grow(at, depth):
            g, h = sum(stats[i][0] for i in at), sum(stats[i][1] for i in at)
            best = None
            for bit in range(WIDTH) if depth < rule["depth"] else ():
                on, off = [i for i in at if bit in rows[i][1]], [i for i in at if bit not in rows[i][1]]
                if not on or not off:
                    continue
                (ga, ha), (gb, hb) = [[sum(stats[i][k] for i in side) for k in (0, 1)] for side in (on, off)]
                if rule["kind"] == "gbt":
                    gain, fits = len(on) * len(off) / len(at) * (ga / len(on) - gb / len(off)) ** 2, True
                else:
                    gain = ga**2 / (ha + penalty) + gb**2 / (hb + penalty) - g**2 / (h + penalty)
                    fits = min(ha, hb) >= rule["min_child_weight"] and gain >= rule["gamma"]
                if fits and gain > 1e-9 and (best is None or round(gain, 10) > best[0]):
                    best = round(gain, 10), bit, on, off
            if best is None:
                return rule["learning_rate"] * g / (h + penalty)
            return best[1], grow(best[3], depth + 1), grow(best[2], depth + 1)

        def value(tree, bits):
            while isinstance(tree, tuple):
                tree = tree[2] if tree[0] in bits else tree[1]
            return tree

        tree = grow(range(len(rows)), 0)
        margins = [m + value(tree, b) for m, (_, b) in zip(margins, rows)]
        out = [m + value(tree, b) for m, (_, b) in zip(out, measured)]
        scored.append([1 / (1 + math.exp(-m)) for m in out])
    return scored


@pytest.mark.parametrize("rows_per_task", [65536, 0])
@pytest.mark.parametrize("model, params", [
    ("gbt", [{"learning_rate": r, "n_estimators": n, "max_depth": d} for r in (0.05, 0.1) for n in (2, 4) for d in (1, 3)]),
    ("xgb", [{"min_child_weight": w, "max_depth": d, "gamma": g, "n_estimators": 3} for w in (1, 5) for d in (3, 6) for g in (0.0, 1.0)]),
])
def test_joint_boosting_against_plain(spark, planted, monkeypatch, rows_per_task, model, params):
    monkeypatch.setattr(joint, "ROWS_PER_TASK", max(rows_per_task, 1))
    parts = planted.withColumn("train", F.col("row_id") % 5 != 0).withColumn("cv_fold", F.col("row_id") % 2)
    seen = {}
    real = joint._measured
    monkeypatch.setattr(joint, "_measured", lambda scores, by: seen.setdefault("s", scores.cache()) and real(scores, by))
    found = joint.search_boosted(parts, ["assay", "fp"], model, params, WIDTH)
    assert found.count() == 2 * len(params)
    got = {}
    for r in seen["s"].collect():
        got.setdefault((r.cv_fold, r.param_idx), []).append((r.y, round(r.score, 8)))
    for fold in (0, 1):
        rows = [(r.row_id, r.hit, set(r.bits)) for r in planted.collect() if r.row_id % 2 == fold]
        train, held = [(y, b) for i, y, b in rows if i % 5], [(y, b) for i, y, b in rows if not i % 5]
        for i, p in enumerate(params):
            plain = boosted(train, joint.rule_of(model, p), p["n_estimators"], held)[-1]
            assert sorted(got[fold, i]) == sorted((y, round(s, 8)) for (y, _), s in zip(held, plain))


def test_joint_linear_fits_agree_with_single_ones(spark, planted):
    parts = planted.select("assay", "fp", "row_id", "hit", "bits", F.lit(True).alias("train"), F.lit(0).alias("cv_fold")).cache()
    params = [{"C": c, "penalty": p} for c in (0.1, 1, 20) for p in ("l1", "l2")]
    blocks = joint.Blocks(parts, ["assay", "fp", "cv_fold"], WIDTH, 1)
    weights = joint.newton(blocks, params)[0]
    for i, p in enumerate(params):
        single = estimators.fit(planted, "logistic", p, WIDTH).model
        expected = [*single.coefficients.toArray(), single.intercept]
        assert list(weights[:, i]) == pytest.approx(expected, abs=2e-3)
    assert any(w == 0 for w in weights[:-1, 0])


def test_search_resumes_from_the_store(spark, planted):
    folded = sampling.stratified_folds(planted, ["assay", "fp"], 3).cache()
    store = scratch_path(spark, "store")
    params = [{"C": c, "penalty": "l2"} for c in (1, 10)]
    one = [{"assay": "a", "fp": "MACCS"}]
    first = search.cross_validate(folded, ["assay", "fp"], one, "logistic", params[:1], 3, None, width=WIDTH, store=store)
    second = search.cross_validate(folded, ["assay", "fp"], one, "logistic", params, 3, None, width=WIDTH, store=store)
    assert first.count() == 3 and second.count() == 6 and {r.param_idx for r in second.collect()} == {0, 1}


def test_campaign_and_scoring_of_a_request(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "omega", "zz9", "qu3"]
    texts = [(i, " ".join(rng.choices(words[:5], k=8)) + (" zz9" if i % 3 == 0 else "")) for i in range(150)]
    items = spark.createDataFrame([*texts, (900, "short")], "row_id long, structure string")
    hits = spark.createDataFrame(
        [(i, "rule", int(i % 3 == 0)) for i, _ in texts] + [(i, "one", 1) for i in range(20)], "row_id long, assay string, hit int"
    )
    root = scratch_path(spark, "campaign")
    out = {r.assay: r for r in campaign.run(
        items, hits, models={"dt": {"max_depth": [1, 2]}, "pls": {"n_components": [2]}}, k=3, save_to=root
    ).collect()}
    assert out["rule"].status == "ok" and out["rule"].test_f1 > 0.95 and out["one"].status == "one class"
    known = registry.registry(spark, root)
    asked = spark.createDataFrame(
        [("rule", "pls", "MACCS", 0), ("rule", "dt", "MACCS", 1), ("gone", "dt", "MACCS", 2), ("rule", "dt", "ECFP", 3)],
        "assay_name string, Model string, MF string, request_pos long",
    )
    rows, marked = scoring.plan_requests(asked, known, spark.createDataFrame([("MACCS",)], "fp string"))
    assert [(r["assay_name"], r["Model"]) for r in rows] == [("rule", "dt")]
    assert {r.request_pos: r.reason for r in marked.collect()} == {0: "ok", 1: "ok", 2: "no model", 3: "no model"}
    wide = scoring.score_wide(items, asked, known)
    assert wide.columns == ["row_id", "structure", "rule"] and wide.count() == 150
    assert scoring.score_wide(items, asked.limit(0), known).count() == 0


def plain_forest(rows, rule, n_trees, measured, seed=42):
    """Forest by recursion over Python lists; only the hashed draws are shared with the operator."""
    def order(node):
        drawn = forest_kernels.mix(forest_kernels.salted(np.arange(WIDTH), 4) ^ np.uint64(node))
        return sorted(range(WIDTH), key=lambda b: int(drawn[b]))

    def gini(part):
        w = sum(c for _, _, c in part)
        p = sum(c for y, _, c in part if y) / w
        return w * 2 * p * (1 - p)

    def grow(part, node):
        w, w1 = sum(c for _, _, c in part), sum(c for y, _, c in part if y)
        best = None
        if 0 < w1 < w and len(part) >= rule["need"]:
            bits = order(node)
            differ = [b for b in bits if 0 < sum(b in s for _, s, _ in part) < len(part)]
            for bit in sorted({*bits[: rule["features"]], *differ[:1]}):
                on, off = [r for r in part if bit in r[1]], [r for r in part if bit not in r[1]]
                if bit not in differ or min(len(on), len(off)) < rule["leaf"]:
                    continue
                gain = round((gini(part) - gini(on) - gini(off)) / w, 8)
                if best is None or gain > best[0]:
                    best = gain, bit, off, on
        if best is None:
            return w1 / w
        left, right = (int(c[0]) for c in forest_kernels.children(np.array([node], np.uint64)))
        return best[1], grow(best[2], left), grow(best[3], right)

    def share(tree, bits):
        while isinstance(tree, tuple):
            tree = tree[2] if tree[0] in bits else tree[1]
        return tree

    out = [0.0] * len(measured)
    for t in range(n_trees):
        drawn = forest_kernels.weights(np.array([i for i, _, _ in rows]), t, seed)
        tree = grow([(y, b, int(c)) for (_, y, b), c in zip(rows, drawn) if c], int(forest_kernels.root(t, seed)[0]))
        out = [s + share(tree, b) / n_trees for s, b in zip(out, measured)]
    return out


@pytest.mark.parametrize("rows_per_task, at_once", [(16384, 50), (12, 5)])
def test_joint_forests_against_plain(spark, planted, monkeypatch, rows_per_task, at_once):
    monkeypatch.setattr(forest, "ROWS_PER_TASK", rows_per_task)
    monkeypatch.setattr(forest, "TREES_AT_ONCE", at_once)
    params = [
        {"n_estimators": n, "criterion": "gini", "min_samples_split": s, "min_samples_leaf": leaf, "max_features": f}
        for n in (2, 3) for s, leaf, f in ((2, 1, "sqrt"), (4, 1, "log2"), (4, 3, "sqrt"))
    ]
    parts = planted.withColumn("train", F.col("row_id") % 5 != 0).withColumn("cv_fold", F.col("row_id") % 2)
    got = {}
    for r in forest.forest_scores(parts, ["assay", "fp", "cv_fold"], params, WIDTH, True, 42).collect():
        got[r.cv_fold, r.param_idx, r.row_id] = r.score
    assert len(got) == 150 * len(params)
    for fold in (0, 1):
        rows = [(r.row_id, r.hit, set(r.bits)) for r in planted.collect() if r.row_id % 2 == fold]
        for i, p in enumerate(params):
            plain = plain_forest([r for r in rows if r[0] % 5], forest.rule_of(p, WIDTH), p["n_estimators"], [b for _, _, b in rows])
            assert [got[fold, i, r[0]] for r in rows] == pytest.approx(plain, abs=1e-9)
    found = forest.search_forests(parts, ["assay", "fp"], params, WIDTH)
    assert found.count() == 2 * len(params)


def test_forest_draws():
    drawn = forest_kernels.weights(np.arange(-50_000, 50_000), 3, 42)
    assert abs(drawn.mean() - 1) < 0.02 and abs((drawn == 0).mean() - 0.3679) < 0.01
    assert (forest_kernels.weights(np.arange(100), 4, 42) != forest_kernels.weights(np.arange(100), 3, 42)).any()


def test_smaller_sizes_are_starts_of_the_largest_fit(planted):
    rows = planted.select("row_id", "hit", "bits")
    forest = estimators.fit(planted, "rf", {"n_estimators": 4}, WIDTH)
    data = fingerprint.feature_vector(rows, WIDTH).orderBy("row_id").collect()
    got = [r.score for r in forest.first(2).score(rows).orderBy("row_id").collect()]
    assert got == pytest.approx([sum(t.predict(r.features) for t in forest.model.trees[:2]) / 2 for r in data])


SEARCHES = {
    "cl_decision_tree": "dt", "cl_logistic": "logistic", "cl_random_forest": "rf", "cl_gbt": "gbt", "cl_regularised_boost": "xgb",
    "cl_pls_da": "pls", "cv_grid_search": "dt", "cv_plain": "dt",
}


@pytest.mark.parametrize("name", SEARCHES)
def test_registered_searches_take_whole_grids_five_folds_both_assays(spark, monkeypatch, name):
    from plurifit.operators import grid
    from plurifit.workload import queries

    class Seen(Exception):
        pass

    def seen(folded, by, campaigns, model, params, k=5, **_):
        assert model == SEARCHES[name] and k == 5
        assert params == grid.expand(grid.GRIDS.get(model, {"n_components": [1, 2]}))
        assert {r.assay for r in folded.select("assay").distinct().collect()} == set(queries.ASSAYS)
        assert {r.fold for r in folded.select("fold").distinct().collect()} == set(range(5))
        assert model == "dt" or {c["assay"] for c in campaigns} == set(queries.ASSAYS)
        raise Seen

    monkeypatch.setattr(queries.search, "cross_validate", seen)
    with pytest.raises(Seen):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")


def test_forest_rows_with_the_same_bits_are_grown_once():
    rng = np.random.default_rng(4)
    few = (rng.random((40, WIDTH)) < 0.4).astype(np.uint8)
    x, hit = few[rng.integers(0, 40, 500)], rng.integers(0, 2, 500)
    weight, rule, start = rng.integers(1, 4, 500), {"features": 4, "leaf": 3, "need": 6}, int(forest_kernels.root(1, 7)[0])
    distinct, which = forest_kernels.distinct_rows(x)
    assert len(distinct) <= 40 and (distinct[which] == x).all()
    packed = np.bincount(which, forest_kernels.packed_draws(hit, weight), len(distinct))
    for one, other in zip(forest_kernels.grow(x, hit, weight, start, rule), forest_kernels.grow_packed(distinct, packed, start, rule)):
        assert one.tolist() == other.tolist()
    assert forest.ROWS_PER_TASK == 2**17  # sums of more rows would not be exact


def counted_over_all_bits(x, packed, node, rule):
    """Growth that sums every bit of every node, level by level."""
    slot, ids = np.zeros(len(x), np.int64), np.array([node], np.uint64)
    bits, first, shares, made = [], [], [], 1
    while len(ids):
        every = np.stack([np.r_[packed[slot == k] @ x[slot == k], packed[slot == k].sum()] for k in range(len(ids))]).astype(np.int64)
        sums = every >> 36, (every >> 18) & 0x3FFFF, every & 0x3FFFF
        best = forest_kernels.choose(rule, ids, *sums)
        split, rank = best >= 0, np.cumsum(best >= 0) - 1
        bits.append(best), shares.append(forest_kernels.share_of(sums[2][:, -1], sums[1][:, -1]))
        first.append(np.where(split, made + 2 * rank, -1))
        made += 2 * int(split.sum())
        live = np.flatnonzero(slot >= 0)
        at = slot[live]
        slot[live] = np.where(split[at], 2 * rank[at] + x[live, np.maximum(best[at], 0)], -1)
        ids = np.stack(forest_kernels.children(ids[split]), axis=1).ravel()
    return [np.concatenate(a).tolist() for a in (bits, first, shares)]


@pytest.mark.parametrize("features", [1, 3, WIDTH])
def test_forest_counts_drawn_bits_only_and_grows_need_once(monkeypatch, features):
    rng = np.random.default_rng(features)
    x = (rng.random((300, WIDTH)) < 0.3).astype(np.uint8)
    hit, weight, start = rng.integers(0, 2, 300), rng.integers(1, 4, 300), int(forest_kernels.root(5, 7)[0])
    distinct, which = forest_kernels.distinct_rows(x)
    packed = np.bincount(which, forest_kernels.packed_draws(hit, weight), len(distinct))
    rules = [{"features": features, "leaf": leaf, "need": need} for leaf, need in ((1, 2), (1, 4), (3, 6), (1, 9))]
    with monkeypatch.context() as m:
        m.setattr(forest_kernels, "choose", lambda *_: pytest.fail("every bit of a node was counted"))
        grown = [[a.tolist() for a in forest_kernels.grow_packed(distinct, packed, start, rule)] for rule in rules]
    assert grown == [counted_over_all_bits(distinct, packed, start, rule) for rule in rules]

    calls, real = [], forest_kernels.grow_counted
    monkeypatch.setattr(forest_kernels, "grow_counted", lambda *a: calls.append(a[3]) or real(*a))
    rows = pa.RecordBatch.from_pydict({
        "problem": pa.array([0] * 300, pa.int32()), "share": pa.array([0] * 300, pa.int32()), "row_id": pa.array(range(300)), "hit": pa.array(hit, pa.int32()),
        "train": pa.array([True] * 300), "bits": pa.array([np.flatnonzero(r).tolist() for r in x], pa.list_(pa.int32())),
    })

    def shares(rules):
        pairs = [(rule, tree, 0) for tree in range(3) for rule in range(len(rules))]
        found = forest_kernels.whole_forests(pairs, rules, [list(range(len(pairs)))], WIDTH, 7, True)([rows])
        return {pairs[b.column("pair")[0].as_py()][0]: b.column("share").to_pylist() for b in found}

    together = shares(rules)
    assert len(calls) == 3 * 2
    assert [together[i] for i in range(4)] == [shares([rule])[0] for rule in rules]
