"""Work that has to stay bounded on large tables, held against the way it takes on small ones."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plurifit.operators import fingerprint, fingerprint_kernels, joint_kernels, metrics, trees
from plurifit.plans import joint, search

WIDTH = 14


@pytest.fixture(scope="module")
def folds(spark):
    """Two campaigns of noisy labels; some rows are copies, some are only carried along."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        bits = sorted(rng.sample(range(WIDTH), rng.randint(0, 9)))
        hit = int((3 in bits) != (rng.random() < 0.2))
        rows += [(a, hit if a == "a" else 1 - hit, bits, i % 5 > 0) for a in "ab"] * (1 + (i % 7 == 0))
    return spark.createDataFrame(rows, "assay string, hit int, bits array<int>, train boolean").cache()


RULES = trees.growth_rules([
    {"criterion": c, "min_samples_leaf": leaf, "min_samples_split": split} for c in ("gini", "entropy") for leaf in (1, 2, 3) for split in (2, 3, 4)
])


def nodes_of(frame):
    columns = ["assay", "rule", "node", "depth", "n", "n1", "v", "v1", "bit"]
    return sorted(frame.select(*columns).collect(), key=str)


@pytest.mark.parametrize("depth", [None, 0, 3])
def test_subtrees_in_a_task_are_those_of_the_levels(folds, monkeypatch, depth):
    whole = nodes_of(trees.grow(folds, ["assay"], RULES, depth))
    assert {r["rule"] for r in whole} == set(RULES.values())
    for cells in (0, 5000):  # level by level to the end, and a few levels first
        monkeypatch.setattr(trees, "TASK_CELLS", cells)
        assert nodes_of(trees.grow(folds, ["assay"], RULES, depth)) == whole


def test_nodes_that_fit_a_task_need_no_job_per_level(folds, monkeypatch):
    def refused(*_):
        raise AssertionError("a level was counted by a job of its own")

    monkeypatch.setattr(trees, "_level", refused)
    assert max(r["depth"] for r in nodes_of(trees.grow(folds, ["assay"], RULES))) > 5
    assert nodes_of(trees.grow(folds.limit(0), ["assay"], RULES)) == []


TEXTS = [
    "one two  three four five six seven eight", " lead and trail ", "İstanbul ΣΑΣ straße 😀 beyond 𝔘 the plane", "a\tb\nc d", "x" * 40, "y",
    "word " * 50, "ends with spaces   ",
]


def plain_bits(family: str, text: str, lower: str) -> list[int]:
    def hashed(token):
        return int(hashlib.md5(token.encode()).hexdigest()[:15], 16) % fingerprint.PRIME

    def runs(values, n):
        out = []
        for i in range(len(values) - n + 1):
            h = values[i]
            for v in values[i + 1 : i + n]:
                h = (h * fingerprint.BASE + v) % fingerprint.PRIME
            out.append(h)
        return out

    width, words = fingerprint.WIDTHS[family], text.split(" ")
    tokens = [hashed(t) for t in words]
    if family == "RDKit":
        found = [(h, n) for n in range(1, 8) for h in runs(tokens, n)]
    elif family == "Pattern":
        found = [(h, 3) for h in runs([ord(c) for c in text], 3)]
    elif family == "Layered":
        layers = tokens, [hashed(t) for t in lower.split(" ")], [min(len(t), 12) for t in words]
        found = [(h, layer * 100 + n) for layer, values in enumerate(layers, 1) for n in (1, 2, 3) for h in runs(values, n)]
    else:
        found = [(h, r) for r in range(3) for h in runs(tokens, 2 * r + 1)]
        for r, n in ((1, 2), (2, 3), (2, 4)):
            longest = runs(tokens, min(n, len(tokens)))
            found += [(longest[0], r), (longest[-1], r)]
    return sorted({(h + tag * fingerprint.BASE) % width for h, tag in found})


@pytest.mark.parametrize("rows, known", [(1000, 200_000), (2, 3)])
def test_batches_of_texts_give_the_bits_of_each(monkeypatch, rows, known):
    monkeypatch.setattr(fingerprint_kernels, "TEXT_ROWS", rows)
    monkeypatch.setattr(fingerprint_kernels, "KNOWN_TOKENS", known)
    families = ["Morgan", "RDKit", "Layered", "Pattern"]
    lower = [t.lower() for t in TEXTS]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS), pa.array(lower)], names=["row_id", "structure", "lower"])
    work = fingerprint_kernels.encoder(families, fingerprint.WIDTHS, fingerprint.BASE, fingerprint.PRIME, 7, 3, 2, 12)
    got = {(r["row_id"], r["fp"]): r["bits"] for b in work([batch, batch.slice(0, 0)]) for r in b.to_pylist()}
    assert got == {(i, f): plain_bits(f, t, low) for i, (t, low) in enumerate(zip(TEXTS, lower)) for f in families}


def test_hashed_families_leave_the_row_interpreter(spark):
    frame = fingerprint.fingerprints(spark.createDataFrame([(1, "some words " * 9)], "row_id long, structure string"))
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in text and "MapInArrow" in text


@pytest.fixture(scope="module")
def parts(spark):
    rng = random.Random(4)
    rows = []
    for i in range(700):
        bits = sorted(rng.sample(range(WIDTH), rng.randint(1, 9)))
        rows.append(("a", "MACCS", i, int((2 in bits) != (rng.random() < 0.25)), bits, i % 6 > 0, 0))
    return spark.createDataFrame(rows, "assay string, fp string, row_id long, hit int, bits array<int>, train boolean, cv_fold int").cache()


def test_shared_hessians_lead_to_the_same_weights(parts, monkeypatch):
    params = [{"C": c, "penalty": p} for c in (0.1, 0.5, 1, 4, 100) for p in ("l1", "l2")]
    by = ["assay", "fp", "cv_fold"]
    monkeypatch.setattr(joint, "SETTLED", 1e-12)
    own = joint.newton(joint.Blocks(parts, by, WIDTH, 1), params)[0]
    monkeypatch.setattr(joint, "SETTLED", 1e-7)
    monkeypatch.setattr(joint, "ROWS_PER_TASK", 200)
    monkeypatch.setattr(joint, "SHARED_HESSIANS", 2)
    asked, sums = [], joint.kernels.newton_sums
    monkeypatch.setattr(joint.kernels, "newton_sums", lambda sent, width: asked.append({i: len(g) for i, g in sent.value.items()}) or sums(sent, width))
    blocks = joint.Blocks(parts, by, WIDTH, 1)
    assert not blocks.whole
    assert joint.newton(blocks, params)[0] == pytest.approx(own, abs=1e-3)
    assert max(n for step in asked for n in step.values()) == 2


@pytest.mark.parametrize("rows", [joint.ROWS_PER_TASK, 200])
def test_joint_pls_is_that_of_single_fits(parts, monkeypatch, rows):
    monkeypatch.setattr(joint, "ROWS_PER_TASK", rows)
    params, by = [{"n_components": n} for n in (1, 2)], ["assay", "fp"]
    single = search.search_fits(parts, by, [{"assay": "a", "fp": "MACCS"}], "pls", params, k=1, width=WIDTH, with_train=True)

    def refused(*_, **__):
        raise AssertionError("candidates were fitted one by one")

    monkeypatch.setattr(search, "search_fits", refused)
    joined = search.cross_validate(None, by, [], "pls", params, 1, width=WIDTH, with_train=True, parts=parts)
    columns = ["assay", "param_idx", "fold", "part", *metrics.METRICS]
    assert sorted(joined.select(*columns).collect()) == sorted(single.select(*columns).collect())


@pytest.mark.parametrize("cells, masked", [(10**6, 8), (10**6, 1), (0, 8)])
def test_rounds_over_distinct_bit_sets_are_those_over_rows(monkeypatch, cells, masked):
    """Copies count as often as they come; dense products and counts by position choose the same trees."""
    monkeypatch.setattr(joint_kernels, "DENSE_CELLS", cells)
    monkeypatch.setattr(joint_kernels, "MASKED_NODES", masked)
    rng = np.random.default_rng(5)
    x = np.repeat((rng.random((60, WIDTH)) < 0.4).astype(np.uint8), rng.integers(1, 6, 60), axis=0)
    hit, train = (rng.random(len(x)) < 0.3 + 0.5 * x[:, 3]).astype(np.uint8), (rng.random(len(x)) < 0.8)
    block = {"n": len(x), "hit": hit.tobytes(), "train": train.astype(np.uint8).tobytes(), "bits": np.packbits(x, axis=1).tobytes(), "margins": np.full((len(x), 1), 0.2).tobytes()}
    rules = [joint.rule_of("gbt", {"learning_rate": 0.3, "max_depth": 4}), joint.rule_of("xgb", {"max_depth": 3, "gamma": 0.0, "min_child_weight": 1})]
    seen, sums = [], joint_kernels.dense_sums
    monkeypatch.setattr(joint_kernels, "dense_sums", lambda a, *rest: seen.append(len(a)) or sums(a, *rest))
    *_, (_, trees, _, _, margins, of) = joint_kernels._rounds(rules, WIDTH, 3, [0, 1], [block])
    if cells:
        assert set(seen) == {len(np.unique(x, axis=0))}
    for i, rule in enumerate(rules):
        margin = np.full(len(x), 0.2)
        for _ in range(3):
            bit, value = joint_kernels.no_trees(1, rule["depth"])
            stats, ones = joint_kernels.statistics(hit[train], margin[train]), joint_kernels.ones_of(x[train])
            for level in range(rule["depth"]):
                node = joint_kernels.walk(x[train], bit, level)[:, 0] - 2**level + 1
                found = joint_kernels.node_sums(ones, node, stats, 2**level, WIDTH)
                nodes = np.flatnonzero(found[:, 0, WIDTH] > 0)
                if not len(nodes) or not joint_kernels.extend(rule, bit[0], value[0], level, nodes, *joint_kernels.choose(rule, found[nodes])):
                    break
            margin = margin + value[0, joint_kernels.walk(x, bit, rule["depth"])[:, 0]]
        assert np.array_equal(trees[i][0], bit[0]) and margins[of][:, i] == pytest.approx(margin, abs=1e-9)


def test_boosting_adds_up_smaller_halves_only(monkeypatch):
    """A level adds up at most half of the rows of its nodes; what is left of the parent is the same number as the sum over the rows."""
    monkeypatch.setattr(joint_kernels, "PORTION", 37)
    rng = np.random.default_rng(8)
    x = np.unique((rng.random((900, WIDTH)) < 0.4).astype(np.uint8), axis=0)
    hit, train = (rng.random(len(x)) < 0.2 + 0.6 * x[:, 5]).astype(np.uint8), np.arange(len(x)) % 7 > 0
    block = {"n": len(x), "hit": hit.tobytes(), "train": train.astype(np.uint8).tobytes(), "bits": np.packbits(x, axis=1).tobytes(), "margins": np.full((len(x), 1), -0.1).tobytes()}
    rules = [joint.rule_of("gbt", {"learning_rate": 0.2, "max_depth": 6}), joint.rule_of("xgb", {"max_depth": 6, "gamma": 0.0, "min_child_weight": 1})]
    added, real, chosen = [], joint_kernels._Histograms.many, joint_kernels.choose

    def many(self, slot, stats, n_nodes):
        added.append(int((slot >= 0).sum()))
        found = real(self, slot, stats, n_nodes)
        for k in range(n_nodes):
            assert np.array_equal(found[k], stats[:, slot == k] @ self.x[: len(slot)][slot == k].astype(float))
        return found

    levels = []
    monkeypatch.setattr(joint_kernels._Histograms, "many", many)
    monkeypatch.setattr(joint_kernels, "choose", lambda rule, sums: levels.append(sums) or chosen(rule, sums))
    *_, (_, trees, _, _, margins, of) = joint_kernels._rounds(rules, WIDTH, 2, [0, 1], [block])
    assert added and max(added) <= train.sum() / 2
    assert all((s[:, 0] >= 0).all() and s[:, 0, -1].sum() <= train.sum() for s in levels)
    for i, (bit, value) in enumerate(trees):
        assert np.isfinite(margins[of][:, i]).all() and (bit >= 0).sum() > 7


def test_boosted_problems_of_some_blocks_stay_whole(parts, monkeypatch):
    """Up to ``WHOLE_BOOSTED`` times the rows of a task no job per level is needed, and the blocks hold no margins of candidates."""
    params = [{"learning_rate": r, "n_estimators": 3, "max_depth": 3} for r in (0.05, 0.1)]
    expected = joint.search_boosted(parts, ["assay", "fp"], "gbt", params, WIDTH).orderBy("param_idx").collect()
    monkeypatch.setattr(joint, "ROWS_PER_TASK", 100)

    def refused(*_, **__):
        raise AssertionError("a level was a job of its own")

    made, real = [], joint.kernels.make_blocks
    monkeypatch.setattr(joint.kernels, "make_blocks", lambda width, base, candidates: made.append(candidates) or real(width, base, candidates))
    monkeypatch.setattr(joint, "boost", refused)
    assert joint.search_boosted(parts, ["assay", "fp"], "gbt", params, WIDTH).orderBy("param_idx").collect() == expected
    assert made == [1]
