"""Boosted, linear and PLS candidates of all folds and campaigns fitted together.

A problem is one fold of one campaign.  Its rows are packed into blocks once; after
that every level of every round is one job over the blocks, shared by all
candidates of all problems: gradients and hessians are added up per node and bit
within tasks, dealt by problem and candidate, and only the chosen splits reach the
driver, so its share depends on the grid and the depth and not on the rows.
Linear candidates go through Newton steps in the same way, one job per step.

Boosting: squared-error trees on log-loss gradients with Newton leaves (``gbt``),
and second-order trees with leaf penalty, ``gamma`` and ``min_child_weight``
(``xgb``).  Splits that gain nothing are not made; the lowest bit wins a tie.
Margins are kept with the blocks; every few rounds they are written to the shared
folder, so a lost executor repeats a few rounds at most.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joint_kernels as kernels
from ..operators.kernels import pls_coefficients
from ..operators.metrics import all_metrics
from ..session import materialise

# Defaults of the second-order family when a candidate does not set them.
RATE, ROUNDS, LEAF_PENALTY = 0.3, 100, 1.0

ROUNDS_PER_WRITE = 10
ROWS_PER_TASK = 16 * kernels.BLOCK_ROWS
# boosted problems are kept whole up to so many times that number: a task holds a byte for each bit and some numbers for each row
WHOLE_BOOSTED = 8
NEWTON_STEPS = 60
SETTLED = 1e-7
HESSIAN_BYTES = 200_000_000
# in problems spread over tasks, candidates share so many hessians a step; such a step counts as the last only below the second bound
SHARED_HESSIANS = 5
SETTLED_SHARED = 1e-11


def rule_of(model: str, params: Mapping) -> dict:
    """What the growth of a boosted candidate depends on, the number of rounds aside."""
    if model == "gbt":
        return {"kind": "gbt", "learning_rate": float(params["learning_rate"]), "depth": int(params["max_depth"])}
    return {
        "kind": "xgb", "learning_rate": float(params.get("learning_rate", RATE)), "depth": int(params["max_depth"]), "gamma": float(params["gamma"]),
        "min_child_weight": float(params["min_child_weight"]), "leaf_penalty": float(params.get("reg_lambda", LEAF_PENALTY)),
    }


def rounds_of(model: str, params: Mapping) -> int:
    return int(params["n_estimators"] if model == "gbt" else params.get("n_estimators", ROUNDS))


class Blocks:
    """The rows of all problems, packed; ``keys[i]`` names problem ``i``."""

    def __init__(self, parts: DataFrame, by: Sequence[str], width: int, candidates: int, most: int | None = None):
        by, self.spark, self.width = list(by), parts.sparkSession, width
        counts = parts.groupBy(*by).agg(F.count_if("train").alias("n"), F.count_if(F.expr("train AND hit = 1")).alias("n1"), F.count(F.lit(1)).alias("all"))
        counts = counts.orderBy(*by).collect()  # one row for each fold of each campaign
        self.by, self.keys = by, [tuple(r[c] for c in by) for r in counts]
        self.base = {i: math.log(r["n1"] / (r["n"] - r["n1"])) if 0 < r["n1"] < r["n"] else 0.0 for i, r in enumerate(counts)}
        fields = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in by)
        self.numbers = self.spark.createDataFrame([(*k, i) for i, k in enumerate(self.keys)], f"{fields}, problem int")
        n_rows = sum(r["all"] for r in counts)
        n_tasks = max(-(-n_rows // ROWS_PER_TASK), min(len(counts), self.spark.sparkContext.defaultParallelism), 1)
        rows = parts.join(F.broadcast(self.numbers), by).select("problem", "hit", "train", "bits", "row_id")
        # small problems stay whole, so their sums need no shuffle; the rows of large ones are spread over tasks
        self.whole = max((r["all"] for r in counts), default=0) <= (most or ROWS_PER_TASK)
        if self.whole:
            candidates = 1  # margins are made in the task
        spread = ["problem"] if self.whole else ["problem", F.xxhash64("row_id")]
        dealt = rows.repartitionByRange(n_tasks, *spread).sortWithinPartitions("problem", "row_id")
        packed = dealt.select("problem", "hit", "train", "bits").mapInArrow(kernels.make_blocks(width, self.base, candidates), kernels.BLOCK)
        self.n_tasks = n_tasks
        self.frame = self.dealt(materialise(packed, "blocks"))

    def dealt(self, frame: DataFrame) -> DataFrame:
        """Stored blocks, cached; the files of a small problem may be read by several tasks, so it is brought together again."""
        if self.whole:
            frame = frame.repartitionByRange(self.n_tasks, "problem").sortWithinPartitions("problem")
        return frame.persist()

    def summed(self, state: DataFrame, sums, choose) -> list:
        """Sums within tasks, put together by problem and candidate, and what is chosen from them: one row for each of these pairs."""
        if self.whole:
            return state.mapInArrow(kernels.chained(sums, choose), kernels.SPLITS).collect()
        return state.mapInArrow(sums, kernels.SUMS).repartition(self.n_tasks, "problem", "candidate").mapInArrow(choose, kernels.SPLITS).collect()

    def named(self, scores: DataFrame, indices: DataFrame) -> DataFrame:
        """Scores under the names of their campaign, fold and candidate."""
        on = [c for c in ("round", "candidate") if c in indices.columns]
        return scores.join(F.broadcast(self.numbers), "problem").join(F.broadcast(indices), on).drop("problem", *on)


def _grow(state: DataFrame, blocks: Blocks, rules: Sequence[Mapping]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """One tree of every candidate of every problem, as ``(bit, value)`` by problem."""
    sc, width = blocks.spark.sparkContext, blocks.width
    deepest, n_candidates = max(r["depth"] for r in rules), len(rules)
    trees = {i: kernels.no_trees(n_candidates, deepest) for i in range(len(blocks.keys))}
    growing = {i: [c for c, r in enumerate(rules) if r["depth"] > 0] for i in trees}
    for level in range(deepest):
        asked = {i: (numbers, trees[i][0][numbers, : max(2**level - 1, 1)]) for i, numbers in growing.items() if numbers}
        if not asked:
            break
        # nodes of this level have no entry yet: rows that reach them stay there
        padded = {i: (numbers, np.pad(bit, ((0, 0), (0, 2 ** (level + 1) - 1 - bit.shape[1])), constant_values=-1)) for i, (numbers, bit) in asked.items()}
        sent = sc.broadcast(padded)
        found = blocks.summed(state, kernels.tree_sums(sent, width, level), kernels.best_splits(list(rules), width))
        sent.destroy()
        growing = {i: [] for i in trees}
        for r in found:
            rule, (bit, value) = rules[r["candidate"]], (a[r["candidate"]] for a in trees[r["problem"]])
            nodes, best = np.frombuffer(r["nodes"], "<i4"), np.frombuffer(r["bit"], "<i4")
            if kernels.extend(rule, bit, value, level, nodes, best, np.frombuffer(r["parts"]).reshape(len(nodes), 3, 3)):
                growing[r["problem"]].append(r["candidate"])
        growing = {i: sorted(numbers) for i, numbers in growing.items()}
    return trees


def boost(blocks: Blocks, rules: Sequence[Mapping], rounds: int, at_rounds: Sequence[int] = (), measure=None, keep: bool = False) -> list:
    """Rounds of boosting; ``measure(round, state)`` is called after those in ``at_rounds``. Returns the trees if they are to be kept."""
    sc, deepest = blocks.spark.sparkContext, max(r["depth"] for r in rules)
    state, kept, held = blocks.frame, [], []
    for number in range(1, rounds + 1):
        trees = _grow(state, blocks, rules)
        if keep:
            kept.append(trees)
        sent = sc.broadcast(trees)
        held.append((sent, state))
        state = state.mapInArrow(kernels.add_trees(sent, blocks.width, deepest), kernels.BLOCK)
        if number % ROUNDS_PER_WRITE == 0 or number in at_rounds:
            state = blocks.dealt(materialise(state, "margins"))
            for old, frame in held:
                frame.unpersist()
                old.destroy()
            held = []
        else:
            state = state.persist()
        if number in at_rounds:
            measure(number, state)
    return kept


def search_boosted(parts: DataFrame, by: Sequence[str], model: str, params: Sequence[Mapping], width: int, with_train: bool = False) -> DataFrame:
    """``(by…, param_idx, fold, part, five metrics)`` of all boosted candidates. Candidates that differ in their number of rounds share their growth."""
    spark, by = parts.sparkSession, list(by)
    rules, at = [], {}
    for i, p in enumerate(params):
        rule = rule_of(model, p)
        if rule not in rules:
            rules.append(rule)
        at.setdefault(rounds_of(model, p), []).append((rules.index(rule), i))
    indices = spark.createDataFrame([(n, c, i) for n, pairs in at.items() for c, i in pairs], "round int, candidate int, param_idx int")
    blocks = Blocks(parts, [*by, "cv_fold"], width, len(rules), WHOLE_BOOSTED * ROWS_PER_TASK)
    if blocks.whole:
        scores = _boost_whole(blocks, rules, sorted(at), with_train)
    else:
        measured = []

        def measure(number: int, state: DataFrame) -> None:
            measured.append(state.mapInArrow(kernels.margin_scores(with_train), kernels.SCORES).withColumn("round", F.lit(number)))

        boost(blocks, rules, max(at), sorted(at), measure)
        scores = reduce(DataFrame.unionByName, measured)
    return materialise(_measured(blocks.named(scores, indices), by), "measured")


def _shared_out(blocks: Blocks, rules: Sequence[Mapping]) -> DataFrame:
    """Blocks of small problems beside shares of the candidates, one task for each problem and share."""
    n_shares = min(len(rules), max(1, 4 * blocks.spark.sparkContext.defaultParallelism // max(len(blocks.keys), 1)))
    # deep and shallow candidates are dealt evenly
    order = sorted(range(len(rules)), key=lambda c: rules[c]["depth"])
    shares = F.array(*[F.struct(F.lit(s).alias("share"), F.lit(order[s::n_shares]).alias("mine")) for s in range(n_shares)])
    spread = blocks.frame.withColumn("s", F.explode(shares)).select("*", "s.share", "s.mine").drop("s")
    return spread.repartitionByRange(max(len(blocks.keys), 1) * n_shares, "problem", "share").sortWithinPartitions("problem", "share")


def _boost_whole(blocks: Blocks, rules: Sequence[Mapping], at_rounds: Sequence[int], with_train: bool) -> DataFrame:
    """Scores after the given rounds, where every problem is whole."""
    work = kernels.boost_whole(list(rules), blocks.width, max(at_rounds), set(at_rounds), with_train)
    return materialise(_shared_out(blocks, rules).mapInArrow(work, "round int, " + kernels.SCORES), "scores")


def fit_boosted(train: DataFrame, model: str, params: Mapping, width: int) -> tuple[float, list[list[int]], list[list[float]]]:
    """Start and trees, ``(bits, values)`` in level order, of one candidate on ``(row_id, hit, bits)`` rows."""
    rows = train.select(F.lit(0).alias("only"), "row_id", "hit", "bits", F.lit(True).alias("train"))
    blocks, rule, rounds = Blocks(rows, ["only"], width, 1), rule_of(model, params), rounds_of(model, params)
    if not blocks.keys:
        return 0.0, [], []
    if blocks.whole:
        made = _shared_out(blocks, [rule]).mapInArrow(kernels.trees_whole([rule], width, rounds), "round int, " + kernels.SPLITS).collect()  # one row a round
        trees = [(np.frombuffer(r["bit"], "<i2"), np.frombuffer(r["parts"])) for r in sorted(made, key=lambda r: r["round"])]
    else:
        trees = [(t[0][0][0], t[0][1][0]) for t in boost(blocks, [rule], rounds, keep=True)]
    return blocks.base[0], [b.tolist() for b, _ in trees], [v.tolist() for _, v in trees]


def _measured(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    marked = scores.withColumn("part", F.when(F.col("train"), "train").otherwise("val")).withColumn("prediction", F.expr("int(score >= 0.5)"))
    return all_metrics(marked, [*by, "param_idx", "cv_fold", "part"]).withColumnRenamed("cv_fold", "fold")


def newton(blocks: Blocks, rules: Sequence[Mapping]) -> dict[int, np.ndarray]:
    """Weights of every linear candidate of every problem, ``(width + 1, candidates)``, intercept last.

    Each job takes all open candidates one step on; a step that raises the
    objective is halved. A candidate is done when its objective settles.

    Gradients are always a candidate's own. In small problems hessians are too; in large ones, where they are nearly all of the
    work, the open candidates are grouped by penalty and strength, and the hessian of the middle one stands in for its group. Such steps only converge
    more slowly, to the same point; a candidate that is left over becomes the middle one.
    """
    sc, width = blocks.spark.sparkContext, blocks.width
    penalty = [lambda w, r=r: (0.5 * float(w[:-1] @ w[:-1]) if r["penalty"] == "l2" else float(np.abs(w[:-1]).sum())) / r["C"] for r in rules]
    most = max(1, HESSIAN_BYTES // (8 * (width + 3) * (width + 1)))
    at_once, steps = (most, NEWTON_STEPS) if blocks.whole else (len(rules), 4 * NEWTON_STEPS)
    groups = at_once if blocks.whole else min(SHARED_HESSIANS, most)
    out = {i: np.zeros((width + 1, len(rules))) for i in range(len(blocks.keys))}
    for i, base in blocks.base.items():
        out[i][-1] = base
    for start in range(0, len(rules), at_once):
        # (problem, candidate) -> last accepted weights, their objective, the weights tried now, and whether an own hessian led there
        tried = {(i, c): (None, math.inf, out[i][:, c], True) for i in out for c in range(start, min(start + at_once, len(rules)))}
        for _ in range(steps):
            if not tried:
                break
            asked = {}
            for i in out:
                numbers = sorted((c for j, c in tried if j == i), key=lambda c: c if blocks.whole else (rules[c]["penalty"], rules[c]["C"], c))
                shares = [s.tolist() for s in np.array_split(np.array(numbers, np.int64), min(groups, len(numbers)))] if numbers else []
                if numbers:
                    asked[i] = {s[len(s) // 2]: (s, np.stack([tried[i, c][2] for c in s], axis=1)) for s in shares}
            sent = sc.broadcast(asked)
            found = blocks.summed(blocks.frame, kernels.newton_sums(sent, width), kernels.newton_steps(sent, list(rules), width))
            sent.destroy()
            seen = {(r["problem"], r["candidate"]) for r in found}
            tried = {k: v for k, v in tried.items() if k in seen}  # a problem without training rows keeps its start
            for r in found:
                key = r["problem"], r["candidate"]
                before, least, now, led = tried[key]
                value = float(np.frombuffer(r["bit"])[0]) + penalty[key[1]](now)
                if before is not None and value > least + SETTLED * abs(least) and np.abs(now - before).max() > 1e-8:
                    tried[key] = before, least, (before + now) / 2, led
                    continue
                out[key[0]][:, key[1]] = now if value <= least else before
                if least - value <= (SETTLED if led else SETTLED_SHARED) * max(abs(value), 1.0):
                    del tried[key]
                else:
                    tried[key] = now, value, np.frombuffer(r["parts"]).copy(), key[1] in asked[key[0]]
    return out


def search_linear(parts: DataFrame, by: Sequence[str], params: Sequence[Mapping], width: int, with_train: bool = False) -> DataFrame:
    """``(by…, param_idx, fold, part, five metrics)`` of all linear candidates."""
    spark, by = parts.sparkSession, list(by)
    rules = [{"C": float(p["C"]), "penalty": p["penalty"]} for p in params]
    blocks = Blocks(parts, [*by, "cv_fold"], width, 1)
    sent = spark.sparkContext.broadcast(newton(blocks, rules))
    indices = spark.createDataFrame([(i, i) for i in range(len(rules))], "candidate int, param_idx int")
    scores = blocks.frame.mapInArrow(kernels.linear_scores(sent, width, with_train), kernels.SCORES)
    return materialise(_measured(blocks.named(scores, indices), by), "measured")


def search_pls(parts: DataFrame, by: Sequence[str], params: Sequence[Mapping], width: int, with_train: bool = False) -> DataFrame:
    """``(by…, param_idx, fold, part, five metrics)`` of all PLS candidates: one job for the Gram matrices of all problems, one for all scores."""
    spark, by = parts.sparkSession, list(by)
    blocks = Blocks(parts, [*by, "cv_fold"], width, 1)
    found = blocks.summed(blocks.frame, kernels.gram_sums(width), kernels.gram_totals(width))
    grams = {r["problem"]: np.frombuffer(r["parts"]).reshape(width + 3, width + 3) for r in found}  # one for each fold of each campaign
    fitted = {i: [pls_coefficients(full, width, int(p.get("n_components", 2))) for p in params] for i, full in grams.items()}
    sent = spark.sparkContext.broadcast(fitted)
    indices = spark.createDataFrame([(i, i) for i in range(len(params))], "candidate int, param_idx int")
    scores = blocks.frame.mapInArrow(kernels.pls_scores(sent, width, with_train), kernels.SCORES + ", prediction int")
    marked = blocks.named(scores, indices).withColumn("part", F.when(F.col("train"), "train").otherwise("val"))
    return materialise(all_metrics(marked, [*by, "param_idx", "cv_fold", "part"]).withColumnRenamed("cv_fold", "fold"), "measured")
