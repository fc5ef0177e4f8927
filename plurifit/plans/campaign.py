"""Whole campaigns: encode, clean, split, gate, search, choose, refit, test, save."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import time_seed
from ..operators import trees
from ..operators.fingerprint import WIDTHS, fingerprints
from ..operators.grid import GRIDS, expand
from ..operators.metrics import METRICS, all_metrics, best_candidate, metrics_from_counts, summarise
from ..operators.prepare import align, gate, labelled, min_support
from ..operators.sampling import stratified_folds, train_test_split
from ..session import materialise
from ..sources.registry import save_model
from . import forest
from .estimators import ForestFit, TreeFit, fit
from .search import cross_validate, fold_parts

RUN = ("assay", "fp")

RESULT = (
    "assay string, fp string, model string, status string, n_train bigint, n_test bigint, param_idx int, params string, "
    + ", ".join(f"val_{m} double" for m in METRICS) + ", " + ", ".join(f"test_{m} double" for m in METRICS)
)


def aligned(compounds: DataFrame, hits: DataFrame, families: Sequence[str], min_length: int = 30) -> DataFrame:
    """``(row_id, bits, fp, assay, hit)`` of labelled items; only those are encoded."""
    known = labelled(hits)
    wanted = compounds.join(known.select("row_id").distinct(), "row_id", "left_semi")
    return align(fingerprints(wanted, families, min_length), known)


def evaluate(fitted, rows: DataFrame) -> dict[str, float]:
    """The five metrics of a fitted model on labelled rows."""
    scored = fitted.score(rows).select(F.col("hit").alias("y"), "prediction", "score")
    got = all_metrics(scored, []).first()
    return {m: got[m] for m in METRICS} if got else dict.fromkeys(METRICS)


def fit_final(
    train: DataFrame, test: DataFrame, model, params: Mapping, width: int, seed: int = 42, resample: bool = False
):
    """Refit the chosen candidate on the whole training set and test it.

    The training set is not balanced here unless asked for.
    """
    if resample:
        from ..operators.balance import balanced

        keyed = train.select(F.lit(0).alias("all"), "row_id", "hit", "bits")
        train = balanced(keyed, ["all"], seed=seed, width=width).drop("all", "is_synthetic")
    if model == "rf" and forest.grows(params):
        # the implementation that searched it
        fitted = ForestFit(forest.fit_forest(train, params, width, seed), spark=train.sparkSession)
    else:
        fitted = fit(train, model, params, width, seed)
    return fitted, evaluate(fitted, test)


def final_trees(train: DataFrame, test: DataFrame, chosen: Mapping[tuple, Mapping], params: Sequence[Mapping]) -> dict:
    """Refit and test the chosen tree of every campaign in one growth over all of them.

    Test rows ride along uncounted, so the metrics come from counts per leaf.
    """
    picked = sorted({won["param_idx"] for won in chosen.values()})
    kinds = [params[i] for i in picked]
    rules = trees.growth_rules(kinds)
    limits = [p.get("max_depth") for p in kinds]
    rows = train.select(*RUN, "hit", "bits", F.lit(True).alias("train")).unionByName(
        test.select(*RUN, "hit", "bits", F.lit(False).alias("train"))
    )
    nodes = trees.grow(rows, RUN, rules, None if None in limits else max(limits))
    wanted = train.sparkSession.createDataFrame(
        [(*key, picked.index(won["param_idx"])) for key, won in chosen.items()], "assay string, fp string, param_idx int"
    )
    counted = trees.leaf_scores(nodes, RUN, kinds, rules).join(F.broadcast(wanted), [*RUN, "param_idx"])  # one row per campaign
    tested = {(r["assay"], r["fp"]): r for r in metrics_from_counts(counted, RUN).collect()}
    out = {}
    for key, won in chosen.items():
        p = params[won["param_idx"]]
        mine = (F.col("assay") == key[0]) & (F.col("fp") == key[1]) & (F.col("rule") == rules[trees.rule_of(p)])
        own = trees.pruned(nodes.filter(mine).drop(*RUN, "rule", "v", "v1"), p.get("max_depth"))
        out[key] = (TreeFit(own), {m: tested[key][m] for m in METRICS})
    return out


def run(
    compounds: DataFrame,
    hits: DataFrame,
    families: Sequence[str] = ("MACCS",),
    models: Mapping[str, Mapping] | Sequence[str] = ("dt",),
    k: int = 5,
    seed: int = 42,
    run_time: str | None = None,
    support: int = 0,
    metric: str = "f1",
    how: str = "mean",
    save_to: str | None = None,
    min_length: int = 30,
) -> DataFrame:
    """One row per (assay, family, model): its status, the chosen candidate and ten metrics.

    ``models`` names the families to search, with their own grids if given as a
    mapping.  ``run_time`` (``HH-MM-SS``) takes the place of ``seed`` for the
    hold-out.  A campaign that cannot be balanced gets a status row and no fits.
    """
    spark = compounds.sparkSession
    grids = models if isinstance(models, Mapping) else {m: GRIDS.get(m, {}) for m in models}
    if support:
        hits = min_support(hits, support)
    data = materialise(aligned(compounds, hits, families, min_length), "aligned")
    hold_out = time_seed(F.lit(run_time)) if run_time else seed
    split = train_test_split(data, RUN, hold_out)
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    folded = materialise(stratified_folds(train.drop("split"), RUN, k, seed), "train")
    test = materialise(test.drop("split"), "test")

    sizes = test.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_test"))
    gates = gate(folded, RUN).join(sizes, list(RUN), "left").collect()  # one row per campaign
    width = max(WIDTHS[f] for f in families)
    out, ready = [], [g for g in gates if g["open"]]
    for g in gates:
        if not g["open"]:
            blank = [None] * (2 * len(METRICS))
            out += [(g["assay"], g["fp"], m, g["reason"], g["n_pos"] + g["n_neg"], g["n_test"], None, None, *blank) for m in grids]
    if ready:
        opened = spark.createDataFrame([(g["assay"], g["fp"]) for g in ready], "assay string, fp string")
        usable = folded.join(F.broadcast(opened), list(RUN), "left_semi")  # one row per campaign
        parts = materialise(fold_parts(usable, RUN, k, "smote", seed, width), "folds")
        for model, grid in grids.items():
            params = expand(grid) if grid else [{}]
            # how many features a forest tries depends on the width, so every family is searched with its own
            kinds = [None] if model == "dt" else sorted({g["fp"] for g in ready})
            found = [
                cross_validate(
                    usable if f is None else usable.filter(F.col("fp") == f), RUN, [g for g in ready if f in (None, g["fp"])], model, params, k,
                    width=WIDTHS.get(f, width), seed=seed, parts=parts if f is None else parts.filter(F.col("fp") == f),
                )
                for f in kinds
            ]
            results = reduce(DataFrame.unionByName, found)
            results = materialise(results.filter("part = 'val'"), "results")
            best = best_candidate(results, RUN, metric, how).select(*RUN, "param_idx")
            means = summarise(results, [*RUN, "param_idx"]).join(best, [*RUN, "param_idx"], "left_semi")
            chosen = {(r["assay"], r["fp"]): r for r in means.collect()}  # one row per campaign
            trees_done = final_trees(folded, test, chosen, params) if model == "dt" else {}
            for g in ready:
                key = (g["assay"], g["fp"])
                won = chosen.get(key)
                if won is None:
                    out.append((*key, model, "no candidate has a score", g["n_pos"] + g["n_neg"], g["n_test"], None, None, *[None] * (2 * len(METRICS))))
                    continue
                if model == "dt":
                    fitted, tested = trees_done[key]
                else:
                    mine = (F.col("assay") == key[0]) & (F.col("fp") == key[1])
                    fitted, tested = fit_final(
                        folded.filter(mine), test.filter(mine), model, params[won["param_idx"]], WIDTHS[key[1]], seed
                    )
                if save_to:
                    save_model(spark, fitted, save_to, key[0], key[1], model)
                out.append((
                    *key, model, "ok", g["n_pos"] + g["n_neg"], g["n_test"], won["param_idx"], str(params[won["param_idx"]]),
                    *[won[m] for m in METRICS], *[tested[m] for m in METRICS],
                ))
    return spark.createDataFrame(out, RESULT)
