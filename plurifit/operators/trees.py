"""Decision trees over 0/1 features, grown level by level for many candidates at once.

Features are bits, so the search for a split is counting: for every node and bit
the rows of each class with the bit set; the unset side is the node less that.
All candidates of all folds and campaigns share one job per level, and nodes
reached by the same path are counted once however many candidates pass through.
What grows with the data is read once per level and combined on the map side;
everything after that is counts.  Nodes whose rows fit into a task are finished there
(``tree_kernels``), so the number of jobs depends on the large nodes alone.

A node is named by the md5 of its path, ``md5(parent > bit > side)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import pinned, pinned_table
from ..session import materialise
from . import score_kernels, tree_kernels

ROOT = "root"
GAIN_DIGITS = 10
LEVELS_PER_WRITE = 8
ACTIVE_NODES = 200_000
# a node whose set bits, and as many again for its rows, stay below this is finished inside one task
TASK_CELLS = 4_000_000
ROW_CELLS = 64


def _gini(n1: str, n: str) -> str:
    p = f"(double({n1}) / double({n}))"
    return f"(2e0 * {p} * (1e0 - {p}))"


def _entropy(n1: str, n: str) -> str:
    p = f"(double({n1}) / double({n}))"

    def part(x: str) -> str:
        return f"CASE WHEN {x} <= 0e0 THEN 0e0 ELSE -{x} * log2({x}) END"

    return f"({part(p)} + {part(f'(1e0 - {p})')})"


IMPURITY = {"gini": _gini, "entropy": _entropy}


def gain(criterion: str) -> str:
    """Impurity of a node less that of its two sides, as SQL over ``n, n1, s, s1``.

    ``s`` rows of the node have the bit set, ``s1`` of them are of class 1.
    Expressions of this size are written as text: Spark parses one string where
    the column API would make a call to the JVM for every operator.
    """
    if criterion not in IMPURITY:
        raise ValueError(f"criterion is one of {list(IMPURITY)}, not {criterion!r}")
    measure = IMPURITY[criterion]
    sides = f"double(s) * {measure('s1', 's')} + double(n - s) * {measure('(n1 - s1)', '(n - s)')}"
    return f"round({measure('n1', 'n')} - ({sides}) / double(n), {GAIN_DIGITS})"


def split_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by…, bit, s, s1, n, n1)`` for every bit that splits its node.

    Node totals travel as the pseudo bit -1, so one shuffle carries both.
    """
    by = list(by)
    if not by:
        return split_counts(rows.withColumn("_all", F.lit(0)), ["_all"]).drop("_all")
    marked = F.explode(F.array_prepend("bits", F.lit(-1)))
    counted = rows.select(*by, "hit", marked.alias("bit")).groupBy(*by, "bit").agg(
        F.count(F.lit(1)).alias("s"), F.sum(F.col("hit").cast("bigint")).alias("s1")
    )
    totals = counted.filter("bit = -1").select(*by, F.col("s").alias("n"), F.col("s1").alias("n1"))
    bits = counted.filter("bit >= 0")
    return bits.join(totals, by).filter("s < n")


def split_scan(rows: DataFrame, by: Sequence[str], criterion: str = "gini") -> DataFrame:
    """Gain of every bit of every group."""
    return split_counts(rows, by).withColumn("gain", F.expr(gain(criterion)))


def best_split(scanned: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bit with the highest gain, the lowest bit on a tie."""
    top = F.max(F.struct("gain", (-F.col("bit")).alias("neg"), "s", "s1", "n", "n1")).alias("t")
    return scanned.groupBy(*by).agg(top).select(
        *by, (-F.col("t.neg")).alias("bit"), F.col("t.gain").alias("gain"),
        F.col("t.s").alias("s"), F.col("t.s1").alias("s1"), F.col("t.n").alias("n"), F.col("t.n1").alias("n1"),
    )


def child(node: Column, bit: Column, side: Column | int) -> Column:
    side = side if isinstance(side, Column) else F.lit(side)
    return F.md5(F.concat_ws(">", node, bit.cast("string"), side.cast("string")))


def growth_rules(params: Sequence[Mapping]) -> dict[tuple, int]:
    """Distinct ways to grow: (criterion, rows a split needs, rows a leaf needs) → number.

    Depth limits are not among them: a shallower tree is the deep one cut off.
    """
    rules: dict[tuple, int] = {}
    for p in params:
        rules.setdefault(rule_of(p), len(rules))
    return rules


def rule_of(params: Mapping) -> tuple:
    leaf = params.get("min_samples_leaf", 1)
    return params.get("criterion", "gini"), max(params.get("min_samples_split", 2), 2 * leaf), leaf


def _name(criterion: str, leaf: int) -> str:
    return f"best_{criterion}_{leaf}"


def _level(rows: DataFrame, active: DataFrame, small: bool, by: Sequence[str], rules: Mapping[tuple, int]) -> DataFrame:
    """Decisions of one level: ``(by…, rule, node, n, n1, v, v1, bit)``, ``bit`` null for a leaf."""
    keys = ", ".join([*by, "node"])
    counted = rows.selectExpr(
        *by, "node", "explode(IF(n > 0, array_prepend(bits, -1), array(-1))) AS bit", *tree_kernels.COUNTS
    ).groupBy(*by, "node", "bit").agg(
        F.expr("sum(n) AS s"), F.expr("sum(n1) AS s1"), F.expr("sum(v) AS v"), F.expr("sum(v1) AS v1"),
    )
    # node totals next to every bit; a node has at most one row per bit
    totals = [
        f"max(CASE WHEN bit = -1 THEN {c} END) OVER (PARTITION BY {keys}) AS {name}"
        for c, name in (("s", "n"), ("s1", "n1"), ("v", "v"), ("v1", "v1"))
    ]
    scanned = counted.selectExpr(*by, "node", "bit", "s", "s1", *totals)
    wanted = sorted({(criterion, leaf) for criterion, _, leaf in rules})
    gains = [
        f"CASE WHEN bit >= 0 AND s > 0 AND s < n THEN {gain(c)} END AS gain_{c}" for c in sorted({c for c, _ in wanted})
    ]
    tops = [
        f"max(CASE WHEN bit >= 0 AND s >= {leaf} AND n - s >= {leaf} THEN struct(gain_{criterion} AS g, -bit AS neg) END)"
        f" AS {_name(criterion, leaf)}"
        for criterion, leaf in wanted
    ]
    nodes = scanned.selectExpr("*", *gains).groupBy(*by, "node").agg(
        *[F.expr(f"first({c}) AS {c}") for c in ("n", "n1", "v", "v1")], *[F.expr(t) for t in tops]
    )
    decided = nodes.join(F.broadcast(active) if small else active, [*by, "node"])
    pick = " ".join(
        f"WHEN rule = {number} AND n >= {need} THEN -{_name(criterion, leaf)}.neg"
        for (criterion, need, leaf), number in rules.items()
    )
    return decided.selectExpr(
        *by, "rule", "node", "n", "n1", "v", "v1",
        f"CASE WHEN n1 > 0 AND n1 < n THEN CASE {pick} END END AS bit",
    )


def _descend(rows: DataFrame, splits: DataFrame, small: bool, by: Sequence[str]) -> DataFrame:
    """Rows moved to the children of their nodes; rows in finished nodes drop out."""
    side = F.array_contains("bits", F.col("bit")).cast("int")
    return (
        rows.join(F.broadcast(splits) if small else splits, [*by, "node"])
        .withColumn("node", child(F.col("node"), F.col("bit"), side))
        .drop("bit")
    )


def _counted_sets(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by…, bits, n, n1, v, v1)``: rows with the same bits go the same way, so they are counted once."""
    return rows.groupBy(*by, "bits").agg(
        F.expr("count_if(train) AS n"), F.expr("count_if(train AND hit = 1) AS n1"),
        F.expr("count_if(NOT train) AS v"), F.expr("count_if(NOT train AND hit = 1) AS v1"),
    )


def _hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _grow_whole(held: Sequence[DataFrame], n_nodes: int, by: Sequence[str], rules: Mapping[tuple, int], max_depth: int | None) -> DataFrame:
    """The subtrees of all nodes that fit into a task, one node after the other in each task."""
    rows = held[0]
    for more in held[1:]:
        rows = rows.unionByName(more)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in by)
    schema = f"{schema}, " * bool(by) + "rule int, node string, depth int, n bigint, n1 bigint, v bigint, v1 bigint, bit int"
    tasks = max(3 * n_nodes, rows.sparkSession.sparkContext.defaultParallelism)
    grown = tree_kernels.grow_whole(by, rules, max_depth, GAIN_DIGITS)
    return rows.repartition(tasks, *by, "node").groupBy(*by, "node").applyInArrow(grown, schema)


def grow(
    rows: DataFrame,
    by: Sequence[str],
    rules: Mapping[tuple, int],
    max_depth: int | None = None,
) -> DataFrame:
    """Trees of every group and rule.

    ``rows`` has ``(by…, hit, bits, train)``; rows with ``train`` false are only
    carried along to be counted in the nodes they fall into.  The result has one
    row per node: ``(by…, rule, node, depth, n, n1, v, v1, bit)`` with ``bit``
    null for a leaf; ``n, n1`` count training rows, ``v, v1`` the others.

    Nodes too large for a task are split by grouped counts, one job per level; the
    rows of a node that fits are set aside, and all below it is grown in one task.
    Growth stops when no node can be split or at ``max_depth``.  Node tables are
    small and kept as literal rows while they are, else as files.  Moved rows are
    cached for one level, so each level moves them one step, and written out every
    few levels to keep plans short; a lost executor redoes the steps since then.
    """
    by = list(by)
    keys = [*by, "node"]
    base = materialise(_counted_sets(rows, by), "sets").withColumn("node", F.lit(ROOT))
    numbers = F.explode(F.array(*[F.lit(i) for i in rules.values()]))
    active, small = pinned(base.select(*keys).distinct().withColumn("rule", numbers), ACTIVE_NODES)
    levels, held, n_held, cached, depth = [], [], 0, [], 0
    size = F.sum(F.size("bits") + ROW_CELLS).alias("_size")
    while True:
        sizes, known = pinned_table(base.groupBy(*keys).agg(size), ACTIVE_NODES)
        if known is None:
            sizes = materialise(sizes, "sizes")
        fits, large = sizes.filter(F.col("_size") <= TASK_CELLS).select(*keys), sizes.filter(F.col("_size") > TASK_CELLS).select(*keys)
        n_fits = fits.count() if known is None else sum(s <= TASK_CELLS for s in known.column("_size").to_pylist())
        n_large = large.count() if known is None else known.num_rows - n_fits
        if n_fits or not (n_large or levels):  # a table without rows has no node, and no tree
            reached = active.join(_hinted(fits, known is not None), keys).groupBy(*keys).agg(F.array_sort(F.collect_list("rule")).alias("rules"))
            mine = base.join(_hinted(reached, known is not None), keys).select(*keys, F.lit(depth).alias("depth"), "rules", "bits", *tree_kernels.COUNTS)
            held.append(materialise(mine, "whole"))
            n_held += n_fits
        if not n_large:
            break
        if n_fits:
            base = base.join(_hinted(large, known is not None), keys, "left_semi")
            active = active.join(_hinted(large, known is not None), keys, "left_semi")
        decided, table = pinned_table(_level(base, active, small, by, rules), ACTIVE_NODES)
        small = table is not None
        if not small:
            decided = materialise(decided, "nodes")
        if max_depth is not None and depth >= max_depth:
            levels.append(decided.withColumn("bit", F.lit(None).cast("int")).withColumn("depth", F.lit(depth)))
            break
        levels.append(decided.withColumn("depth", F.lit(depth)))
        going = decided.filter("bit IS NOT NULL")
        if small:
            # literal rows already: no job for so little
            unique = table.filter(table.column("bit").is_valid()).select([*keys, "bit"]).group_by([*keys, "bit"]).aggregate([])
            if unique.num_rows == 0:
                break
            splits = rows.sparkSession.createDataFrame(unique, going.select(*keys, "bit").schema)
        else:
            splits = going.select(*keys, "bit").distinct()
            if splits.isEmpty():
                break
        base, spent = _descend(base, splits, small, by).persist(), base
        sides = F.explode(F.array(F.lit(0), F.lit(1)))
        active = going.withColumn("_side", sides).select(
            *by, child(F.col("node"), F.col("bit"), F.col("_side")).alias("node"), "rule"
        )
        depth += 1
        if depth % LEVELS_PER_WRITE == 0:
            moved, base = base, materialise(base, "rows")
            moved.unpersist()
        cached.append(spent)
        while len(cached) > 1:  # the level before last is in the cache of the last one
            cached.pop(0).unpersist()
    for frame in [*cached, base]:
        frame.unpersist()
    if held:
        levels.append(materialise(_grow_whole(held, n_held, by, rules, max_depth), "nodes").select(*by, "rule", "node", "n", "n1", "v", "v1", "bit", "depth"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def cut_off(nodes: DataFrame, depth: int | None) -> DataFrame:
    """Leaves of the trees when they may be no deeper than ``depth``."""
    leaf = F.col("bit").isNull()
    if depth is None:
        return nodes.filter(leaf)
    return nodes.filter((F.col("depth") == depth) | (leaf & (F.col("depth") < depth)))


def pruned(nodes: DataFrame, depth: int | None) -> DataFrame:
    """The whole tree, nodes at ``depth`` turned into leaves and deeper ones dropped."""
    if depth is None:
        return nodes
    inner = F.when(F.col("depth") < depth, F.col("bit"))
    return nodes.filter(F.col("depth") <= depth).withColumn("bit", inner)


def leaf_scores(nodes: DataFrame, by: Sequence[str], params: Sequence[Mapping], rules: Mapping[tuple, int]) -> DataFrame:
    """Counted scores of every candidate: ``(by…, param_idx, score, prediction, pos, neg)``.

    Class 1 is predicted where it has the majority; a draw goes to class 0.
    """
    entries = []
    for i, p in enumerate(params):
        entries.append((rules[rule_of(p)], p.get("max_depth"), i))
    spark = nodes.sparkSession
    plan = spark.createDataFrame(entries, "rule int, limit int, param_idx int")  # one row per candidate
    at_end = F.expr("CASE WHEN limit IS NULL THEN bit IS NULL ELSE depth = limit OR (bit IS NULL AND depth < limit) END")
    return (
        nodes.join(F.broadcast(plan), "rule").filter(at_end)
        .groupBy(*by, "param_idx", F.expr("double(n1) / double(n) AS score"), F.expr("int(2 * n1 > n) AS prediction"))
        .agg(F.sum("v1").alias("pos"), (F.sum("v") - F.sum("v1")).alias("neg"))
    )


def packed(nodes: DataFrame) -> dict | None:
    """One tree as arrays, for ``score_kernels``; ``None`` beyond ``ACTIVE_NODES`` nodes, which are counted first."""
    _, table = pinned_table(nodes.select("node", "depth", "bit", "n", "n1"), ACTIVE_NODES)
    return None if table is None else score_kernels.tree_model([score_kernels.pack_nodes(table)], "mean")


def scored_by(rows: DataFrame, models: Sequence[Mapping]) -> DataFrame:
    """Adds ``_scores``, an array of ``(score, prediction)`` of packed models in their order, in one pass and without a join."""
    sent = rows.sparkSession.sparkContext.broadcast(list(models))  # fitted models, which the driver holds anyway
    return rows.withColumn("_scores", F.arrow_udf(score_kernels.scorer(sent), score_kernels.SCORED)("bits"))


def predict(rows: DataFrame, nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``score`` and ``prediction`` from one tree, or from one tree per group.

    A single tree is walked inside the row; its plan does not grow with its depth.
    Trees of groups, and a tree of more than ``ACTIVE_NODES`` nodes, are walked by joins.
    """
    tree = None if by else packed(nodes)
    if tree is None:
        return predict_by_level(rows, nodes, by)
    one = F.get("_scores", F.lit(0))
    return scored_by(rows, [tree]).withColumns({"score": one["score"], "prediction": one["prediction"]}).drop("_scores")


def predict_by_level(rows: DataFrame, nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Like ``predict``, one join per level.

    The tables joined are single levels of the trees and are broadcast only when counted small.
    """
    by = list(by)
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    out = rows.withColumn("_node", F.lit(ROOT)).withColumn("score", F.lit(None).cast("double"))
    for depth in range(deepest + 1):
        level, small = pinned(
            nodes.filter(F.col("depth") == depth).select(
                *by, F.col("node").alias("_node"), F.col("bit").alias("_bit"), F.expr("double(n1) / double(n) AS _p")
            ),
            ACTIVE_NODES,
        )
        side = F.array_contains("bits", F.col("_bit")).cast("int")
        out = (
            out.join(F.broadcast(level) if small else level, [*by, "_node"], "left")
            .withColumn("score", F.coalesce("score", F.when(F.col("_bit").isNull(), F.col("_p"))))
            .withColumn("_node", F.when(F.col("_bit").isNotNull(), child(F.col("_node"), F.col("_bit"), side)))
            .drop("_bit", "_p")
        )
    return out.drop("_node").withColumn("prediction", (F.col("score") > 0.5).cast("int"))
