"""What the joint fits do inside tasks: blocks of rows, sums for trees, Newton steps.

Like ``kernels``, pickled by value, so executors need numpy and pyarrow but not
this package.  A block is a bounded number of rows of one problem (one fold of one
campaign): bits packed eight to a byte, labels, training marks, and the margins
that every candidate has reached.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 4096
GAIN_DIGITS = 10
LEAST_GAIN = 1e-9
MASKED_NODES = 2
DENSE_CELLS = 8_000_000
PORTION = 2048
TOGETHER_CELLS = 2_000_000
SPLIT_STEPS = 1000
BLOCK = "problem int, n int, hit binary, train binary, bits binary, margins binary"
SUMS = "problem int, candidate int, nodes binary, sums binary"
SPLITS = "problem int, candidate int, nodes binary, bit binary, parts binary"
SCORES = "problem int, candidate int, train boolean, y int, score double"


def _named(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def make_blocks(width: int, bases: dict[int, float], candidates: int):
    """Function for ``mapInArrow`` over ``(problem, hit, train, bits)`` sorted by problem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            problem = batch.column(0).to_numpy(zero_copy_only=False)
            hit = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            bits = batch.column(3)
            x = np.zeros((batch.num_rows, width), np.uint8)
            x[np.repeat(np.arange(batch.num_rows), bits.value_lengths().to_numpy(zero_copy_only=False)), bits.flatten().to_numpy(zero_copy_only=False)] = 1
            cuts = np.flatnonzero(np.r_[True, problem[1:] != problem[:-1]]).tolist() + [batch.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                for at in range(start, stop, BLOCK_ROWS):
                    rows = slice(at, min(at + BLOCK_ROWS, stop))
                    n, number = rows.stop - rows.start, int(problem[at])
                    margins = np.full((n, candidates), bases[number])
                    yield _named(BLOCK, [[number], [n], [hit[rows].tobytes()], [train[rows].tobytes()], [np.packbits(x[rows], axis=1).tobytes()], [margins.tobytes()]])

    return run


def _opened(row: dict, width: int):
    n = row["n"]
    x = np.unpackbits(np.frombuffer(row["bits"], np.uint8).reshape(n, -1), axis=1)[:, :width]
    return x, np.frombuffer(row["hit"], np.uint8), np.frombuffer(row["train"], np.uint8).astype(bool), np.frombuffer(row["margins"]).reshape(n, -1)


def walk(x: np.ndarray, bit: np.ndarray, levels: int) -> np.ndarray:
    """Node of every row in every tree; ``bit[c, node]`` is -1 where a tree ends, children of a node are ``2 node + 1`` and ``2 node + 2`` (bit set)."""
    node = np.zeros((len(x), len(bit)), np.int64)
    rows, trees = np.arange(len(x))[:, None], np.arange(len(bit))[None, :]
    for _ in range(levels):
        tested = bit[trees, node]
        node = np.where(tested >= 0, 2 * node + 1 + x[rows, np.maximum(tested, 0)], node)
    return node


def ones_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and bits of all ones."""
    return np.nonzero(x)


def node_sums(ones: tuple[np.ndarray, np.ndarray], node: np.ndarray, stats: np.ndarray, n_nodes: int, width: int) -> np.ndarray:
    """``(nodes, stats, width + 1)``: sums of every statistic per node, with every bit set and, last, in all. Rows with a negative node are left out."""
    row, bit = ones
    slot = np.where(node >= 0, node, n_nodes)
    key = slot[row] * width + bit
    out = np.empty((n_nodes, len(stats), width + 1))
    for s, values in enumerate(stats):
        out[:, s, :width] = np.bincount(key, values[row], (n_nodes + 1) * width)[: n_nodes * width].reshape(n_nodes, width)
        out[:, s, width] = np.bincount(slot, values, n_nodes + 1)[:n_nodes]
    return out


def dense_sums(x: np.ndarray, slots: list[np.ndarray | None], stats: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
    """``(nodes, stats, columns)`` for every candidate: sums of its statistics per node and column of ``x``, by one product over all rows.

    Rows lie in few nodes or (-1) in none; without slots all lie in one. Statistics are those of the first rows; the others count nothing.
    """
    columns = [k * len(s) for k, s in zip(sizes, stats)]
    cuts, n = np.r_[0, np.cumsum(columns)].tolist(), stats[0].shape[1]
    total = np.zeros((x.shape[1], cuts[-1]))
    for a in range(0, n, PORTION):
        b = min(a + PORTION, n)
        held = np.zeros((b - a, cuts[-1]))
        for slot, values, k, at in zip(slots, stats, sizes, cuts):
            if slot is None:
                held[:, at : at + len(values)] = values[:, a:b].T
                continue
            for j in range(k):
                rows = np.flatnonzero(slot[a:b] == j)
                held[rows, at + j * len(values) : at + (j + 1) * len(values)] = values[:, a + rows].T
        total += x[a:b].astype(np.float64, copy=False).T @ held
    return [total[:, a:b].T.reshape(k, len(s), -1) for a, b, k, s in zip(cuts, cuts[1:], sizes, stats)]


def statistics(hit: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Row, gradient and hessian of the log loss."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.stack([np.ones(len(p)), hit - p, p * (1.0 - p)])


def choose(rule: dict, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best bit of every node (-1: none), and the sums of its unset side, its set side and the node."""
    every, on = sums[:, :, -1:], sums[:, :, :-1]
    gain = split_gain(rule, on, every - on, every)
    best, each = gain.argmax(1), np.arange(len(sums))
    sides = np.stack([(every - on)[each, :, best], on[each, :, best], every[:, :, 0]], axis=1)
    return np.where(np.isfinite(gain[each, best]), best, -1).astype("<i4"), sides


def extend(rule: dict, bit: np.ndarray, value: np.ndarray, level: int, nodes: np.ndarray, best: np.ndarray, sides: np.ndarray) -> bool:
    """Writes the splits of a level into a tree; tells whether it goes on growing."""
    values = leaf_value(rule, sides)
    if level == 0:
        value[0] = values[0, 2]
    split = best >= 0
    at = nodes[split] + 2**level - 1
    bit[at] = best[split]
    value[2 * at + 1], value[2 * at + 2] = values[split, 0], values[split, 1]
    return bool(split.any()) and level + 1 < rule["depth"]


def no_trees(n: int, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, 2 ** (deepest + 1) - 1), -1, np.int16), np.zeros((n, 2 ** (deepest + 1) - 1))


def tree_sums(sent, width: int, level: int):
    """Function for ``mapInArrow`` over blocks: sums of every open node, added up within the task.

    ``sent`` holds, for every problem, the candidates still growing and their trees so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        growing, first, n_nodes = sent.value, 2**level - 1, 2**level
        held, total = None, {}

        def close():
            for c, sums in total.items():
                nodes = np.flatnonzero(sums[:, 0, width] > 0)
                if len(nodes):
                    yield _named(SUMS, [[held], [c], [nodes.astype("<i4").tobytes()], [sums[nodes].tobytes()]])

        for batch in batches:
            for row in batch.to_pylist():
                if row["problem"] != held:
                    yield from close()
                    held, total = row["problem"], {}
                if held not in growing:
                    continue
                numbers, bit = growing[held]
                x, hit, train, margins = _opened(row, width)
                x, hit, margins = x[train], hit[train], margins[train]
                node, ones = walk(x, bit, level) - first, ones_of(x)
                for i, c in enumerate(numbers):
                    sums = node_sums(ones, node[:, i], statistics(hit, margins[:, c]), n_nodes, width)
                    total[c] = total[c] + sums if c in total else sums
        yield from close()

    return run


def best_splits(rules: list[dict], width: int):
    """Function for ``mapInArrow`` over sums dealt by problem and candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, dict] = {}
        for batch in batches:
            for row in batch.to_pylist():
                mine = total.setdefault((row["problem"], row["candidate"]), {})
                nodes = np.frombuffer(row["nodes"], "<i4").tolist()
                for node, sums in zip(nodes, np.frombuffer(row["sums"]).reshape(len(nodes), 3, width + 1)):
                    mine[node] = mine[node] + sums if node in mine else sums
        for (problem, c), found in total.items():
            nodes = np.array(sorted(found), "<i4")
            bit, sides = choose(rules[c], np.stack([found[n] for n in nodes.tolist()]))
            yield _named(SPLITS, [[problem], [c], [nodes.tobytes()], [bit.tobytes()], [sides.tobytes()]])

    return run


def _exact(values: np.ndarray, n: int) -> np.ndarray:
    """Values of at most 1 cut to a grid so fine that sums of ``n`` of them have no rounding, whatever the order."""
    unit = 2.0 ** (51 - max(int(n), 1).bit_length())
    return np.round(values * unit) / unit


class _Histograms:
    """Sums of every statistic over the distinct bit sets of a node, in all and with every bit set.

    The smaller half of every split is added up, its sibling is what is left of the parent; sums on the grid of ``_exact`` make that the same number.
    Rows are taken in portions, so beside the bits themselves, a byte each, memory does not grow with them.
    """

    def __init__(self, x: np.ndarray):
        n, self.width = x.shape
        self.x = np.ones((n, self.width + 1), np.uint8)
        self.x[:, : self.width] = x
        self.dense = self.x.astype(np.float64) if self.x.size <= DENSE_CELLS else None

    def few(self, slots: list[np.ndarray | None], stats: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
        return dense_sums(self.x if self.dense is None else self.dense, slots, stats, sizes)

    def many(self, slot: np.ndarray, stats: np.ndarray, n_nodes: int) -> np.ndarray:
        """Like ``dense_sums`` for one candidate, from the rows of each node."""
        live = np.flatnonzero(slot >= 0)
        order = live[np.argsort(slot[live].astype(np.int16 if n_nodes < 2**15 else np.int64), kind="stable")]
        starts = np.searchsorted(slot[order], np.arange(n_nodes + 1))
        out = np.zeros((n_nodes, len(stats), self.width + 1))
        for a in range(0, len(order), PORTION):
            b = min(a + PORTION, len(order))
            x, values = self.x[order[a:b]].astype(np.float64), np.ascontiguousarray(stats[:, order[a:b]])
            first, last = int(slot[order[a]]), int(slot[order[b - 1]])
            cuts = np.clip(starts[first : last + 2], a, b) - a
            for k, (c, d) in enumerate(zip(cuts.tolist(), cuts[1:].tolist()), first):
                if d > c:
                    out[k] += values[:, c:d] @ x[c:d]
        return out


class _Growing:
    """One tree of one candidate while it is grown."""

    def __init__(self, rule: dict, margin: np.ndarray, of_train: np.ndarray, hit: np.ndarray, offset: np.ndarray, counts: np.ndarray):
        self.rule, self.of_train, self.n, self.offset = rule, of_train, len(hit), offset
        self.bit, self.value = (a[0] for a in no_trees(1, rule["depth"]))
        p = (1.0 / (1.0 + np.exp(-margin)))[of_train]
        self.by_row = np.stack([hit - p, p * (1.0 - p)])
        self.node, self.going = np.zeros(len(margin), np.int64), self.n > 0 and rule["depth"] > 0
        stats = [np.bincount(of_train, _exact(values, self.n), len(margin))[: len(counts)] for values in self.by_row]
        # where a side needs some hessian it has rows, so their number is not asked for
        self.counted = rule["kind"] == "gbt" or rule["min_child_weight"] <= 0
        self.stats = np.stack([counts, *stats] if self.counted else stats)
        # gradient and hessian of the nodes of a level, row by row
        self.every = np.array([[np.bincount(np.zeros(self.n, np.int64), values, 1)[0] for values in self.by_row]])

    def split(self, level: int, nodes: np.ndarray, sums: np.ndarray, x: np.ndarray, n_train: int):
        """Splits the nodes of a level; returns what to add up for the next one: ``(nodes to add up, their siblings, places of the parents)``."""
        best, _ = choose(self.rule, sums if self.counted else sums[:, [1, 0, 1]])
        base, n_ids = 2**level - 1, 2 ** (level + 2) - 1
        tested = np.full(n_ids, -1, np.int64)
        tested[base + nodes] = best
        at = tested.take(self.node)
        on = x.ravel().take(self.offset + np.maximum(at, 0))
        self.node = np.where(at >= 0, 2 * self.node + 1 + on, self.node)
        below = self.node.take(self.of_train)
        made = np.stack([np.bincount(below, values, n_ids)[2 * base + 1 :] for values in self.by_row], axis=1)
        every, set_ = self.every[nodes], made[2 * nodes + 1]
        sides = np.zeros((len(nodes), 3, 3))  # leaves ask for no number of rows
        sides[:, :, 1:] = np.stack([every - set_, set_, every], axis=1)
        self.every = made
        self.going = extend(self.rule, self.bit, self.value, level, nodes, best, sides)
        if not self.going:
            return None
        parents = np.flatnonzero(best >= 0)
        left = 2 * nodes[parents]
        sizes = np.bincount(self.node[:n_train], minlength=n_ids)[2 * base + 1 :]
        less = np.where(sizes[left] <= sizes[left + 1], left, left + 1)
        return less, left + left + 1 - less, parents


def _grow_together(rules: list[dict], margins: np.ndarray, of_train: np.ndarray, hit: np.ndarray, x: np.ndarray, counts: np.ndarray, histograms: _Histograms) -> list[_Growing]:
    """One tree of each candidate; their first levels share products over the rows."""
    n_train, offset = len(counts), np.arange(len(x)) * x.shape[1]
    trees = [_Growing(rule, margins[:, i], of_train, hit, offset, counts) for i, rule in enumerate(rules)]
    first = [t for t in trees if t.going]
    if not first:
        return trees
    sums = dict(zip(map(id, first), histograms.few([None] * len(first), [t.stats for t in first], [1] * len(first))))
    asked = {id(t): t.split(0, np.zeros(1, np.int64), sums[id(t)], x, n_train) for t in first}
    for level in range(1, max(r["depth"] for r in rules)):
        growing, found, few = [t for t in first if t.going], {}, []
        for t in growing:
            less = asked[id(t)][0]
            place = np.full(2 ** (level + 1) - 1, -1, np.int32)
            place[2**level - 1 + less] = np.arange(len(less))
            slot = place[t.node[:n_train]]
            if len(less) <= MASKED_NODES:
                few.append((t, slot, len(less)))
            else:
                found[id(t)] = histograms.many(slot, t.stats, len(less))
        if few:
            found |= dict(zip((id(t) for t, *_ in few), histograms.few([s for _, s, _ in few], [t.stats for t, *_ in few], [k for *_, k in few])))
        for t in growing:
            less, more, parents = asked[id(t)]
            both, nodes = np.concatenate([found[id(t)], sums[id(t)][parents] - found[id(t)]]), np.concatenate([less, more])
            order = np.argsort(nodes)
            sums[id(t)] = both[order]
            asked[id(t)] = t.split(level, nodes[order], sums[id(t)], x, n_train)
    return trees


def _rounds(rules: list[dict], width: int, rounds: int, mine: list[int], rows: list[dict]) -> Iterator[tuple]:
    """Boosts the candidates ``mine`` on all rows of a problem; yields the trees and margins after each round.

    Rows with the same bits share their nodes and margins, so bits are chosen from sums over distinct sets. The sums that
    become leaf values are added up row by row, so they do not depend on how the bits were chosen.
    """
    hit = np.concatenate([np.frombuffer(r["hit"], np.uint8) for r in rows])
    train = np.concatenate([np.frombuffer(r["train"], np.uint8) for r in rows]).astype(bool)
    packed = np.concatenate([np.frombuffer(r["bits"], np.uint8).reshape(r["n"], -1) for r in rows])
    _, first, of = np.unique(packed.view(f"V{packed.shape[1]}").ravel(), return_index=True, return_inverse=True)
    # sets with training rows come first
    trained = np.bincount(of[train], minlength=len(first)) > 0
    order = np.argsort(~trained, kind="stable")
    of = np.argsort(order, kind="stable")[of]
    x = np.ascontiguousarray(np.unpackbits(packed[first[order]], axis=1)[:, :width])
    margins = np.full((len(x), len(mine)), np.frombuffer(rows[0]["margins"])[0])  # where the problem starts
    of_train, hit_train = of[train], hit[train]
    counts = np.bincount(of_train, minlength=1)[: int(trained.sum())].astype(np.float64)
    histograms, at_once = _Histograms(x), max(1, TOGETHER_CELLS // max(len(hit), 1))
    for number in range(1, rounds + 1):
        trees = []
        for start in range(0, len(mine), at_once):
            group = mine[start : start + at_once]
            for i, t in enumerate(_grow_together([rules[c] for c in group], margins[:, start : start + at_once], of_train, hit_train, x, counts, histograms), start):
                margins[:, i] += t.value[t.node]
                trees.append((t.bit, t.value))
        yield number, trees, hit, train, margins, of


def _by_share(work):
    """Function for ``mapInArrow`` over blocks sorted by problem and share: ``work(problem, mine, rows)`` for each of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["problem"], row["share"]) != key:
                    if held:
                        yield from work(key[0], held[0]["mine"], held)
                    key, held = (row["problem"], row["share"]), []
                held.append(row)
        if held:
            yield from work(key[0], held[0]["mine"], held)

    return run


def boost_whole(rules: list[dict], width: int, rounds: int, at_rounds: set[int], with_train: bool):
    """Function for ``mapInArrow`` over blocks of small problems: scores after the wanted rounds, all of which run in the task.

    The same sums and choices as in the shared jobs; no other task has rows of the problem.
    """

    def scores(problem: int, mine: list[int], rows: list[dict]) -> Iterator[pa.RecordBatch]:
        for number, _, hit, train, margins, of in _rounds(rules, width, rounds, mine, rows):
            if number not in at_rounds:
                continue
            measured = np.flatnonzero(~train | with_train)
            for made in _scores(problem, hit[measured], train[measured], margins[of[measured]], with_train):
                candidate = pa.array(np.array(mine, np.int32)[made.column(1).to_numpy()])
                rest = [made.column(k) for k in range(2, 5)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(candidate), number, np.int32)), made.column(0), candidate, *rest], names=["round", *made.schema.names])

    return _by_share(scores)


def trees_whole(rules: list[dict], width: int, rounds: int):
    """Like ``boost_whole``, for the trees themselves."""

    def trees(problem: int, mine: list[int], rows: list[dict]) -> Iterator[pa.RecordBatch]:
        for number, made, *_ in _rounds(rules, width, rounds, mine, rows):
            for c, (bit, value) in zip(mine, made):
                yield _named("round int, " + SPLITS, [[number], [problem], [c], [b""], [bit.astype("<i2").tobytes()], [value.tobytes()]])

    return _by_share(trees)


def boosted_score(base: float, bits: list, values: list, width: int):
    """Function for a pandas UDF over bits: the probability of class 1."""
    depth = int(np.log2(len(bits[0]) + 1)) - 1 if bits else 0
    bit, value = np.array(bits, np.int16).reshape(len(bits), -1), np.array(values).reshape(len(bits), -1)

    def score(rows):
        import pandas as pd

        x = np.zeros((len(rows), width), np.uint8)
        for i, ones in enumerate(rows):
            x[i, ones] = 1
        margin = np.full(len(rows), base)
        if len(bit):
            margin += value[np.arange(len(bit))[None, :], walk(x, bit, depth)].sum(1)
        return pd.Series(1.0 / (1.0 + np.exp(-margin)))

    return score


def split_gain(rule: dict, on: np.ndarray, off: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Gain of every bit of every node, minus infinity where it may not split."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if rule["kind"] == "gbt":
            between = on[:, 1] / on[:, 0] - off[:, 1] / off[:, 0]
            gain = on[:, 0] * off[:, 0] / every[:, 0] * between**2
            allowed = (on[:, 0] > 0) & (off[:, 0] > 0) & (gain > LEAST_GAIN)
        else:
            def part(s):
                return s[:, 1] ** 2 / (s[:, 2] + rule["leaf_penalty"])

            gain = part(on) + part(off) - part(every)
            least = rule["min_child_weight"] * (1 - 1e-12)
            allowed = (on[:, 0] > 0) & (off[:, 0] > 0) & (on[:, 2] >= least) & (off[:, 2] >= least) & (gain > LEAST_GAIN) & (gain >= rule["gamma"])
    return np.where(allowed, np.round(gain, GAIN_DIGITS), -np.inf)


def leaf_value(rule: dict, sums: np.ndarray) -> np.ndarray:
    """What a leaf with these ``(rows, gradient, hessian)`` adds to the margin."""
    bottom = sums[..., 2] + (0.0 if rule["kind"] == "gbt" else rule["leaf_penalty"])
    return rule["learning_rate"] * np.where(bottom > 1e-150, sums[..., 1] / np.maximum(bottom, 1e-150), 0.0)


def add_trees(sent, width: int, levels: int):
    """Function for ``mapInArrow`` over blocks: the margins after one more tree of every candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                bit, value = trees[row["problem"]]
                x, _, _, margins = _opened(row, width)
                node = walk(x, bit, levels)
                margins = margins + value[np.arange(len(bit))[None, :], node]
                yield _named(BLOCK, [[row["problem"]], [row["n"]], [row["hit"]], [row["train"]], [row["bits"]], [margins.tobytes()]])

    return run


def margin_scores(with_train: bool):
    """Function for ``mapInArrow`` over blocks: one row for each measured row and candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hit, train = np.frombuffer(row["hit"], np.uint8), np.frombuffer(row["train"], np.uint8).astype(bool)
                margins = np.frombuffer(row["margins"]).reshape(row["n"], -1)
                yield from _scores(row["problem"], hit, train, margins, with_train)

    return run


def _scores(problem: int, hit, train, margins, with_train: bool) -> Iterator[pa.RecordBatch]:
    rows = np.flatnonzero(~train | with_train)
    n = len(rows)
    for c in range(margins.shape[1] if n else 0):
        score = 1.0 / (1.0 + np.exp(-margins[rows, c]))
        yield _named(SCORES, [np.full(n, problem), np.full(n, c), train[rows], hit[rows].astype(np.int32), score])


def newton_sums(sent, width: int):
    """Function for ``mapInArrow`` over blocks: gradient and loss of every open candidate and the hessian of one of each group, added up within the task.

    ``sent`` holds, for every problem, the groups under that candidate: their members and the weights of these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, held, total = sent.value, None, None

        def close():
            if held in weights:
                for c, sums in (total or {}).items():
                    yield _named(SUMS, [[held], [c], [np.array(weights[held][c][0], "<i4").tobytes()], [sums.tobytes()]])

        for batch in batches:
            for row in batch.to_pylist():
                if row["problem"] != held:
                    yield from close()
                    held, total = row["problem"], None
                if held not in weights:
                    continue
                x, hit, train, _ = _opened(row, width)
                x = np.concatenate([x[train], np.ones((int(train.sum()), 1), np.uint8)], axis=1).astype(np.float64)
                hit = hit[train].astype(np.float64)
                if total is None:
                    total = {c: np.zeros((width + 1 + 2 * len(members), width + 1)) for c, (members, _) in weights[held].items()}
                margin = x @ np.concatenate([w for _, w in weights[held].values()], axis=1)
                p = 1.0 / (1.0 + np.exp(-margin))
                loss = (np.logaddexp(0.0, margin) - hit[:, None] * margin).sum(0)
                gradient, first = x.T @ (p - hit[:, None]), 0
                for c, (members, _) in weights[held].items():
                    sums, last, own = total[c], first + len(members), first + members.index(c)
                    sums[: width + 1] += x.T @ (x * (p[:, own] * (1 - p[:, own]))[:, None])
                    sums[width + 1 :: 2] += gradient[:, first:last].T
                    sums[width + 2 :: 2, 0] += loss[first:last]
                    first = last
        yield from close()

    return run


def newton_steps(sent, rules: list[dict], width: int):
    """Function for ``mapInArrow`` over sums dealt by problem and group: the loss of every member, and where its next step leads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, total = sent.value, {}
        for batch in batches:
            for row in batch.to_pylist():
                key, sums = (row["problem"], row["candidate"]), np.frombuffer(row["sums"]).reshape(-1, width + 1)
                total[key] = total[key] + sums if key in total else sums
        for (problem, group), sums in total.items():
            members, w = weights[problem][group]
            for i, c in enumerate(members):
                gradient, loss = sums[width + 1 + 2 * i], float(sums[width + 2 + 2 * i, 0])
                there = newton_target(w[:, i], gradient, sums[: width + 1], rules[c])
                yield _named(SPLITS, [[problem], [c], [b""], [np.array([loss]).tobytes()], [there.tobytes()]])

    return run


def newton_target(w: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rule: dict) -> np.ndarray:
    """Least value of the quadratic model of the loss plus the penalty; the last weight is the intercept and carries none."""
    penalty = np.full(len(w), 1.0 / rule["C"])
    penalty[-1] = 0.0
    ridge = hessian + np.diag(np.full(len(w), 1e-9))
    if rule["penalty"] == "l2":
        return w - np.linalg.solve(ridge + np.diag(penalty), gradient + penalty * w)
    # splitting: a ridge step and a soft threshold in turn, until both agree
    pull = float(np.diag(ridge)[:-1].mean()) + 1e-6
    inverse = np.linalg.inv(ridge + np.diag(np.full(len(w), pull)))
    aim = ridge @ w - gradient
    out, gap = w.copy(), np.zeros(len(w))
    for _ in range(SPLIT_STEPS):
        solved = inverse @ (aim + pull * (out - gap))
        before, out = out, solved + gap
        out = np.sign(out) * np.maximum(np.abs(out) - penalty / pull, 0.0)
        gap += solved - out
        if max(np.abs(out - before).max(), np.abs(out - solved).max()) < 1e-8:
            break
    return out


def chained(first, then):
    """Both functions over one task's rows, for sums that no other task shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return then(first(batches))

    return run


def linear_scores(sent, width: int, with_train: bool):
    """Function for ``mapInArrow`` over blocks: scores of all linear candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                x, hit, train, _ = _opened(row, width)
                w = weights[row["problem"]]
                yield from _scores(row["problem"], hit, train, x.astype(np.float64) @ w[:-1] + w[-1], with_train)

    return run


def gram_sums(width: int):
    """Function for ``mapInArrow`` over blocks: the Gram matrix over (bits, one-hot y, 1) of the training rows of a problem, added up within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                x, hit, train, _ = _opened(row, width)
                x, hit = x[train], hit[train]
                if len(x):
                    z = np.concatenate([x, hit[:, None] == 0, hit[:, None] == 1, np.ones((len(x), 1))], axis=1).astype(np.float64)
                    total[row["problem"]] = total.get(row["problem"], 0.0) + z.T @ z
        for problem, sums in total.items():
            yield _named(SUMS, [[problem], [0], [b""], [sums.tobytes()]])

    return run


def gram_totals(width: int):
    """Function for ``mapInArrow`` over sums dealt by problem: the whole matrix of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                total[row["problem"]] = total.get(row["problem"], 0.0) + np.frombuffer(row["sums"]).reshape(width + 3, width + 3)
        for problem, sums in total.items():
            yield _named(SPLITS, [[problem], [0], [b""], [b""], [sums.tobytes()]])

    return run


def pls_scores(sent, width: int, with_train: bool):
    """Function for ``mapInArrow`` over blocks: fitted value of class 1 of all PLS candidates, and whether it is the larger one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                x, hit, train, _ = _opened(row, width)
                rows = np.flatnonzero(~train | with_train)
                n, x = len(rows), x[rows].T.astype(np.float64, order="C")
                for c, (coefficients, intercepts) in enumerate(fitted.get(row["problem"], []) if n else []):
                    both = []
                    for k in (0, 1):
                        value = np.full(n, intercepts[k])
                        for bit in range(width):  # in this order, so that equal rows get equal values wherever they lie
                            value += x[bit] * coefficients[bit, k]
                        both.append(value)
                    yield _named(SCORES + ", prediction int", [np.full(n, row["problem"]), np.full(n, c), train[rows], hit[rows].astype(np.int32), both[1], (both[1] > both[0]).astype(np.int32)])

    return run
