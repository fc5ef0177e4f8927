"""Whole subtrees grown inside a task, for nodes whose rows fit there.

Rows arrive as distinct bit sets with four counts (training rows, those of class
1, and both numbers of rows that are only carried along).  All rules that reach
the node are grown together, and paths they share are counted once.

Pickled by value, so executors need numpy and pyarrow but not this package.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS = 1_500_000
COUNTS = ("n", "n1", "v", "v1")


def _gini(n1: np.ndarray, n: np.ndarray) -> np.ndarray:
    p = n1 / n
    return 2.0 * p * (1.0 - p)


def _entropy(n1: np.ndarray, n: np.ndarray) -> np.ndarray:
    p = n1 / n

    def part(x: np.ndarray) -> np.ndarray:
        some = np.where(x > 0, x, 1.0)
        return np.where(x > 0, -x * (np.log(some) / np.log(2.0)), 0.0)

    return part(p) + part(1.0 - p)


IMPURITY = {"gini": _gini, "entropy": _entropy}


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, as SQL rounds."""
    return np.sign(x) * np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits


def _gain(criterion: str, n: np.ndarray, n1: np.ndarray, s: np.ndarray, s1: np.ndarray, digits: int) -> np.ndarray:
    measure = IMPURITY[criterion]
    return _rounded(measure(n1, n) - (s * measure(s1, s) + (n - s) * measure(n1 - s1, n - s)) / n, digits)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, …`` of the given sizes, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class _Rows:
    """Distinct bit sets of one node: set positions row by row, and packed for look-up."""

    def __init__(self, table: pa.Table):
        bits = table.column("bits").combine_chunks()
        self.sizes = bits.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = bits.flatten().to_numpy(zero_copy_only=False)
        present = np.zeros(int(flat.max(initial=-1)) + 1, bool)
        present[flat] = True
        self.bits, place = np.flatnonzero(present), np.cumsum(present) - 1
        self.places = place[flat].astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.width = len(self.bits)
        self.counts = {c: table.column(c).to_numpy().astype(np.float64) for c in COUNTS}
        self.packed = np.zeros((len(self.sizes), -(-self.width // 8)), np.uint8)
        step = max(1, CELLS // max(self.width, 1))
        for a in range(0, len(self.sizes), step):
            size = self.sizes[a : a + step]
            wide = np.zeros((len(size), self.width), np.uint8)
            first = self.starts[a]
            wide[np.repeat(np.arange(len(size)), size), self.places[first : first + size.sum()]] = 1
            self.packed[a : a + step] = np.packbits(wide, axis=1)

    def has(self, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        return (self.packed[rows, places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1

    def sums(self, rows: np.ndarray, nodes: np.ndarray, n_nodes: int) -> tuple[np.ndarray, np.ndarray]:
        """Training rows and those of class 1 per node and bit."""
        cells, s, s1 = n_nodes * self.width, 0.0, 0.0
        ends = np.cumsum(self.sizes[rows])
        for a, b in _stretches(ends, CELLS):
            mine = rows[a:b]
            size = self.sizes[mine]
            at = np.repeat(nodes[a:b] * self.width, size) + self.places[_ranges(self.starts[mine], size)]
            s = s + np.bincount(at, np.repeat(self.counts["n"][mine], size), cells)
            s1 = s1 + np.bincount(at, np.repeat(self.counts["n1"][mine], size), cells)
        blank = np.zeros(cells)
        return (blank + s).reshape(n_nodes, self.width), (blank + s1).reshape(n_nodes, self.width)


def _stretches(ends: np.ndarray, most: int):
    """Consecutive stretches ``(from, to)`` of about ``most`` by a running sum."""
    a = 0
    while a < len(ends):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + most, "right")))
        yield a, b
        a = b


def _best(rows: _Rows, wanted: Sequence[tuple], of: np.ndarray, nodes: np.ndarray, asked: np.ndarray, n: np.ndarray, n1: np.ndarray, digits: int) -> np.ndarray:
    """Place of the best bit of every asked node, one column per (criterion, leaf), -1 where no bit splits it.

    ``of`` and ``nodes`` are the rows and their nodes, sorted by node.
    """
    best = np.full((len(asked), len(wanted)), -1, np.int64)
    if not rows.width:
        return best
    step = max(1, CELLS // rows.width)
    for a in range(0, len(asked), step):
        part = asked[a : a + step]
        first, last = np.searchsorted(nodes, [part[0], part[-1] + 1])
        local = np.full(part[-1] - part[0] + 1, -1)
        local[part - part[0]] = np.arange(len(part))
        mine, place = of[first:last], local[nodes[first:last] - part[0]]
        use = (place >= 0) & (rows.counts["n"][mine] > 0)
        s, s1 = rows.sums(mine[use], place[use], len(part))
        size = n[part][:, None]
        at, bit = np.nonzero((s > 0) & (s < size))
        s, s1 = s[at, bit], s1[at, bit]
        gains = {c: _gain(c, n[part][at], n1[part][at], s, s1, digits) for c in sorted({c for c, _ in wanted})}
        for j, (criterion, leaf) in enumerate(wanted):
            table = np.full((len(part), rows.width), -np.inf)
            enough = (s >= leaf) & (n[part][at] - s >= leaf)
            table[at[enough], bit[enough]] = gains[criterion][enough]
            top = table.argmax(1)  # the first, so the lowest bit, on a tie
            best[a : a + step, j] = np.where(table[np.arange(len(part)), top] > -np.inf, top, -1)
    return best


def grow_whole(by: Sequence[str], rules: Mapping[tuple, int], max_depth: int | None, digits: int):
    """Function for ``applyInArrow`` over the rows of one node: all nodes below it, itself included."""
    wanted = sorted({(criterion, leaf) for criterion, _, leaf in rules})
    ordered = sorted(rules.items(), key=lambda r: r[1])
    column = np.array([wanted.index((criterion, leaf)) for (criterion, _, leaf), _ in ordered])
    need = np.array([need for (_, need, _), _ in ordered])
    number = np.array([i for _, i in ordered], np.int32)

    def run(table: pa.Table) -> pa.Table:
        rows = _Rows(table)
        depth = table.column("depth")[0].as_py()
        names = [table.column("node")[0].as_py()]
        reached = set(table.column("rules")[0].as_py())
        active = np.array([[i in reached for i in number.tolist()]])
        of, nodes = np.arange(table.num_rows), np.zeros(table.num_rows, np.int64)
        out: dict[str, list] = {c: [] for c in ("rule", "node", "depth", *COUNTS, "bit")}
        while names:
            sums = {c: np.bincount(nodes, rows.counts[c][of], len(names)) for c in COUNTS}
            n, n1 = sums["n"], sums["n1"]
            picked = np.full(active.shape, -1, np.int64)
            if max_depth is None or depth < max_depth:
                may = active & ((n1 > 0) & (n1 < n))[:, None] & (n[:, None] >= need)
                asked = np.flatnonzero(may.any(1))
                if len(asked):
                    best = _best(rows, wanted, of, nodes, asked, n, n1, digits)
                    picked[asked] = np.where(may[asked], best[:, column], -1)
            node, rule = np.nonzero(active)
            bit = picked[node, rule]
            out["rule"].append(number[rule])
            out["node"].append(pa.array(names, pa.string()).take(pa.array(node)))
            out["depth"].append(np.full(len(node), depth, np.int32))
            for c in COUNTS:
                out[c].append(sums[c][node].astype(np.int64))
            real = rows.bits[np.maximum(bit, 0)] if rows.width else np.zeros(len(bit), np.int64)
            out["bit"].append(pa.array(real.astype(np.int32), mask=bit < 0))

            split = bit >= 0
            if not split.any():
                break
            # a node is split once by each bit that some rule picked
            keys, which = np.unique(node[split] * rows.width + bit[split], return_inverse=True)
            parent, place = keys // rows.width, keys % rows.width
            names = [
                hashlib.md5(f"{names[p]}>{b}>{side}".encode()).hexdigest()
                for p, b in zip(parent.tolist(), rows.bits[place].tolist()) for side in (0, 1)
            ]
            active = np.zeros((len(names), len(number)), bool)
            active[2 * which, rule[split]] = active[2 * which + 1, rule[split]] = True
            times, before = np.bincount(parent, minlength=len(sums["n"])), np.searchsorted(parent, np.arange(len(sums["n"])))
            mine = _ranges(before[nodes], times[nodes])
            of = np.repeat(of, times[nodes])
            nodes = 2 * mine + rows.has(of, place[mine])
            order = np.argsort(nodes, kind="stable")
            of, nodes, depth = of[order], nodes[order], depth + 1
        made = {c: (pa.concat_arrays(v) if isinstance(v[0], pa.Array) else pa.array(np.concatenate(v))) for c, v in out.items()}
        keys = {c: pa.array([table.column(c)[0].as_py()] * len(made["rule"]), table.schema.field(c).type) for c in by}
        return pa.table({**keys, **made})

    return run
