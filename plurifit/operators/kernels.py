"""Small numpy helpers that run inside tasks.

They are pickled by value, so executors need numpy and pyarrow but not this
package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _grid(words: np.ndarray, word_bits: int) -> np.ndarray:
    """Block of vectors as a float matrix; whole numbers below 2**53 stay exact."""
    if not word_bits:
        return words.astype(np.float64)
    shifts = np.arange(word_bits, dtype=np.int64)
    return ((words[:, :, None] >> shifts) & 1).reshape(len(words), -1).astype(np.float64)


def _block(column: pa.Array, i: int, word_bits: int):
    """Vectors, flattened ids and ids-per-vector of the i-th block of a column."""
    items = column[i].values
    words = items.field("words")
    width = len(words.flatten()) // len(items)
    vectors = _grid(words.flatten().to_numpy(zero_copy_only=False).reshape(len(items), width), word_bits)
    ids = items.field("ids")
    sizes = ids.value_lengths().to_numpy(zero_copy_only=False)
    return vectors, ids.flatten().to_numpy(zero_copy_only=False), sizes


def _nearest(queries, refs, keep: int, limit=None):
    """The ``keep`` best ``(query, distance, id)`` of each query, by (distance, id)."""
    q, q_ids, q_sizes = queries
    r, r_ids, r_sizes = refs
    norms_q, norms_r = (q * q).sum(1), (r * r).sum(1)
    if max(norms_q.max(), norms_r.max()) > 2.0**50:
        raise ValueError("vectors leave the range in which distances are exact")
    dist = (norms_q[:, None] + norms_r[None, :] - 2.0 * (q @ r.T)).astype(np.int64)
    dist = np.repeat(dist, r_sizes, axis=1)
    by_id = np.argsort(r_ids, kind="stable")
    dist, ids = dist[:, by_id], r_ids[by_id]
    order = np.argsort(dist, axis=1, kind="stable")[:, :keep]
    best = np.take_along_axis(dist, order, axis=1)
    q_rep = q_ids[np.concatenate(([0], np.cumsum(q_sizes)[:-1]))]
    owner = np.repeat(np.arange(len(q)), best.shape[1])
    out_d, out_id = best.ravel(), ids[order].ravel()
    if limit is not None:
        within = out_d <= limit[owner]
        owner, out_d, out_id = owner[within], out_d[within], out_id[within]
    return q_rep[owner], out_d, out_id, best


def nearest_in_blocks(by: Sequence[str], keep: int, word_bits: int, paired: bool):
    """Function for ``mapInArrow`` over rows that hold one block, or a pair of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                queries = _block(batch.column("items"), i, word_bits)
                limit = None
                if paired:
                    refs = _block(batch.column("ref_items"), i, word_bits)
                    limit = batch.column("items")[i].values.field("far").to_numpy(zero_copy_only=False)
                else:
                    refs = queries
                q, d, ids, _ = _nearest(queries, refs, keep, limit)
                keys = [pa.array([batch.column(c)[i].as_py()] * len(q), batch.column(c).type) for c in by]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(ids, pa.int64())],
                    [*by, "q", "d", "id"],
                )

    return run


def gram_of_bits(width: int):
    """Function for ``mapInArrow``: one Gram matrix per task over (bits, one-hot y, 1)."""
    size = width + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            bits, hit = batch.column("bits"), batch.column("hit").to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), bits.value_lengths().to_numpy(zero_copy_only=False))
            x = np.zeros((batch.num_rows, size))
            x[owner, bits.flatten().to_numpy(zero_copy_only=False)] = 1.0
            x[np.arange(batch.num_rows), width + hit] = 1.0
            x[:, width + 2] = 1.0
            total += x.T @ x
        if total[-1, -1] > 0:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"]
            )

    return run


def add_rows(size: int):
    """Function for ``applyInArrow``: the sum of the rows with one number."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.column("row").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        return pa.table({"i": table.column("i").slice(0, 1), "row": pa.array([rows.sum(0)], pa.list_(pa.float64()))})

    return run


def pls_coefficients(full: np.ndarray, width: int, components: int):
    """PLS2 regression on centred, scaled columns, from the Gram matrix alone."""
    n = full[-1, -1]
    sums = full[-1, : width + 2]
    mean = sums / n
    cross = full[: width + 2, : width + 2] - n * np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cross), 0.0) / max(n - 1, 1))
    spread[spread == 0] = 1.0
    cross = cross / np.outer(spread, spread)
    xx, xy = cross[:width, :width], cross[:width, width:].copy()
    weights, loadings, targets, turned = [], [], [], []
    for _ in range(components):
        if np.abs(xy).max() < 1e-9:
            break
        w = np.linalg.svd(xy, full_matrices=False)[0][:, 0]
        w = w * np.sign(w[np.argmax(np.abs(w))])
        r = w.copy()
        for p, earlier in zip(loadings, turned):
            r -= (p @ w) * earlier
        length = r @ xx @ r
        if length < 1e-9:
            break
        p, q = xx @ r / length, xy.T @ r / length
        xy -= length * np.outer(p, q)
        weights.append(w), loadings.append(p), targets.append(q), turned.append(r)
    coef = np.zeros((width, 2))
    if turned:
        coef = np.stack(turned, 1) @ np.stack(targets, 1).T
    coef = coef / spread[:width, None] * spread[None, width:]
    return coef, mean[width:] - mean[:width] @ coef
