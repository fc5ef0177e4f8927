"""Hashed fingerprints of a batch of texts, inside a task.

All tokens of a stretch of texts lie end to end in one array; runs of n tokens are
made from those of n - 1 in one step, and the positions of a family are marked in
one 0/1 table.  Pickled by value like ``kernels``.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEXT_BYTES = 2_000_000
TEXT_ROWS = 1000
KNOWN_TOKENS = 200_000


def _stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Consecutive texts of bounded bytes and number; a longer text is alone."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(ends):
        before = ends[a - 1] if a else 0
        b = max(a + 1, min(int(np.searchsorted(ends, before + TEXT_BYTES, "right")), a + TEXT_ROWS))
        yield a, b
        a = b


class _Runs:
    """Hashes of all runs of values within their rows, by length, and what is needed to place them."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray, base: int, prime: int):
        self.base, self.prime, self.sizes = base, prime, sizes
        self.first = np.cumsum(sizes) - sizes
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.left = np.repeat(self.first + sizes, sizes) - np.arange(len(values))  # values from here to the end of the row
        self.by_length = {1: values}

    def whole(self, n: int) -> np.ndarray:
        """A hash for every value; it means something only where ``n`` values are left."""
        if n not in self.by_length:
            out, shorter = np.zeros_like(self.by_length[1]), self.whole(n - 1)
            if len(out) >= n:
                out[: len(out) - n + 1] = (shorter[: len(out) - n + 1] * self.base + self.by_length[1][n - 1 :]) % self.prime
            self.by_length[n] = out
        return self.by_length[n]

    def mark(self, table: np.ndarray, n: int, tag: int) -> None:
        at = self.left >= n
        table[self.row[at], (self.whole(n)[at] + tag * self.base) % table.shape[1]] = 1

    def mark_ends(self, table: np.ndarray, n: int, tag: int) -> None:
        """The first and the last run of ``n`` values, the whole of a shorter row."""
        for length in range(1, n + 1):
            rows = np.flatnonzero(self.sizes == length if length < n else self.sizes >= n)
            for at in (self.first[rows], self.first[rows] + self.sizes[rows] - length):
                table[rows, (self.whole(length)[at] + tag * self.base) % table.shape[1]] = 1


def _listed(table: np.ndarray) -> pa.Array:
    """Set positions of every row, ascending."""
    sizes = table.sum(1, dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(table)[1].astype(np.int32)))


def encoder(families: Sequence[str], widths: Mapping[str, int], base: int, prime: int, max_path: int, layer_path: int, radius: int, length_classes: int):
    """Function for ``mapInArrow`` over ``(row_id, structure, lower, dictionary)``: one ``(row_id, bits, fp)`` row per text and family."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}

        def token_hash(token: bytes) -> int:
            found = known.get(token)
            if found is None:
                if len(known) >= KNOWN_TOKENS:
                    known.clear()
                found = known[token] = int(hashlib.md5(token).hexdigest()[:15], 16) % prime
            return found

        def tokens(texts: pa.Array) -> tuple[_Runs, pa.DictionaryArray]:
            lists = pc.split_pattern(texts, " ")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().dictionary_encode()
            hashes = np.array([token_hash(t) for t in words.dictionary.cast(pa.binary()).to_pylist()], np.int64)
            return _Runs(hashes[words.indices.to_numpy()], sizes, base, prime), words

        def encoded(part: pa.RecordBatch) -> dict[str, pa.Array]:
            texts, out = part.column("structure"), {}

            def blank(family: str) -> np.ndarray:
                return np.zeros((part.num_rows, widths[family]), np.uint8)

            if {"Morgan", "RDKit", "Layered"} & set(families):
                paths, words = tokens(texts)
            for family in families:
                if family == "MACCS":
                    out[family] = part.column("dictionary").cast(pa.list_(pa.int32()))
                    continue
                table = blank(family)
                if family == "Morgan":
                    for r in range(radius + 1):
                        paths.mark(table, 2 * r + 1, r)
                        for n in range(r + 1, 2 * r + 1):
                            paths.mark_ends(table, n, r)
                elif family == "RDKit":
                    for n in range(1, max_path + 1):
                        paths.mark(table, n, n)
                elif family == "Layered":
                    folded, _ = tokens(part.column("lower"))
                    lengths = np.minimum(pc.utf8_length(words.dictionary).to_numpy(zero_copy_only=False), length_classes).astype(np.int64)
                    lengths = _Runs(lengths[words.indices.to_numpy()], paths.sizes, base, prime)
                    for layer, runs in enumerate((paths, folded, lengths), start=1):
                        for n in range(1, layer_path + 1):
                            runs.mark(table, n, layer * 100 + n)
                else:
                    chars = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
                    _Runs(chars, pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64), base, prime).mark(table, 3, 3)
                out[family] = _listed(table)
            return out

        for batch in batches:
            for a, b in _stretches(batch.column("structure")):
                part = batch.slice(a, b - a)
                for family, bits in encoded(part).items():
                    named = pa.array([family]).take(pa.array(np.zeros(part.num_rows, np.int8)))
                    yield pa.RecordBatch.from_arrays([part.column("row_id"), bits, named], names=["row_id", "bits", "fp"])

    return run
