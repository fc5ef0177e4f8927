"""Benchmark decontamination by greedy string tiling.

Runs of ``seed`` words that a document shares with a benchmark item are the seeds. For each (document, item) with seeds, the
longest matches are marked one after another, none overlapping an earlier one, until no match of ``seed`` words is left
unmarked. The share of the item's words under such tiles is its coverage; passages put in another order still cover it.

Seeds are rolling hashes of word runs (Karp-Rabin), and a match grows along one diagonal, word hash by word hash.
Items shorter than ``seed`` words are one seed of their own length.

The item table is sent to the tasks only if its counted seeds are at most ``broadcast_seeds``; a larger one is joined by a
shuffle on the seed. Both ways give the same rows.

Words are runs of letters, digits and underscores, without regard to case. Null or empty texts and items have no words and never match. Null keys
are kept. Repeated rows of either table give repeated results. An empty table on either side gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, in_task, shingle_ids, text_of, word_ids

SEED = 5
COVERAGE = 0.5
BROADCAST_SEEDS = 1_000_000
MASK_BITS = 22
_TOKENS = re.compile(r"\w+")
_memo = WordHashes()

RESULT = [
    T.StructField("n_tiles", T.LongType()), T.StructField("covered_words", T.LongType()),
    T.StructField("item_words", T.LongType()), T.StructField("coverage", T.DoubleType()),
]


def word_hashes(text: str) -> np.ndarray:
    return word_ids(_TOKENS.findall(text.lower()), _memo)


def tiles(doc: np.ndarray, item: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """(place in item, place in document, length) of the tiles, longest first; earlier places win ties."""
    size = min(seed, len(item))
    if not size or len(doc) < size:
        return []
    in_item, in_doc = shingle_ids(item, size), shingle_ids(doc, size)
    by_hash: dict[int, list[int]] = {}
    for i, h in enumerate(in_item.tolist()):
        by_hash.setdefault(h, []).append(i)
    places = np.flatnonzero(np.isin(in_doc, in_item))
    diagonals: dict[int, list[int]] = {}
    for j, h in zip(places.tolist(), in_doc[places].tolist()):
        for i in by_hash[h]:
            diagonals.setdefault(j - i, []).append(i)
    queue = []
    for d, starts in diagonals.items():
        starts.sort()
        first = last = starts[0]
        for i in [*starts[1:], None]:
            if i is not None and i == last + 1:
                last = i
                continue
            queue.append((-(last - first + size), first, first + d))
            first = last = i
    heapq.heapify(queue)
    item_free, doc_free = np.ones(len(item), bool), np.ones(len(doc), bool)
    found = []
    while queue:
        length, i, j = heapq.heappop(queue)
        length = -length
        free = item_free[i : i + length] & doc_free[j : j + length]
        if free.all():
            found.append((i, j, length))
            item_free[i : i + length] = doc_free[j : j + length] = False
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= size:
                heapq.heappush(queue, (-(b - a), i + a, j + a))
    return found


def measure(doc: np.ndarray, item: np.ndarray, seed: int) -> tuple[int, int, int, float]:
    found = tiles(doc, item, seed)
    covered = sum(n for _, _, n in found)
    return len(found), covered, len(item), covered / len(item)


class ItemIndex:
    """Seeds of all items, sorted by size and hash."""

    def __init__(self, items: list[np.ndarray], seed: int):
        self.items, self.seed = items, seed
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        owned: dict[int, list[tuple[np.ndarray, int]]] = {}
        for n, words in enumerate(items):
            if len(words):
                size = min(seed, len(words))
                owned.setdefault(size, []).append((np.unique(shingle_ids(words, size)), n))
        for size, parts in owned.items():
            seeds = np.concatenate([s for s, _ in parts])
            owner = np.concatenate([np.full(len(s), n) for s, n in parts])
            order = np.argsort(seeds, kind="stable")
            mask = np.zeros(1 << MASK_BITS, bool)
            mask[(seeds >> np.uint64(64 - MASK_BITS)).astype(np.int64)] = True
            self.by_size[size] = seeds[order], owner[order], mask

    def candidates(self, doc: np.ndarray) -> list[int]:
        """Items that share a seed with the document."""
        found: set[int] = set()
        for size, (seeds, owner, mask) in self.by_size.items():
            own = shingle_ids(doc, size)
            own = np.unique(own[mask[(own >> np.uint64(64 - MASK_BITS)).astype(np.int64)]])
            lo, hi = np.searchsorted(seeds, own, "left"), np.searchsorted(seeds, own, "right")
            for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                found.update(owner[a:b].tolist())
        return sorted(found)


def _schema(df: DataFrame, items: DataFrame, key: str, item_key: str) -> T.StructType:
    return T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(item_key, items.schema[item_key].dataType), *RESULT])


def _over_broadcast(df, items, keys, words, seed, least, key, text, item_key):
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _schema(df, items, key, item_key)
    arrow = to_arrow_schema(schema)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex([word_hashes(w) for w in words], seed)
        for batch in batches:
            rows = []
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc = word_hashes(value)
                for n in index.candidates(doc):
                    result = measure(doc, index.items[n], seed)
                    if result[3] >= least:
                        rows.append((k, keys[n], *result))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.select(F.col(key), text_of(text).alias("text")).mapInArrow(in_task(over, _memo), schema)


def _seed_rows(batches: Iterator[pa.RecordBatch], seed: int, sizes: list[int] | None) -> Iterator[pa.RecordBatch]:
    """(row, seed size, seed) for every distinct seed."""
    for batch in batches:
        for row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = word_hashes(value)
            wanted = sizes if sizes is not None else [min(seed, len(words))] * bool(len(words))
            for size in wanted:
                own = np.unique(shingle_ids(words, size)).astype(np.int64)
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), row)), pa.array(np.full(len(own), size)), pa.array(own)], names=["row", "size", "seed"])


def _over_shuffle(df, items, seed, least, key, text, item_key, item_text):
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _schema(df, items, key, item_key)
    arrow = to_arrow_schema(schema)
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc"), text_of(text).alias("text"))
    tests = items.select(F.monotonically_increasing_id().alias("row"), F.col(item_key).alias("item"), text_of(item_text).alias("text"))
    form = "row long, size long, seed long"
    item_seeds = tests.select("row", "text").mapInArrow(lambda b: _seed_rows(b, seed, None), form)
    sizes = sorted(r["size"] for r in item_seeds.select("size").distinct().collect())
    doc_seeds = docs.select("row", "text").mapInArrow(lambda b: _seed_rows(b, seed, sizes), form)
    pairs = (
        doc_seeds.withColumnRenamed("row", "doc_row").join(item_seeds.withColumnRenamed("row", "item_row"), ["size", "seed"])
        .select("doc_row", "item_row").distinct()
    )
    both = (
        pairs.join(docs.withColumnsRenamed({"row": "doc_row", "text": "doc_text"}), "doc_row")
        .join(tests.withColumnsRenamed({"row": "item_row", "text": "item_text"}), "item_row").select("doc", "item", "doc_text", "item_text")
    )

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, item, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                result = measure(word_hashes(a), word_hashes(b), seed)
                if result[3] >= least:
                    rows.append((doc, item, *result))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return both.mapInArrow(over, schema)


def contaminated(
    df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    seed: int = SEED, coverage: float = COVERAGE, broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """(key, item key, n_tiles, covered_words, item_words, coverage) of every document and item with at least ``coverage``."""
    words = F.coalesce(F.sum(F.size(F.split(text_of(item_text), r"\W+"))), F.lit(0))
    total, = items.agg(words).first()
    if total > broadcast_seeds:
        return _over_shuffle(df, items, seed, coverage, key, text, item_key, item_text)
    rows = items.select(item_key, text_of(item_text).alias("text")).collect()
    return _over_broadcast(df, items, [r[0] for r in rows], [r[1] for r in rows], seed, coverage, key, text, item_key)
