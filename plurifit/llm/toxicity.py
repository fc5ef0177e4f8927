"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text becomes the set of its words, word stems, word pairs, and pairs one word apart, each hashed to a slot. Training keeps a
learning rate per slot and pushes rare slots to exactly zero (L1), so the weights that are left are few and their
number is bounded by the number of slots: they are broadcast with the scoring function.

Training reads at most ``sample`` labelled documents (a documented bound), chosen and ordered by a hash of the key, so
the weights do not depend on partitioning. Scoring reads every whole text.

A null or empty text has no slots and is scored by the bias alone. A null key is never held out and never trained on. A key
labelled more than once counts as toxic if any label says so. Null labels are ignored. Without labels every score is 0.5 of
an untrained model, so nothing is predicted below that; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROLL, WordHashes, in_task, mix, pack, text_of, unpack, word_ids

SLOT_BITS = 20
SLOTS = np.uint64((1 << SLOT_BITS) - 1)
SAMPLE = 12_000
STEM = 5
THRESHOLD = 0.3
LETTERS = re.compile(r"[^\W\d_]+")
_memo, _stems = WordHashes(), WordHashes()
MEMO = _memo.limit = _stems.limit = 150_000


class Stems(dict):
    """Hash of the first letters of each word."""

    def __missing__(self, word: str) -> int:
        value = _stems["^" + word[:STEM]]
        if len(self) >= MEMO:
            self.clear()
        self[word] = value
        return value


_stem_of = Stems()


def slots(text: str) -> np.ndarray:
    """All slots of a text, repeats included."""
    words = LETTERS.findall(text.lower())
    if not words:
        return np.empty(0, np.uint32)
    ids = word_ids(words, _memo)
    stems = np.fromiter(map(_stem_of.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        pairs = mix(ids[:-1] * ROLL + ids[1:])
        skips = mix((ids[:-2] + np.uint64(1)) * ROLL + ids[2:])
        return (np.concatenate([mix(ids), mix(stems), pairs, skips]) & SLOTS).astype(np.uint32)


class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2, for examples given as sets of slots. The last slot is the bias."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(int(SLOTS) + 2)
        self.n = np.zeros(int(SLOTS) + 2)
        self.bias = int(SLOTS) + 1

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == self.bias, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> float:
        at = np.append(at.astype(np.int64), self.bias)
        w = self.weights(at)
        p = sigmoid(w.sum())
        g = p - label
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g
        return p


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def train(examples: list[tuple[np.ndarray, int]], passes: int = 4) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots with a weight, weights, bias)"""
    model = Ftrl()
    for _ in range(passes):
        for at, label in examples:
            model.learn(at, label)
    w = model.weights(np.arange(len(model.z)))
    kept = np.flatnonzero(w[:-1])
    return kept.astype(np.uint32), w[kept].astype(np.float64), float(w[-1])


def held_out(key: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def _example_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [pack(np.unique(slots(t))) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("toxic"), pa.array(packed, pa.binary())], names=["place", "toxic", "slots"])


def _trained(examples: pa.Table) -> pa.Table:
    rows = sorted(zip(*(examples.column(c).to_pylist() for c in ("place", "toxic", "slots"))))
    at, w, bias = train([(unpack(s)[0], y) for _, y, s in rows])
    # two more entries: how many examples were clean and how many toxic
    toxic = sum(y != 0 for _, y, _ in rows)
    slots_, values = [*at, int(SLOTS) + 1, int(SLOTS) + 2, int(SLOTS) + 3], [*w, bias, len(rows) - toxic, toxic]
    return pa.table({"slot": pa.array(slots_, pa.int64()), "weight": pa.array(values, pa.float64())})


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """(weight of every slot, bias) learned from labelled rows that are not held out. At most ``sample`` texts meet in the training task."""
    return fit_counted(df, labels, key, text, sample)[:2]


def fit_counted(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float, int, int]:
    """``fit``, and the numbers of clean and of toxic examples it saw."""
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~held_out(key))
        .groupBy(key).agg(F.max("toxic").cast("long").alias("toxic"))
        .withColumn("place", F.xxhash64(F.col(key).cast("string"))).orderBy("place", key).limit(sample)
    )
    texts = df.filter(F.col(key).isNotNull()).select(key, text_of(text).alias("text")).join(F.broadcast(chosen), key)
    examples = texts.select("place", "toxic", "text").mapInArrow(in_task(_example_rows, _memo, _stems, _stem_of), "place long, toxic long, slots binary")
    rows = examples.withColumn("task", F.lit(1)).groupBy("task").applyInArrow(_trained, "slot long, weight double").toArrow()
    dense = np.zeros(int(SLOTS) + 4)
    dense[rows.column("slot").to_numpy()] = rows.column("weight").to_numpy()
    return dense[:-3], float(dense[-3]), int(dense[-2]), int(dense[-1])


def score(df: DataFrame, weights: np.ndarray, bias: float, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """(key, held_out, score, predicted); with ``keep``, these columns, _score_ and _predicted_, which no other column clashes with."""
    from pyspark.sql.pandas.types import to_arrow_schema

    used = np.flatnonzero(weights).astype(np.uint32)
    values = weights[used]
    columns = keep if keep is not None else [key, "held_out"]
    source = df if keep is not None else df.select(F.col(key), held_out(key).alias("held_out"), F.col(text))
    fields = [source.schema[c] for c in columns] + [T.StructField(n, t) for n, t in zip(("score", "predicted") if keep is None else ("_score_", "_predicted_"), (T.DoubleType(), T.IntegerType()))]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(int(SLOTS) + 1)
        dense[used] = values
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, value in enumerate(batch.column(len(columns)).to_pylist()):
                at = slots(value)
                out[i] = dense[np.unique(at[dense[at] != 0])].sum()
            p = sigmoid(out + bias)
            made = [*batch.columns[: len(columns)], pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(made, schema=arrow)

    return source.select(*columns, text_of(text).alias("_text_")).mapInArrow(in_task(over, _memo, _stems, _stem_of), schema)


def toxicity(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted) of every text."""
    weights, bias = fit(df, labels, key, text, sample)
    return score(df, weights, bias, key, text, threshold)
