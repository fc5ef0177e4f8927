"""Helpers shared by the text operators: reading, Arrow batches, word hashes, packed arrays."""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD_PATTERN)
MEMO_WORDS = 400_000

_LOWER_ASCII = {c: c + 32 for c in range(65, 91)}


def use_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did, if it is not installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    use_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: str) -> str:
    """A-Z in lower case, nothing else changed."""
    return text.lower() if text.isascii() else text.translate(_LOWER_ASCII)


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with a function that takes one batch."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = rows(batch)
            if made is not None and made.num_rows:
                yield made

    return df.mapInArrow(over, schema)


ROWS_AT_ONCE = 1000


def give_back() -> None:
    """Returns freed memory to the system, which allocators otherwise keep for a worker's next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def in_task(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *memos: dict) -> Callable:
    """A function for ``mapInArrow`` that gets few texts at a time and forgets its words when the task ends, since workers go on to other tasks."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE))
        finally:
            for memo in memos:
                memo.clear()
            give_back()

    return over


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound that only limits memory."""

    limit = MEMO_WORDS

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value


def word_ids(words: list[str], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: spreads every input bit over the whole word."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


ROLL = np.uint64(0x9E3779B97F4A7C15)


def shingle_ids(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, in order."""
    if len(ids) < size:
        return np.empty(0, np.uint64)
    n = len(ids) - size + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * ROLL + ids[k : k + n]
        return mix(out)


def pack(*arrays: np.ndarray) -> bytes:
    """uint32 and uint8 arrays as one compressed value; bytes of equal rank lie side by side."""
    head = np.array([len(arrays)] + [v for a in arrays for v in (a.itemsize, len(a))], "<u8").tobytes()
    body = [a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.itemsize > 1 else a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(raw, "<u8", 1)[0])
    sizes = np.frombuffer(raw, "<u8", 2 * count, 8).astype(int).reshape(count, 2)
    at, out = 8 + 16 * count, []
    for width, n in sizes:
        part = np.frombuffer(raw, np.uint8, width * n, at)
        out.append(part if width == 1 else np.ascontiguousarray(part.reshape(width, n).T).view(f"<u{width}").ravel())
        at += width * n
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, …`` (``counts[i]`` of them) for every i, joined."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)
