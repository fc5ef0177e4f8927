"""Removal of repeated byte strings, by phrases that rolling-hash triggers cut out of the corpus.

As in prefix-free parsing, triggers depend on content alone, so equal stretches are cut alike wherever they lie, and equal
phrases need to be looked at once:

* **Triggers.** Of the 101 strings of 100 bytes inside a window of 200 bytes, the one with the least rolling hash is its trigger (the left one on a
  tie). Every window has one, and equal windows have equal triggers at equal places.
* **Phrases.** Neighbouring windows with one trigger form a phrase: the bytes they cover. The **dictionary** holds the distinct phrases of each
  trigger with their counts, the **parse** where they lie.
* **Order.** Two windows can only be equal if their triggers are. A phrase that occurs twice repeats in all its windows. A trigger with one
  phrase is settled by this, and so is one that occurs once. For the other triggers the dictionary's phrases are compared suffix by suffix, first
  in blocks of 16 neighbouring windows: what all windows of a block share must repeat if one of them does, and if what they cover together
  repeats, all do. Windows of the blocks still open are grouped one by one. This is the corpus order of the suffix array cut at 200 bytes,
  where only equality counts, so equal suffixes are brought together by hash instead of by rank.

Work and rows follow the number of phrases, about one per 51 bytes, and of distinct phrases, not of copies.

Null text is an empty text. Texts shorter than 200 bytes keep everything. Null keys are kept. Rows that repeat a key are rows of their own, told apart
by a 64-bit digest of the text (128 bits where the key is null); a repeated row repeats all its strings, so texts of 200 bytes or more lose everything. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import mix, pack, ranges, text_of, unpack

LENGTH = 200
TRIGGER = 100
BLOCK = 16
BROADCAST_BYTES = 64 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 … base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, n)
        with np.errstate(over="ignore"):
            have = np.full(size, base, np.uint64)
            have[0] = 1
            np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


class Rolling:
    """Hash of any stretch of a text, from running sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[data] * _power(_BASE, n), out=self.sums[1:])
            self.shift = _power(_INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.shift[starts])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        with np.errstate(over="ignore"):
            return mix((self.sums[size:] - self.sums[:n]) * self.shift[:n])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    size, out = 1, values
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def phrases(data: np.ndarray, length: int, trigger: int):
    """(first window, last window, trigger place, trigger hash, phrase hash) of every phrase of a text."""
    if len(data) < length:
        return None
    rolling = Rolling(data)
    hashes = rolling.all(trigger)
    marked = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    place = (_least(marked, length - trigger + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    firsts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    lasts = np.concatenate([firsts[1:] - 1, [len(place) - 1]])
    at = place[firsts]
    with np.errstate(over="ignore"):
        whole = rolling.of(firsts, lasts + length) + (((at - firsts) * 1024 + (lasts - at)).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return firsts, lasts, at, hashes[at], mix(whole)


ROW = "doc long, mark long, first int, last int, ahead int, key long, phrase long"


def _phrase_rows(batches: Iterator[pa.RecordBatch], length: int, trigger: int) -> Iterator[pa.RecordBatch]:
    names = ["doc", "mark", "first", "last", "ahead", "key", "phrase"]
    for batch in batches:
        docs, marks, parts = [], [], []
        for doc, mark, text in zip(*(c.to_pylist() for c in batch.columns)):
            found = phrases(np.frombuffer(text.encode(), np.uint8), length, trigger)
            if found is not None:
                docs += [doc] * len(found[0])
                marks += [mark] * len(found[0])
                parts.append(found)
        if parts:
            first, last, at, key, phrase = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays([
                pa.array(docs, pa.int64()), pa.array(marks, pa.int64()), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
                pa.array((at - first).astype(np.int32)), pa.array(key.astype(np.int64)), pa.array(phrase.astype(np.int64)),
            ], names=names)


def _packed_rows(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The parts of each text as one packed value. Long columns are packed as two halves."""
    for batch in batches:
        blobs = []
        for parts in batch.column("parts"):
            arrays = []
            for c in columns:
                values = np.ascontiguousarray(parts.values.field(c).to_numpy(zero_copy_only=False))
                arrays.append(values.astype(np.uint32) if values.dtype != np.int64 else values.view(np.uint32))
            blobs.append(pack(*arrays))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("mark"), pa.array(blobs, pa.binary())], names=["doc", "mark", "parts"])


def _unpacked(blob: bytes, wide: tuple[bool, ...]) -> list[np.ndarray]:
    return [a.view(np.int64) if long else a.astype(np.int64) for a, long in zip(unpack(blob), wide)]


def _batch(doc, mark, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    front = [pa.array([doc] * n, pa.int64()), pa.array(np.full(n, mark, np.int64))]
    return pa.RecordBatch.from_arrays([*front, *(pa.array(v) for v in columns.values())], names=["doc", "mark", *columns])


def _block_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Blocks of windows of the dictionary's phrases: windows first … last, hash of trigger and common bytes, hash of all bytes, copies."""
    for batch in batches:
        for doc, mark, text, blob in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "text", "parts"))):
            first, last, ahead, key, copies = _unpacked(blob, (False, False, False, True, True))
            low, place = ahead - (last - first), first + ahead
            counts = ahead // BLOCK - low // BLOCK + 1
            k = ranges(low // BLOCK, counts)
            low, high, place, key, copies = (np.repeat(a, counts) for a in (low, ahead, place, key, copies))
            low, high = np.maximum(low, k * BLOCK), np.minimum(high, k * BLOCK + BLOCK - 1)
            rolling = Rolling(np.frombuffer(text.encode(), np.uint8))
            with np.errstate(over="ignore"):
                core = mix(rolling.of(place - k * BLOCK, place - k * BLOCK - BLOCK + 1 + length) ^ mix(key.view(np.uint64) + k.astype(np.uint64)))
                whole = mix(rolling.of(place - high, place - low + length) + (low * 1024 + high).astype(np.uint64))
            yield _batch(doc, mark, {
                "first": (place - high).astype(np.int32), "last": (place - low).astype(np.int32), "core": core.astype(np.int64), "whole": whole.astype(np.int64), "copies": copies,
            })


def _window_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every window of the given blocks: its start, core and hash, and the copies of its block."""
    for batch in batches:
        for doc, mark, text, blob in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "text", "parts"))):
            first, last, core, copies = _unpacked(blob, (False, False, True, True))
            counts = last - first + 1
            starts = ranges(first, counts)
            window = Rolling(np.frombuffer(text.encode(), np.uint8)).of(starts, starts + length)
            yield _batch(doc, mark, {"first": starts.astype(np.int32), "core": np.repeat(core, counts), "window": window.astype(np.int64), "copies": np.repeat(copies, counts)})


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows first … last of each text joined where they meet, packed."""
    for batch in batches:
        blobs = []
        for parts in batch.column("parts"):
            first, last = (parts.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "last"))
            order = np.argsort(first, kind="stable")
            first, reach = first[order], np.maximum.accumulate(last[order])
            cut = np.flatnonzero(first[1:] > reach[:-1] + 1) + 1
            blobs.append(pack(first[np.concatenate([[0], cut])].astype(np.uint32), reach[np.concatenate([cut - 1, [len(reach) - 1]])].astype(np.uint32)))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("mark"), pa.array(blobs, pa.binary())], names=["doc", "mark", "parts"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted stretches; overlapping and touching ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, length: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, named, text, blob in zip(*(batch.column(c).to_pylist() for c in ("doc", "named", "text", "parts"))):
            data = text.encode()
            gone = merged([(a, b + length) for a, b in zip(*(x.tolist() for x in unpack(blob)))]) if blob else []
            at, kept = 0, []
            for a, b in gone:
                kept.append(data[at:a])
                at = b
            left = b"".join([*kept, data[at:]])
            row = [doc if named else None, len(data), len(data) - len(left), len(gone), hashlib.sha256(left).hexdigest()]
            rows.append(row + [left] if keep_text else row)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def repeated_spans(texts: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """(doc, mark, first, last): windows first … last of a text start strings that also start elsewhere. ``texts`` has doc, mark and text."""
    parse = texts.select("doc", "mark", "text").mapInArrow(lambda b: _phrase_rows(b, length, trigger), ROW)
    keys = parse.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("phrase").alias("low"), F.max("phrase").alias("high")).filter("n > 1")
    met = materialise(parse.join(keys.select("key", (F.col("low") == F.col("high")).alias("alike")), "key"), "phrases")

    dictionary = (
        met.filter("NOT alike").groupBy("key", "phrase")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "mark", "first", "last", "ahead")).alias("at"))
    )
    dictionary = materialise(dictionary.select("key", "phrase", "copies", "at.*"), "dictionary")
    copied = met.join(dictionary.filter("copies > 1").select("key", "phrase"), ["key", "phrase"], "left_semi")

    form = "doc long, mark long, first int, last int, core long, whole long, copies long"
    blocks = _with_text(texts, _packed(dictionary, ("first", "last", "ahead", "key", "copies")), "inner").mapInArrow(lambda b: _block_rows(b, length), form)
    blocks = materialise(blocks, "blocks")
    cores = blocks.groupBy("core").agg(F.sum("copies").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high")).filter("n > 1")
    blocks = blocks.join(cores.select("core", (F.col("low") == F.col("high")).alias("alike")), "core")
    blocks = materialise(blocks, "blocks")
    unsettled = blocks.filter("NOT alike")
    wholes = unsettled.groupBy("core", "whole").agg(F.sum("copies").alias("copies"), F.min(F.struct("doc", "mark", "first", "last")).alias("at"))
    wholes = materialise(wholes.select("core", "whole", "copies", "at.*"), "wholes")
    settled = unsettled.filter("copies = 1").join(wholes.filter("copies > 1").select("core", "whole"), ["core", "whole"], "left_semi")

    form = "doc long, mark long, first int, core long, window long, copies long"
    windows = _with_text(texts, _packed(wholes, ("first", "last", "core", "copies")), "inner").mapInArrow(lambda b: _window_rows(b, length), form)
    windows = materialise(windows, "windows")
    twice = windows.groupBy("core", "window").agg(F.sum("copies").alias("all")).filter("all > 1").select("core", "window")
    single = windows.filter("copies = 1").join(twice, ["core", "window"], "left_semi")

    spans = ["doc", "mark", "first", "last"]
    found = met.filter("alike").select(spans).union(copied.select(spans)).union(blocks.filter("alike AND copies = 1").select(spans))
    return found.union(settled.select(spans)).union(single.select("doc", "mark", "first", F.col("first").alias("last")))


def _packed(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    listed = rows.groupBy("doc", "mark").agg(F.collect_list(F.struct(*columns)).alias("parts"))
    return listed.mapInArrow(lambda b: _packed_rows(b, columns), "doc long, mark long, parts binary")


def _with_text(texts: DataFrame, parts: DataFrame, how: str) -> DataFrame:
    """Texts with their packed parts; the parts are broadcast if their measured bytes allow it."""
    parts = materialise(parts, "parts").toDF("_doc_", "_mark_", "parts")
    size, = parts.agg(F.coalesce(F.sum(F.octet_length("parts") + 64), F.lit(0))).first()
    if size <= BROADCAST_BYTES:
        parts = F.broadcast(parts)
    joined = texts.join(parts, (texts["doc"] == parts["_doc_"]) & (texts["mark"] == parts["_mark_"]), how)
    return joined.select(*texts.columns, "parts")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    whole = text_of(text)
    number = F.col(key).cast("long")
    # a row is told by its key and a digest of its text; a second digest stands in for a null key
    texts = df.select(F.coalesce(number, F.xxhash64(F.lit("null key"), whole)).alias("doc"), F.xxhash64(whole).alias("mark"), whole.alias("text"), number.isNotNull().alias("named"))
    spans = repeated_spans(texts, length, length // 2)
    gone = spans.groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "last")).alias("parts")).mapInArrow(_run_rows, "doc long, mark long, parts binary")
    fields = [
        T.StructField(key, T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
    ]
    schema = T.StructType(fields + ([T.StructField("kept", T.BinaryType())] if keep_text else []))
    arrow = to_arrow_schema(schema)
    return _with_text(texts, gone, "left").mapInArrow(lambda b: _kept_rows(b, arrow, length, keep_text), schema)
