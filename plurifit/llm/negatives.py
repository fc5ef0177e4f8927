"""Hard negatives by inner product, found in length buckets that hold sorted coordinate lists.

Components are integers, so every score is exact.  Rows are dealt by label and length into buckets of at most ``BUCKET`` rows; a bucket keeps, for
every coordinate, its rows in the order of their unit values.  An anchor that needs a score of ``low`` can only find it where the cosine reaches
``low / (anchor length * longest row)``: a bucket that would need more than 1 is passed over, and otherwise each of the anchor's ``FOCUS`` largest
coordinates limits the unit value of a row to a range.  Where a range is narrow, its stretch of the sorted list is the candidate set, the other
ranges are intersected with it, and what is left is verified one by one; where no range is narrow, the whole bucket is verified as one product.

``low`` rises as results come in: it starts from the results in a sample of the rows (a bound, never an answer), so a task returns few rows for each
anchor.  Anchors go in portions of at most ``ANCHORS``, which bounds what is sent to the tasks; buckets are read from files and never shuffled again.

Rows with a null key, label or vector, or with a null or non-finite component, take no part. A key on several rows counts once, with the least
label, then the least vector. Vectors of different lengths are filled up with zeros; an empty vector scores 0. Components beyond 2**62 count as
2**62, and scores beyond 64 bits as the largest that fit. Other columns, whatever their names, are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import map_arrow, ranges, use_package

BUCKET = 4096
ROWS_PER_TASK = 16 * BUCKET
ANCHORS = 32_768
ANCHORS_AT_ONCE = 256
FOCUS = 3
NARROW = 16  # a range is narrow if it holds less than this part of the bucket
SAMPLE_OF = 32
LIMIT = 2**62
NONE = np.int64(-(2**63))

POSITIVES, NEGATIVES = 5, 3

_INTEGERS = "vec_id long, label long, length double, size int, v binary"
_BUCKETS = "first_label long, last_label long, longest double, size int, n int, ids binary, labels binary, matrix binary, lists binary"


def _integers(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    ids, labels, lists = batch.columns
    batch = batch.filter(pc.and_(pc.and_(ids.is_valid(), labels.is_valid()), lists.is_valid()))
    if not batch.num_rows:
        return None
    ids, labels, lists = batch.columns
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = np.bincount(row[~np.isfinite(x)], minlength=len(sizes)) == 0
    with np.errstate(invalid="ignore", over="ignore"):
        c = np.clip(np.nan_to_num(np.floor(256.0 * x)), -LIMIT, LIMIT).astype(np.int64)
    length = np.sqrt(np.bincount(row, weights=c.astype(np.float64) ** 2, minlength=len(sizes)))
    ends, out = np.cumsum(sizes), []
    for end, n in zip(ends.tolist(), sizes.tolist()):
        part = c[end - n : end]
        largest = int(np.abs(part).max()) if n else 0
        out.append(part.astype("<i2" if largest < 2**15 else "<i4" if largest < 2**31 else "<i8").tobytes())
    columns = [ids.cast(pa.int64()), labels.cast(pa.int64()), pa.array(length), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "length", "size", "v"]).filter(pa.array(good))


def integers(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, length, size, v)``: components as packed integers, one row for every key that takes part."""
    read = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    made = map_arrow(read, _integers, _INTEGERS).withColumn("label", label)
    return made.groupBy("vec_id").agg(F.min(F.struct("label", "v", "length", "size")).alias("r")).select(
        "vec_id", "r.label", "r.length", "r.size", "r.v"
    )


def _matrix(blobs: list[bytes], sizes: list[int], width: int) -> np.ndarray:
    out = np.zeros((len(blobs), width), np.int64)
    for at, (blob, n) in enumerate(zip(blobs, sizes)):
        if n:
            out[at, :n] = np.frombuffer(blob, f"<i{len(blob) // n}")
    return out


def _units(matrix: np.ndarray) -> np.ndarray:
    values = matrix.astype(np.float64)
    length = np.sqrt((values**2).sum(1))
    return values / np.where(length > 0, length, 1.0)[:, None]


def _bucket(rows: list[tuple]) -> dict:
    ids, labels, lengths, sizes, blobs = zip(*rows)
    width = max(sizes)
    matrix = _matrix(blobs, sizes, width)
    largest = int(np.abs(matrix).max()) if matrix.size else 0
    kind = "<i2" if largest < 2**15 else "<i4" if largest < 2**31 else "<i8"
    lists = np.argsort(_units(matrix), axis=0, kind="stable").T.astype("<u2")
    return {
        "first_label": labels[0], "last_label": labels[-1], "longest": max(lengths), "size": width, "n": len(rows), "ids": np.array(ids, "<i8").tobytes(),
        "labels": np.array(labels, "<i8").tobytes(), "matrix": matrix.astype(kind).tobytes(), "lists": lists.tobytes(),
    }


def buckets(rows: DataFrame, n_rows: int) -> DataFrame:
    """Rows sorted by label and falling length, cut into buckets; a bucket ends with its label unless it is small."""
    n_tasks = max(min(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // BUCKET)), -(-n_rows // ROWS_PER_TASK), 1)
    order = [F.col("label"), F.col("length").desc(), F.col("vec_id")]
    schema = pa.schema([
        ("first_label", pa.int64()), ("last_label", pa.int64()), ("longest", pa.float64()), ("size", pa.int32()), ("n", pa.int32()),
        ("ids", pa.binary()), ("labels", pa.binary()), ("matrix", pa.binary()), ("lists", pa.binary()),
    ])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if len(held) == BUCKET or (held and len(held) >= BUCKET // 8 and held[-1][1] != row[1]):
                    yield pa.RecordBatch.from_pylist([_bucket(held)], schema)
                    held = []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist([_bucket(held)], schema)

    return rows.repartitionByRange(n_tasks, *order).sortWithinPartitions(*order).mapInArrow(build, _BUCKETS)


def exact_scores(a: np.ndarray, b: np.ndarray, pairs: bool = False) -> np.ndarray:
    """Inner products of integer rows, all with all or row by row, in the narrowest arithmetic that is exact."""
    bound = (int(np.abs(a).max()) if a.size else 0) * (int(np.abs(b).max()) if b.size else 0) * max(a.shape[1], 1)
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object
    a, b = a.astype(kind), b.astype(kind)
    found = (a * b).sum(1) if pairs else a @ b.T
    if kind is object:
        found = np.minimum(np.maximum(found, -(2**63) + 1), 2**63 - 1)
        return found.astype(np.int64)
    return found


class Queries:
    """Anchors of a portion and the scores they look for; ``low`` and ``high`` have a column for each band of an anchor."""

    def __init__(self, ids, labels, matrix, low, high, same: bool, k: int):
        self.ids, self.labels, self.matrix, self.low, self.high, self.same, self.k = ids, labels, matrix, low, high, same, k
        self.length = np.sqrt((matrix.astype(np.float64) ** 2).sum(1))
        units = _units(matrix)
        self.focus = np.argsort(-np.abs(units), axis=1, kind="stable")[:, :FOCUS]
        self.value = np.take_along_axis(units, self.focus, 1)


class Best:
    """The first ``k`` results of every band, and the score that a further one needs."""

    def __init__(self, queries: Queries):
        n = queries.low.size
        self.bands, self.k, self.low = queries.low.shape[1], queries.k, queries.low.ravel().copy()
        self.score, self.id = np.full((n, self.k), NONE), np.zeros((n, self.k), np.int64)

    def add(self, key: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        late = (score == self.score[key, -1]) & (vec_id > self.id[key, -1])
        key, score, vec_id = key[~late], score[~late], vec_id[~late]
        if not len(key):
            return
        touched = np.unique(key)
        key = np.concatenate([key, np.repeat(touched, self.k)])
        score = np.concatenate([score, self.score[touched].ravel()])
        vec_id = np.concatenate([vec_id, self.id[touched].ravel()])
        order = np.lexsort((vec_id, -np.maximum(score, NONE + 1), key))
        key, score, vec_id = key[order], score[order], vec_id[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        at = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
        first = at < self.k
        self.score[key[first], at[first]] = score[first]
        self.id[key[first], at[first]] = vec_id[first]
        self.low[touched] = np.maximum(self.low[touched], self.score[touched, -1])


def _limits(queries: Queries, who: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of the unit value that a row needs in each focus coordinate to reach the cosine ``needed``."""
    angle = np.arccos(np.clip(queries.value[who], -1.0, 1.0))
    reach = np.arccos(np.clip(needed, -1.0, 1.0))[:, None]
    return np.cos(np.minimum(angle + reach, np.pi)) - 1e-9, np.cos(np.maximum(angle - reach, 0.0)) + 1e-9


def _candidates(queries: Queries, who: np.ndarray, needed: np.ndarray, units: np.ndarray, lists: np.ndarray):
    """Which anchors have a narrow range, and the (anchor, row) pairs inside all ranges of those."""
    n = len(units)
    least, most = _limits(queries, who, needed)
    start, stop = np.zeros(least.shape, np.int64), np.full(least.shape, n)
    focus = queries.focus[who]
    for coordinate in np.unique(focus):
        at = np.nonzero(focus == coordinate)
        values = units[lists[coordinate], coordinate]
        start[at] = np.searchsorted(values, least[at], "left")
        stop[at] = np.searchsorted(values, most[at], "right")
    count = np.maximum(stop - start, 0)
    best = count.argmin(1)
    each = np.arange(len(who))
    narrow = count[each, best] * NARROW < n
    mine, best = each[narrow], best[narrow]
    sizes = count[mine, best]
    pair = np.repeat(mine, sizes)
    row = lists[np.repeat(focus[mine, best], sizes), ranges(start[mine, best], sizes)].astype(np.int64)
    for j in range(focus.shape[1]):
        value = units[row, focus[pair, j]]
        inside = (value >= least[pair, j]) & (value <= most[pair, j])
        pair, row = pair[inside], row[inside]
    return narrow, pair, row


def _search(queries: Queries, best: Best, bucket: dict) -> None:
    """Offers the rows of one bucket to the anchors."""
    ids, labels = np.frombuffer(bucket["ids"], "<i8"), np.frombuffer(bucket["labels"], "<i8")
    n, size = len(ids), bucket["size"]
    width = max(size, queries.matrix.shape[1])
    matrix = np.zeros((n, width), np.int64)
    if size:
        matrix[:, :size] = np.frombuffer(bucket["matrix"], f"<i{len(bucket['matrix']) // (n * size)}").reshape(n, size)
    lists = np.frombuffer(bucket["lists"], "<u2").reshape(size, n)
    units = _units(matrix)
    if width > size:  # coordinates that no row has
        lists = np.vstack([lists, np.tile(np.arange(n, dtype="<u2"), (width - size, 1))])
    pure = bucket["first_label"] == bucket["last_label"]
    if queries.same:
        open_ = (queries.labels >= bucket["first_label"]) & (queries.labels <= bucket["last_label"])
    else:
        open_ = (queries.labels != bucket["first_label"]) if pure else np.ones(len(queries.ids), bool)
    low = best.low.reshape(-1, best.bands).min(1)
    high = queries.high.max(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        needed = np.where(low > 0, low / (queries.length * bucket["longest"]) * (1 - 1e-12), -1.0)
    who = np.flatnonzero(open_ & (needed <= 1.0) & (high >= low))
    for at in range(0, len(who), ANCHORS_AT_ONCE):
        part = who[at : at + ANCHORS_AT_ONCE]
        cut = part[needed[part] > 0]
        narrow = np.zeros(0, bool)
        if len(cut):
            narrow, pair, row = _candidates(queries, cut, needed[cut], units, lists)
            if len(pair):
                anchor = cut[pair]
                _offer(queries, best, anchor, row, exact_scores(_wide(queries, anchor, width), matrix[row], True), ids, labels)
        rest = np.concatenate([part[needed[part] <= 0], cut[~narrow]])
        if len(rest):
            scores = exact_scores(_wide(queries, rest, width), matrix)
            kind = scores.dtype
            hit = (scores >= low[rest].astype(kind)[:, None]) & (scores <= high[rest].astype(kind)[:, None])
            a, row = np.nonzero(hit)
            _offer(queries, best, rest[a], row, scores[a, row], ids, labels)


def _wide(queries: Queries, who: np.ndarray, width: int) -> np.ndarray:
    matrix = queries.matrix[who]
    return matrix if matrix.shape[1] == width else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def _offer(queries: Queries, best: Best, anchor, row, score, ids, labels) -> None:
    score, vec_id = score.astype(np.int64), ids[row]
    alike = labels[row] == queries.labels[anchor]
    fits = alike & (vec_id != queries.ids[anchor]) if queries.same else ~alike
    anchor, score, vec_id = anchor[fits], score[fits], vec_id[fits]
    for band in range(best.bands):
        key = anchor * best.bands + band
        inside = (score >= best.low[key]) & (score <= queries.high[anchor, band])
        best.add(key[inside], score[inside], vec_id[inside])


def _found(stored: DataFrame, queries: Queries) -> DataFrame:
    """``(anchor, band, vec_id, score)`` with at least the first ``k`` results of every band, ``anchor`` being a place in the portion."""
    sent = stored.sparkSession.sparkContext.broadcast(queries)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best = Best(asked)
        for batch in batches:
            for bucket in batch.to_pylist():
                _search(asked, best, bucket)
        key, place = np.nonzero(best.score > NONE)
        for at in range(0, len(key), 100_000):
            k, p = key[at : at + 100_000], place[at : at + 100_000]
            arrays = [k // best.bands, k % best.bands, best.id[k, p], best.score[k, p]]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names=["anchor", "band", "vec_id", "score"])

    found = stored.mapInArrow(over, "anchor long, band long, vec_id long, score long")
    order = Window.partitionBy("anchor", "band").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= queries.k)


def _raised(sample: DataFrame, queries: Queries) -> Queries:
    """``low`` raised to the score of the last of ``k`` results among the sampled rows: the whole table has no worse ones."""
    last = _found(sample, queries).filter(F.col("rank") == queries.k).select("anchor", "band", "score").toArrow()  # a row for each band of the portion at most
    low = queries.low.copy()
    at = last.column("anchor").to_numpy(), last.column("band").to_numpy()
    low[at] = np.maximum(low[at], last.column("score").to_numpy())
    return Queries(queries.ids, queries.labels, queries.matrix, low, queries.high, queries.same, queries.k)


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for anchors whose ``vec_id`` is a multiple of ``every``.

    The ``positives`` best other rows of an anchor's label each get the ``negatives`` best rows of other labels that score between 50 and 95 % of them.
    """
    spark = vectors.sparkSession
    use_package(spark)
    rows = materialise(integers(vectors), "vectors")
    n_rows = rows.count()
    stored = materialise(buckets(rows, n_rows), "buckets")
    sampled = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(SAMPLE_OF)) == 0)
    sample = materialise(buckets(sampled, -(-n_rows // SAMPLE_OF)), "sample")
    asked = rows.filter(F.col("vec_id") % every == 0)
    n_portions = -(-asked.count() // ANCHORS)
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for portion in range(n_portions):
        mine = asked.filter(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_portions)) == portion).orderBy("vec_id").toArrow()
        for at in range(0, mine.num_rows, ANCHORS):  # a portion dealt by hash may be a little larger
            out = out.unionByName(_mined(stored, sample, mine.slice(at, ANCHORS), positives, negatives))
    return out


def _mined(stored: DataFrame, sample: DataFrame, anchors: pa.Table, positives: int, negatives: int) -> DataFrame:
    spark, n = stored.sparkSession, anchors.num_rows
    ids, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
    sizes = anchors.column("size").to_pylist()
    matrix = _matrix(anchors.column("v").to_pylist(), sizes, max(sizes))
    wide = Queries(ids, labels, matrix, np.full((n, 1), NONE), np.full((n, 1), 2**63 - 1), True, positives)
    near = _found(stored, _raised(sample, wide)).select("anchor", "rank", "vec_id", "score").toArrow()  # at most ``positives`` rows an anchor
    at = near.column("anchor").to_numpy(), near.column("rank").to_numpy() - 1
    positive_id, positive = np.zeros((n, positives), np.int64), np.zeros((n, positives), np.int64)
    low, high = np.full((n, positives), 2**63 - 1), np.full((n, positives), NONE)  # no score fits where there is no positive
    score = near.column("score").to_numpy()
    positive_id[at], positive[at] = near.column("vec_id").to_numpy(), score
    low[at], high[at] = -(-score // 2), score + -score // 20  # half of it and 95 % of it, without overflow
    bands = Queries(ids, labels, matrix, low, high, False, negatives)
    found = materialise(_found(stored, _raised(sample, bands)), "negatives")
    known = spark.createDataFrame(
        pa.table({
            "anchor": pa.array(at[0], pa.int64()), "band": pa.array(at[1], pa.int64()), "anchor_id": pa.array(ids[at[0]], pa.int64()),
            "positive_id": pa.array(positive_id[at], pa.int64()), "positive_score": pa.array(score, pa.int64()),
        }),
        "anchor long, band long, anchor_id long, positive_id long, positive_score long",
    )
    return found.join(F.broadcast(known), ["anchor", "band"]).select(  # a row for each positive of the portion
        "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
