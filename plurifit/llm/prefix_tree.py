"""The tree of shared conversation prefixes, with subtree totals by time-forward processing.

1. Turns are reduced to a 126-bit number of role and text and their length. A range sort by conversation and turn spreads even one endless conversation
   over many tasks; every task sums within its stretch, and the few sums of the stretches before (one row a task) are added. So each turn gets its
   place and the digest of its prefix, ``sum(x_i * R**i) mod P``, which a conversation that continues another one elsewhere can shift.
2. Rebuilt prefixes are grouped by depth and digest: one node each, with its smallest member, members and parent. ``size`` bounds the nodes below it.
3. A subtree of at most ``SHARD`` turns whose parent has more is a shard. Nodes above, the heavy ones, are few per depth; they are cut into paths of one
   smallest member and ``STRIPE`` levels, which are shards too.
4. Within a shard, nodes are sorted by reverse level order. Each takes the messages that wait for it in a priority queue, which spills to disk beyond
   ``QUEUE`` messages, and sends its totals on to its parent; totals of shard roots leave the shard.
5. The roots of the heavy paths pass their totals on in the same way, in one task with one row for each path; then the paths are processed once more,
   with what arrives from the shards below.

The ids of conversations that end at a node are sorted by range, joined in blocks, and the blocks are fed to SHA-256 in order, so no list is ever held.

A null key names no conversation, so such rows take no part. Null turns come first; rows with equal turns are ordered by their digests, and repeated
rows are turns of their own. Null role or text is empty; an empty text counts no bytes. Very long texts are read once. Other columns are not read. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import broadcast_if_small
from ..session import materialise
from .common import map_arrow, use_package

GROUP, HEADS = 5, 9  # conversations that share a start, and the bound of the shared turns
PRIME = 2**127 - 1
ROOT_STEP = int.from_bytes(hashlib.sha256(b"prefix step").digest(), "big") % PRIME
BACK_STEP = pow(ROOT_STEP, -1, PRIME)
SHARD = 8192
STRIPE = 8192
QUEUE = 100_000
IDS_A_BLOCK = 20_000
ROWS_A_TASK = 1_000_000
EMPTY = hashlib.sha256(b"").hexdigest()
ZERO = bytes(16)


def _digest(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, x, n_bytes)``: the texts go no further than this."""

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        xs, sizes = [], []
        for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            role, text = role.encode(), text.encode()
            xs.append(_digest(xxhash.xxh3_128_intdigest(len(role).to_bytes(8, "big") + role + text) % PRIME))
            sizes.append(len(text))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(xs, pa.binary()), pa.array(sizes, pa.int64())], names=["conv_id", "turn", "x", "n_bytes"])

    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    )
    return map_arrow(rows, read, "conv_id long, turn long, x binary, n_bytes long")


def _placed(turns: DataFrame, n_rows: int) -> DataFrame:
    """``(conv_id, i, before, after, n_bytes)``: place of every turn and the digests of the prefixes without and with it."""
    spark = turns.sparkSession
    n_tasks = max(min(spark.sparkContext.defaultParallelism, -(-n_rows // 1000)), -(-n_rows // ROWS_A_TASK), 1)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("x")]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, conv, i, total, power = TaskContext.get().partitionId(), None, 0, 0, 1
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), ([], [], [])
            for key, x in zip(keys, batch.column(2).to_pylist()):
                if key != conv:
                    conv, i, total, power = key, 0, 0, 1
                out[0].append(i)
                out[1].append(_digest(total))
                total = (total + int.from_bytes(x, "big") * power) % PRIME
                out[2].append(_digest(total))
                power = power * ROOT_STEP % PRIME
                i += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([task] * len(keys), pa.int32()), batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), batch.column(3)],
                names=["task", "conv_id", "i", "before", "after", "n_bytes"],
            )

    schema = "task int, conv_id long, i long, before binary, after binary, n_bytes long"
    sorted_ = materialise(turns.repartitionByRange(n_tasks, *order).sortWithinPartitions(*order).mapInArrow(local, schema), "turns")
    # the sum of the first and of the last conversation of every task; only what a boundary cuts is carried on
    ends = sorted_.groupBy("task").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), F.max(F.struct("conv_id", "i", "after")).alias("top"))
    carry, held = {}, (None, 0, 0)  # conversation, turns and sum so far
    for r in ends.orderBy("task").collect():  # one row for each task
        if r["first"] == held[0]:
            carry[r["task"]] = held
        n, total = r["top"]["i"] + 1, int.from_bytes(r["top"]["after"], "big")
        if r["last"] == held[0]:
            n, total = held[1] + n, (held[2] + total * pow(ROOT_STEP, held[1], PRIME)) % PRIME
        held = (r["last"], n, total)
    if not carry:
        return sorted_.drop("task")

    def carried(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.to_pylist()
        for r in rows:
            conv, n, total = carry.get(r["task"], (None, 0, 0))
            if r["conv_id"] == conv:
                power = pow(ROOT_STEP, n, PRIME)
                r["i"] += n
                r["before"], r["after"] = (_digest((total + int.from_bytes(r[c], "big") * power) % PRIME) for c in ("before", "after"))
        return pa.RecordBatch.from_pylist(rows, batch.schema)

    return materialise(map_arrow(sorted_, carried, schema), "placed").drop("task")


def shared_start(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % HEADS


def _rebuilt(placed: DataFrame) -> DataFrame:
    """``(conv_id, depth, digest, parent, n_bytes, total)``: one row for each prefix of every rebuilt conversation, the empty one included."""
    head = F.when(F.col("i") < HEADS, F.struct("i", "before", "after", "n_bytes"))
    known = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.collect_list(head).alias("heads"))  # nine entries at most
    base = known.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("heads").alias("base_heads"))
    both = materialise(known.withColumn("base", F.expr("conv_id - conv_id % 5")).join(base, "base", "left"), "starts")

    def starts(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for r in batch.to_pylist():
            h = shared_start(r["conv_id"])
            start = sorted(r["base_heads"] or [], key=lambda t: t["i"])[:h]
            total = len(start) + max(0, r["n"] - h)
            out.append((r["conv_id"], 0, ZERO, None, 0, total))
            out += [(r["conv_id"], t["i"] + 1, t["after"], t["before"], t["n_bytes"], total) for t in start]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv_id", "depth", "digest", "parent", "n_bytes", "total"])

    def joint(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for r in batch.to_pylist():
            h = shared_start(r["conv_id"])
            if r["n"] > h:
                start = sorted(r["base_heads"] or [], key=lambda t: t["i"])[:h]
                own = next(t["before"] for t in r["heads"] if t["i"] == h)
                out.append((r["conv_id"], h, h - len(start), start[-1]["after"] if start else ZERO, own, len(start) + r["n"] - h))
        if not out:
            return None
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv_id", "h", "shift", "start", "own", "total"])

    def moved(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for r in batch.to_pylist():
            start, own, back = int.from_bytes(r["start"], "big"), int.from_bytes(r["own"], "big"), pow(BACK_STEP, r["shift"], PRIME)
            parent, digest = (_digest((start + (int.from_bytes(r[c], "big") - own) * back) % PRIME) for c in ("before", "after"))
            out.append((r["conv_id"], r["i"] + 1 - r["shift"], digest, parent, r["n_bytes"], r["total"]))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv_id", "depth", "digest", "parent", "n_bytes", "total"])

    schema = "conv_id long, depth long, digest binary, parent binary, n_bytes long, total long"
    joints = map_arrow(both, joint, "conv_id long, h long, shift long, start binary, own binary, total long")
    rest = placed.join(joints, "conv_id").filter("i >= h")
    return materialise(map_arrow(both, starts, schema).unionByName(map_arrow(rest, moved, schema)), "rebuilt")


class SpillingQueue:
    """Messages in order of their address. Beyond ``QUEUE`` of them, a sorted run goes to a nameless file of the task, gone when the task is."""

    def __init__(self, limit: int | None = None):
        self.limit, self.heap, self.runs, self.files = limit or QUEUE, [], [], []

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            kept = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
            for m in sorted(self.heap):
                pickle.dump(m, kept)
            kept.seek(0)
            self.heap = []
            self._next(kept)

    def _next(self, kept) -> None:
        try:
            heapq.heappush(self.runs, (pickle.load(kept), id(kept), kept))
        except EOFError:
            kept.close()

    def pop_at(self, address: tuple) -> Iterator[tuple]:
        """Takes out what waits for an address."""
        while True:
            if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
                if self.runs[0][0][0] != address:
                    return
                message, _, kept = heapq.heappop(self.runs)
                self._next(kept)
                yield message[1]
            elif self.heap and self.heap[0][0] == address:
                yield heapq.heappop(self.heap)[1]
            else:
                return


_TOTALS = "shard string, rank long, key binary, n_children long, n_leaves long, saved long, inside boolean, up_rank long, up_key binary"


def forward(rows: DataFrame, n_tasks: int) -> DataFrame:
    """Subtree totals within shards.

    ``rows`` has nodes ``(shard, rank, key, up_shard, up_rank, up_key, saved, leaf)`` with the leaves and tokens that are their own, and messages that
    arrive from elsewhere (``arrives`` true, with ``n_children, n_leaves, saved``). A parent comes later in the order of ``rank`` and ``key`` than its children. Every node returns its
    totals; ``inside`` tells whether they went to a parent of the same shard.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, queue, waiting, number = None, SpillingQueue(), [], 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    shard, queue, waiting = r["shard"], SpillingQueue(), []
                if r["arrives"]:
                    waiting = [a + b for a, b in zip(waiting or (0, 0, 0), (r["n_children"], r["n_leaves"], r["saved"]))]
                    continue
                children, leaves, saved = waiting or (0, 0, 0)
                waiting, saved = [], saved + r["saved"]
                for _, n, s in queue.pop_at((r["rank"], r["key"])):
                    children, leaves, saved = children + 1, leaves + n, saved + s
                leaves += r["leaf"]
                inside = r["up_shard"] == shard
                if inside:
                    number += 1
                    queue.push(((r["up_rank"], r["up_key"]), (number, leaves, saved)))
                out.append((shard, r["rank"], r["key"], children, leaves, saved, inside, r["up_rank"], r["up_key"]))
            if out:
                kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[f.split(" ")[0] for f in _TOTALS.split(", ")])

    dealt = rows.repartition(n_tasks, "shard").sortWithinPartitions("shard", "rank", "key", F.col("arrives").desc())
    return dealt.mapInArrow(over, _TOTALS)


def _as_nodes(df: DataFrame) -> DataFrame:
    return df.select(
        "shard", "rank", "key", "up_shard", "up_rank", "up_key", "saved", F.lit(False).alias("arrives"),
        F.lit(0).cast("long").alias("n_children"), F.lit(0).cast("long").alias("n_leaves"), "leaf",
    )


def _as_messages(df: DataFrame) -> DataFrame:
    nothing = F.lit(None)
    return df.select(
        "shard", "rank", "key", nothing.cast("string").alias("up_shard"), nothing.cast("long").alias("up_rank"), nothing.cast("binary").alias("up_key"),
        "saved", F.lit(True).alias("arrives"), "n_children", "n_leaves", F.lit(0).cast("long").alias("leaf"),
    )


def _ends(rebuilt: DataFrame, n_tasks: int) -> DataFrame:
    """``(depth, digest, ends_sha256)`` of the nodes where conversations end."""
    order = ["depth", "digest", "conv_id"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (None, [])
        names = ["depth", "digest", "first", "ids"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            out = []
            for depth, digest, conv in zip(*[c.to_pylist() for c in batch.columns]):
                if (depth, digest) != held[0] or len(held[1]) == IDS_A_BLOCK:
                    if held[1]:
                        out.append((*held[0], held[1][0], ",".join(map(str, held[1]))))
                    held = ((depth, digest), [])
                held[1].append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        if held[1]:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*held[0], held[1][0], ",".join(map(str, held[1]))), kinds)], names=names)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        names, kinds = ["depth", "digest", "ends_sha256"], [pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            out = []
            for depth, digest, ids in zip(*[batch.column(c).to_pylist() for c in (0, 1, 3)]):
                if (depth, digest) == node:
                    running.update(b"," + ids.encode())
                else:
                    if running:
                        out.append((*node, running.hexdigest()))
                    node, running = (depth, digest), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        if running:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*node, running.hexdigest()), kinds)], names=names)

    ended = materialise(rebuilt.filter("depth = total").select(*order), "ended")
    joined = ended.repartitionByRange(n_tasks, *order).sortWithinPartitions(*order).mapInArrow(blocks, "depth long, digest binary, first long, ids string")
    return joined.repartition(n_tasks, "depth", "digest").sortWithinPartitions("depth", "digest", "first").mapInArrow(hashes, "depth long, digest binary, ends_sha256 string")


def prefix_tree(conversations: DataFrame) -> DataFrame:
    """One row for each node: smallest member, depth, parent, members, children, leaves and saved tokens below, digest of the members that end there."""
    spark = conversations.sparkSession
    use_package(spark)
    turns = materialise(_turns(conversations), "read")
    n_rows = turns.count()
    rebuilt = _rebuilt(_placed(turns, n_rows))
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // ROWS_A_TASK))
    nodes = materialise(
        rebuilt.groupBy("depth", "digest").agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("parent").alias("parent"), F.min("n_bytes").alias("n_bytes"),
            F.sum(F.expr("total - depth + 1")).alias("size"),
            F.count_if(F.expr("depth = total")).alias("n_ends"),
        ).withColumn("own", F.expr("(n_convs - 1) * n_bytes")).withColumn("leaf", F.expr("bigint(n_ends = n_convs)")),
        "nodes",
    )
    heavy = nodes.filter(F.col("size") > SHARD)
    path = F.concat_ws(":", F.lit("path"), "conv_id", F.expr("depth DIV {}".format(STRIPE)))
    paths = materialise(heavy.withColumn("shard", path), "heavy")
    parents = broadcast_if_small(paths.select(F.expr("depth + 1").alias("depth"), F.col("digest").alias("parent"), F.col("shard").alias("up_shard"), F.col("conv_id").alias("up_conv")))

    # light nodes: the shard is the first light node on the way down, the same for all members
    roots = broadcast_if_small(
        nodes.filter(F.col("size") <= SHARD).join(parents.select("depth", "parent"), ["depth", "parent"], "left_semi").unionByName(
            nodes.filter((F.col("size") <= SHARD) & (F.col("depth") == 0))
        ).select("depth", "digest", F.concat_ws(":", F.lit("tree"), "depth", F.hex("digest")).alias("shard"))
    )
    of_conv = rebuilt.join(roots, ["depth", "digest"]).select("conv_id", "shard")
    light = nodes.filter(F.col("size") <= SHARD).join(of_conv, "conv_id")
    as_tree = light.join(roots.select("depth", "digest", F.lit(True).alias("top")), ["depth", "digest"], "left").select(
        "shard", F.expr("-depth").alias("rank"), F.col("digest").alias("key"), F.when(F.col("top").isNull(), F.col("shard")).alias("up_shard"),
        F.expr("1 - depth").alias("up_rank"), F.col("parent").alias("up_key"), F.col("own").alias("saved"), "leaf",
    )
    below = materialise(forward(_as_nodes(as_tree), n_tasks), "totals")
    totals = below
    if not paths.isEmpty():
        linked = paths.join(parents, ["depth", "parent"], "left")
        as_path = linked.select(
            "shard", F.expr("-depth").alias("rank"), F.col("digest").alias("key"), "up_shard", F.expr("1 - depth").alias("up_rank"),
            F.col("parent").alias("up_key"), F.col("own").alias("saved"), "leaf",
        )
        where = broadcast_if_small(paths.select(F.expr("-depth").alias("up_rank"), F.col("digest").alias("up_key"), F.col("shard").alias("up_shard")))
        arriving = below.filter("NOT inside").join(where, ["up_rank", "up_key"]).groupBy(
            F.col("up_shard").alias("shard"), F.col("up_rank").alias("rank"), F.col("up_key").alias("key")
        ).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        arriving = materialise(arriving, "arriving")
        # one row for each path: what is its own and what arrives from light shards; then across the roots
        alone = materialise(forward(_as_nodes(as_path).unionByName(_as_messages(arriving)), n_tasks), "paths")
        tops = alone.filter("NOT inside").join(where, ["up_rank", "up_key"], "left")

        def address(shard: str, rank: str, key: str):
            return F.expr(f"-bigint(split_part({shard}, ':', 2))").alias(rank), F.expr(f"unhex(lpad(hex(9223372036854775807 - bigint(split_part({shard}, ':', 3))), 16, '0'))").alias(key)

        across = tops.select(
            F.lit("roots").alias("shard"), *address("shard", "rank", "key"), F.when(F.col("up_shard").isNotNull(), F.lit("roots")).alias("up_shard"),
            *address("up_shard", "up_rank", "up_key"), "saved", F.col("n_leaves").alias("leaf"),
        )
        passed = materialise(forward(_as_nodes(across), 1), "roots")
        sent = tops.select("shard", "up_rank", "up_key", "up_shard", *address("shard", "rank", "key")).join(
            passed.select("rank", "key", "n_leaves", "saved"), ["rank", "key"]
        ).filter("up_shard IS NOT NULL").groupBy(F.col("up_shard").alias("shard"), F.col("up_rank").alias("rank"), F.col("up_key").alias("key")).agg(
            F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")
        )
        above = forward(_as_nodes(as_path).unionByName(_as_messages(arriving)).unionByName(_as_messages(sent)), n_tasks)
        totals = below.unionByName(above)
    named = totals.select(F.expr("-rank").alias("depth"), F.col("key").alias("digest"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"))
    parent = nodes.select(F.expr("depth + 1").alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = _ends(rebuilt, n_tasks)
    return nodes.select("depth", "digest", "parent", "conv_id", "n_convs").join(named, ["depth", "digest"]).join(ends, ["depth", "digest"], "left").join(
        parent, ["depth", "parent"], "left"
    ).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )
