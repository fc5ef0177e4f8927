"""Near-duplicate documents by an exact Jaccard join on word shingles, with prefix filters under several orders.

Two sets with a Jaccard similarity of at least ``percent`` share a token among the first few of each under **any** order of all
tokens. So a pair must share a prefix token under the first order to become a candidate, and under two more, independent orders
before its sets are compared. The first order puts widespread shingles last, so passages that many documents share rarely lead to candidates.

Only components are asked for, so not every pair is compared:

1. Documents with equal sets are one node, named by its least key.
2. Documents that share a prefix token form a group; widespread tokens are salted into groups of bounded size whose leaders form a group of their own.
   Each document is first compared with one group leader, the one with which it shares most prefix tokens. A large group of near copies
   becomes one component here, at one comparison per document.
3. Twice, each member of a group with several components is compared with the most central node of a group. Near copies with edits of
   their own, which the first leader may not be linked with, join here.
4. Of the remaining candidates only pairs in different components are compared: all whose number of shared prefix tokens allows the similarity.
   (A pair with c of them has at most max(ceil(0.8 n), ceil(0.8 m)) - 1 + c tokens in common.) In large groups the count is taken where the
   candidates meet: each carries the list of its prefix tokens of large groups, and a pair comes out at the first token of both lists only. Pairs of small
   groups, and of nodes with more than 512 such tokens, come out at every token; all are added up afterwards.

So every link between components is found; links inside one change nothing. Comparisons of a leader are dealt out in portions of bounded size. Sets are
rebuilt from the texts of the documents concerned and are never shuffled for all documents.

Keys are integers. Rows with a null key have a null component and link with nothing; their sets are counted. Null or empty texts have
no shingles and link with nothing. Rows that repeat a key are one document whose texts all count. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import broadcast_if_small
from ..session import discard, materialise, settings
from .common import in_task, mix, shingle_ids, text_of
from .components import components

SHINGLE = 5
PERCENT = 80
COUNTED_TOGETHER = 1_000_000
WIDESPREAD_IN_TASK = 3
WIDESPREAD_TOKENS = 200_000
PORTION = 128
GROUP_ROWS = 5_000
CENTRAL_ROUNDS = 2
LISTED = 512
SMALL_GROUP = 4
SIEVE_BITS = 22
BROADCAST_KEYS = 500_000
# Shuffle files go as soon as the table made from them is written, and texts travel a few at a time.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "500"}
ORDERS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))
# Words are hashed as polynomials over random values of their bytes, A-Z as a-z. The base is odd, so it has an inverse modulo 2^64.
CHUNK = 1 << 15
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
WHOLE = (1 << 64) - 1
_STEP, _BACK = pow(BASE, CHUNK, 1 << 64), pow(INVERSE, CHUNK, 1 << 64)
TEXTS_TOGETHER = 100


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSES = _powers(BASE), _powers(INVERSE)
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_VALUES[65:91] = _VALUES[97:123]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word. The bytes end with white space.

    Sums up to every place are made chunk by chunk; a word is the difference of two of them, wherever it begins and however long it is.
    """
    every, before = np.frombuffer(data, np.uint8), False
    base, scale, back = 0, 1, 1
    places, sums, shifts = [], [], []
    for at in range(0, len(every), CHUNK):
        part = every[at : at + CHUNK]
        inside = _IN_WORD[part]
        upto = np.cumsum(_VALUES[part] * _POWERS[: len(part)])
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        own = upto[edges - 1] * np.uint64(scale) + np.uint64(base)
        if inside[0] != before:
            edges, own = np.append(0, edges), np.append(np.uint64(base), own)
        places.append(edges + at)
        sums.append(own)
        shifts.append(_INVERSES[edges] * np.uint64(back))
        before = bool(inside[-1])
        base, scale, back = (base + scale * int(upto[-1])) & WHOLE, scale * _STEP & WHOLE, back * _BACK & WHOLE
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    sums = np.concatenate(sums)
    return np.concatenate(places)[::2], mix((sums[1::2] - sums[::2]) * np.concatenate(shifts)[::2])


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text, sorted; a shorter text is one shingle. Words of some texts are hashed together."""
    for at in range(0, len(texts), TEXTS_TOGETHER):
        whole = texts.slice(at, TEXTS_TOGETHER).cast(pa.binary()).to_pylist()
        starts, ids = word_hashes(b"".join(part for t in whole for part in (t, b" ")))
        cuts = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in whole])).tolist()
        every = shingle_ids(ids, size)
        for begin, end in zip(cuts, cuts[1:]):
            n = min(size, end - begin)
            own = np.sort(every[begin : end - size + 1] if n == size else shingle_ids(ids[begin:end], n) if n else every[:0])
            yield own[np.append(True, own[1:] != own[:-1])] if len(own) else own


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes of one text."""
    return next(shingle_sets(pa.array([text], pa.string()), size))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def order(tokens: np.ndarray, which: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(tokens * ORDERS[which] + ORDERS[which])


def sieve_of(widespread: np.ndarray) -> np.ndarray:
    """Whether any widespread token begins with given bits, so that most tokens need no search."""
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[widespread >> np.uint64(64 - SIEVE_BITS)] = True
    return sieve


def among(tokens: np.ndarray, widespread: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the widespread ones among tokens, and their places in ``widespread``."""
    place = np.flatnonzero(sieve[tokens >> np.uint64(64 - SIEVE_BITS)])
    if not len(place):
        return place, place
    at = np.minimum(np.searchsorted(widespread, tokens[place]), len(widespread) - 1)
    found = widespread[at] == tokens[place]
    return place[found], at[found]


def first_prefix(tokens: np.ndarray, widespread: np.ndarray, rank: np.ndarray, sieve: np.ndarray, percent: int) -> np.ndarray:
    """Prefix under the first order: rare tokens by hash, then widespread ones from the rarest on."""
    size = prefix_size(len(tokens), percent)
    place, at = among(tokens, widespread, sieve)
    rare, late = np.delete(tokens, place), tokens[place]
    if len(rare) > size:
        return rare[np.argpartition(order(rare, 0), size - 1)[:size]]
    return np.concatenate([rare, late[np.argsort(rank[at], kind="stable")][: size - len(rare)]])


def _shared(first: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Tokens that each of the others, none of them empty, shares with a sorted set."""
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(first, every), len(first) - 1)
    return np.add.reduceat((first[at] == every).astype(np.int64), np.cumsum([0] + [len(o) for o in others[:-1]]))


def linked(first: np.ndarray, others: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which of the others are linked with a set: an exact test of those that pass the filters of the two further orders."""
    n, sizes = len(first), np.array([len(o) for o in others])
    open_ = np.flatnonzero((sizes > 0) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))) if n else np.empty(0, np.int64)
    for which in (1, 2):
        if len(open_):
            prefixes = [_prefix(others[i], which, percent) for i in open_]
            open_ = open_[_shared(np.sort(_prefix(first, which, percent)), prefixes) > 0]
    found = np.zeros(len(others), bool)
    if len(open_):
        both = _shared(first, [others[i] for i in open_])
        found[open_] = 100 * both >= percent * (n + sizes[open_] - both)
    return found


def _prefix(tokens: np.ndarray, which: int, percent: int) -> np.ndarray:
    size = prefix_size(len(tokens), percent)
    return tokens[np.argpartition(order(tokens, which), size - 1)[:size]] if size < len(tokens) else tokens


def _survey(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(key, n, digest) of every document, and (token, count) of tokens met often in one task."""

    def often(parts: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(parts)
        parts.clear()
        every.sort()
        # where WIDESPREAD_IN_TASK equal ones begin, and of these only the first of each token
        begins = np.flatnonzero(every[: 1 - WIDESPREAD_IN_TASK] == every[WIDESPREAD_IN_TASK - 1 :])
        tokens = np.unique(every[begins])
        counts = np.searchsorted(every, tokens, "right") - np.searchsorted(every, tokens, "left")
        n = len(tokens)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.array(counts.astype(np.int64)), pa.nulls(n, pa.binary()), pa.array(tokens.astype(np.int64))], names=names
        )

    names = ["key", "n", "digest", "token"]
    parts, total, seen = [], 0, set()
    for batch in batches:
        sizes, digests = [], []
        for tokens in shingle_sets(batch.column(1), size):
            digest = hashlib.md5(tokens.tobytes()).digest()
            sizes.append(len(tokens))
            digests.append(digest)
            if digest not in seen:
                seen.add(digest)
                parts.append(tokens)
                total += len(tokens)
                if total >= COUNTED_TOGETHER:
                    yield often(parts)
                    parts, total, seen = [], 0, set()
        rows = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(rows, pa.int64())], names=names)
    if parts:
        yield often(parts)


def _postings(batches: Iterator[pa.RecordBatch], size: int, percent: int, widespread: np.ndarray, rank: np.ndarray, salts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(token, salt, key); salt is -1 where a token has one group only. Equal sets are listed once per task."""
    seen: set[bytes] = set()
    sieve = sieve_of(widespread)
    for batch in batches:
        tokens, keys, counts = [], [], []
        for key, own in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size)):
            digest = hashlib.md5(own.tobytes()).digest()
            if len(own) and digest not in seen:
                seen.add(digest)
                if len(seen) > 500_000:
                    seen.clear()
                tokens.append(first_prefix(own, widespread, rank, sieve, percent))
                keys.append(key)
                counts.append(len(tokens[-1]))
        if keys:
            every, owner = np.concatenate(tokens), np.repeat(np.array(keys, np.int64), counts)
            salt = np.full(len(every), -1, np.int32)
            place, at = among(every, widespread, sieve)
            place, at = place[salts[at] > 1], at[salts[at] > 1]
            salt[place] = (mix(owner[place].astype(np.uint64)) % salts[at].astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(every.astype(np.int64)), pa.array(salt), pa.array(owner)], names=["token", "salt", "key"])


def _set_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array([own.tobytes() for own in shingle_sets(batch.column(1), size)], pa.binary())], names=["key", "tokens"]
        )


def _compare(leaders: pa.Table, members: pa.Table, percent: int) -> pa.Table:
    keys = members.column("b").to_numpy()
    sets = [np.frombuffer(t, np.uint64) for t in members.column("tokens").to_pylist()]
    a = leaders.column("a").to_numpy()[:1]
    hit = np.zeros(len(keys), bool)
    for raw in leaders.column("tokens").to_pylist():
        hit |= linked(np.frombuffer(raw, np.uint64), sets, percent)
    return pa.table({"a": pa.array(np.repeat(a, hit.sum()), pa.int64()), "b": pa.array(keys[hit], pa.int64())})


def _links(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked, written out. The members of ``a`` are compared in portions of bounded size."""
    numbered = pairs.select("a", "b", F.floor((F.row_number().over(Window.partitionBy("a").orderBy("b")) - 1) / PORTION).alias("portion"))
    numbered = materialise(numbered, "pairs")
    wanted = numbered.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    chosen = texts.join(broadcast_if_small(wanted, BROADCAST_KEYS), "key")
    sets = materialise(chosen.mapInArrow(in_task(lambda b: _set_rows(b, size)), "key long, tokens binary"), "sets")
    leaders = numbered.select("a", "portion").distinct().join(sets.toDF("a", "tokens"), "a").toDF("a", "portion", "tokens")
    members = numbered.join(sets.toDF("b", "tokens"), "b").select("a", "portion", "b", "tokens").toDF("a", "portion", "b", "tokens")
    found = leaders.groupBy("a", "portion").cogroup(members.groupBy("a", "portion")).applyInArrow(lambda x, y: _compare(x, y, percent), "a long, b long")
    found = materialise(found, "found")
    discard(sets)  # the largest tables of all; each is read for its own links only
    discard(numbered)
    return found


def _widespread(counted: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens to put last, sorted, their rank from rare to frequent, and their number of salts; at most ``WIDESPREAD_TOKENS``. It only sets an order, so any list gives the same links."""
    top = counted.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(WIDESPREAD_TOKENS).toArrow()
    tokens, counts = top.column("token").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy()
    by_token = np.argsort(tokens)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, counts))] = np.arange(len(tokens))
    return tokens[by_token], rank[by_token], 1 + counts[by_token] // GROUP_ROWS


def _sizes_allow(percent: int) -> Column:
    return (F.col("a_low") * percent <= F.col("b_high") * 100) & (F.col("b_low") * percent <= F.col("a_high") * 100)


def _least_shared(percent: int) -> Column:
    """Fewest shared prefix tokens of a pair that can be linked."""
    needed = F.ceil(F.lit(percent) * (F.col("a_low") + F.col("b_low")) / F.lit(100 + percent))
    return F.greatest(F.lit(1), needed - F.greatest(F.ceil(F.col("a_high") * percent / 100), F.ceil(F.col("b_high") * percent / 100)) + 1)


def _open_members(listed: DataFrame, placed: DataFrame) -> DataFrame:
    """Members, with their components, of the groups that meet more than one component."""
    members = listed.join(placed, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = members.groupBy("token").agg(F.min("component").alias("c"), F.max("component").alias("d")).filter("c < d").select("token")
    return members.join(mixed, "token")


def _central(members: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """One more comparison for each member: with the most central node of a group, the one with the fewest prefix tokens of its own.

    Edits of a copy make tokens that no other document has, so the node without any is the one that most near copies are linked with.
    """
    alone = F.col("high") - F.ceil(F.col("high") * percent / 100) + 1 - F.col("s")
    centres = members.groupBy("token").agg(F.min(F.struct(alone.alias("alone"), "node", "component", "low", "high")).alias("centre"))
    centres = centres.select("token", F.col("centre.node").alias("a"), F.col("centre.component").alias("x"), F.col("centre.low").alias("a_low"), F.col("centre.high").alias("a_high"))
    others = members.select("token", F.col("node").alias("b"), F.col("component").alias("y"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    met = others.join(centres, "token").filter((F.col("x") != F.col("y")) & _sizes_allow(percent)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    met = met.join(tested, ["a", "b"], "left_anti")
    best = met.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("h"))).alias("best"))
    return best.select((-F.col("best.h")).alias("a"), "b")


def _with_lists(members: DataFrame) -> DataFrame:
    """Members with ``tokens``, the node's sorted tokens of large groups, and ``apart``, the number of its other tokens.

    ``tokens`` is null in rows of small groups, where a pair costs less than two lists, and for nodes with over ``LISTED`` tokens of large groups.
    """
    large = members.groupBy("token").agg(F.count(F.lit(1)).alias("g")).filter(F.col("g") > SMALL_GROUP).select("token", F.lit(True).alias("large"))
    marked = materialise(members.join(large, "token", "left"), "marked")
    few = marked.groupBy("node").agg(F.count("large").alias("s"), F.count(F.lit(1)).alias("every")).filter(F.col("s").between(1, LISTED))
    few = few.select("node", (F.col("every") - F.col("s")).cast("int").alias("apart"))
    lists = marked.filter("large").select("node", "token").join(few, "node").groupBy("node").agg(F.sort_array(F.collect_list("token")).alias("tokens"), F.max("apart").alias("apart"))
    listed = marked.filter("large").drop("large").join(lists, "node", "left")
    plain = marked.filter("large IS NULL").drop("large").withColumns({"tokens": F.lit(None).cast("array<long>"), "apart": F.lit(None).cast("int")})
    return materialise(listed.unionByName(plain), "members")


def _digests(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [hashlib.md5(own.tobytes()).digest() for own in shingle_sets(batch.column(1), size)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=["key", "text", "least", "digest"])


def _one_set_each(nodes: DataFrame, known: DataFrame, size: int):
    """Nodes and texts in which no key has several sets, ties between keys, and the least real key (``None``: nothing was changed).

    A key with several sets keeps the set with the least digest; a number below all keys, made from the digest, stands in for it at each of the
    others and is tied to it. Equal sets of different keys get one number.
    """
    several = materialise(nodes.groupBy("key").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).filter("least <> most").select("key", "least"), "several")
    nothing = nodes.sparkSession.createDataFrame([], "a long, b long")
    if several.isEmpty():
        return nodes, known, nothing, None
    start = nodes.agg(F.min("key")).first()[0]
    several = broadcast_if_small(several, BROADCAST_KEYS)
    other = F.lit(start) - 1 - F.xxhash64("digest").bitwiseAND(F.lit((1 << 62) - 1))
    own = F.when(F.col("least").isNull() | (F.col("digest") == F.col("least")), F.col("key")).otherwise(other)
    marked = nodes.join(several, "key", "left").withColumn("own", own)
    ties = marked.filter("own <> key").select(F.col("key").alias("one"), F.col("own").alias("two")).distinct()
    apart = known.join(several, "key").select("key", "text", "least").mapInArrow(
        in_task(lambda b: _digests(b, size)), "key long, text string, least binary, digest binary"
    ).select(own.alias("key"), "text")
    texts = known.join(several, "key", "left_anti").unionByName(apart)
    return marked.select(F.col("own").alias("key"), "n", "digest"), texts, ties, start


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every document."""
    with settings(df.sparkSession, SETTINGS):
        sets, final = _grouped(df, key, text, size, percent)
    return sets.join(final, "key", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id")
    )


def _grouped(df: DataFrame, key: str, text: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(key, n) of every document and (key, component_id) of those with shingles."""
    texts = df.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    survey = materialise(texts.mapInArrow(in_task(lambda b: _survey(b, size)), "key long, n long, digest binary, token long"), "survey")
    sets = survey.filter("digest IS NOT NULL")
    widespread, rank, salts = _widespread(survey.filter("digest IS NULL"))

    known = texts.filter("key IS NOT NULL")
    nodes = sets.filter("key IS NOT NULL AND n > 0").select("key", "n", "digest")
    nodes, known, ties, several = _one_set_each(nodes, known, size)
    named = nodes.groupBy("digest").agg(F.min("key").alias("node"))
    node_of = materialise(nodes.join(named, "digest").groupBy("key").agg(F.min("node").alias("node")), "nodes")
    if several is not None:
        ties = ties.join(node_of.toDF("one", "a"), "one").join(node_of.toDF("two", "b"), "two").select("a", "b")

    postings = known.mapInArrow(in_task(lambda b: _postings(b, size, percent, widespread, rank, salts)), "token long, salt int, key long")
    group = Window.partitionBy("token", "salt")
    grouped = postings.select("token", "salt", "key", F.min("key").over(group).alias("leader"), F.max("key").over(group).alias("high"))
    shared = materialise(grouped.filter("leader < high OR salt >= 0").drop("high"), "shared")
    split = shared.filter("salt >= 0").groupBy("token", "salt").agg(F.min("leader").alias("key"))
    split = split.join(split.groupBy("token").agg(F.min("key").alias("leader")), "token").select("token", "key", "leader")

    sized = nodes.join(named, "digest").groupBy("node").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    node = materialise(node_of.select("key", "node").join(sized, "node").select("key", "node", "low", "high"), "sized")
    met = shared.select("token", "key", "leader").union(split).filter("key <> leader")
    stars = (
        met.groupBy("key", "leader").agg(F.count(F.lit(1)).alias("c"))
        .join(node.toDF("key", "b", "b_low", "b_high"), "key").join(node.toDF("leader", "a", "a_low", "a_high"), "leader").filter("a <> b")
        .groupBy("a", "b", "a_low", "a_high", "b_low", "b_high").agg(F.sum("c").alias("c"))
        # a leader sees a part of the shared tokens only; pairs that look hopeless are left to the full count below
        .filter(_sizes_allow(percent) & (F.col("c") * 4 >= _least_shared(percent)))
    )
    best = stars.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("h"))).alias("best")).select((-F.col("best.h")).alias("a"), "b")
    tested = materialise(best, "best")
    links = materialise(_links(tested, known, size, percent).union(ties), "links")
    first = components(links).toDF("node", "component")

    listed = materialise(shared.select("token", "key").join(node, "key").select("token", "node", "low", "high").distinct(), "listed")
    shares = listed.groupBy("node").agg(F.count(F.lit(1)).alias("s"))
    for _ in range(CENTRAL_ROUNDS):
        members = materialise(_open_members(listed, first).join(shares, "node"), "open")
        pairs = materialise(_central(members, tested, percent), "central")
        links = links.union(_links(pairs, known, size, percent))
        tested = tested.union(pairs)
        listed = members.select("token", "node", "low", "high")  # a group of one component stays one
        first = components(links).toDF("node", "component")

    members = _with_lists(_open_members(listed, first).select("token", "node", "component", "low", "high"))
    members = members.select("token", "node", "component", "low", "high", "tokens", "apart")
    x, y = members.toDF("token", "a", "x", "a_low", "a_high", "a_tokens", "a_apart"), members.toDF("token_", "b", "y", "b_low", "b_high", "b_tokens", "b_apart")
    both = F.array_intersect("a_tokens", "b_tokens")
    once = (F.element_at(both, 1) == F.col("token")) & (F.size(both) + F.least("a_apart", "b_apart") >= _least_shared(percent))
    listed_both = F.col("a_tokens").isNotNull() & F.col("b_tokens").isNotNull()
    rest = (
        x.join(y, (F.col("token") == F.col("token_")) & (F.col("a") < F.col("b")) & (F.col("x") != F.col("y")) & _sizes_allow(percent) & F.when(listed_both, once).otherwise(True))
        .select("a", "b", _least_shared(percent).alias("least"), F.when(listed_both, F.size(both)).otherwise(1).alias("c"))
        .groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("least").alias("least")).filter("c >= least").select("a", "b")
    )
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = links.union(_links(rest.join(done, ["a", "b"], "left_anti"), known, size, percent))

    last = components(links).toDF("node", "component")
    final = node.select("key", "node").join(last, "node", "left").select("key", F.coalesce("component", "node").alias("component_id"))
    if several is not None:  # the least key of a component, not counting the stand-ins
        least = final.filter(F.col("key") >= several).groupBy("component_id").agg(F.min("key").alias("least"))
        final = final.join(least, "component_id").select("key", F.col("least").alias("component_id"))
    return sets, final
