"""Documents packed into sequences of 2048 tokens by cutting-stock column generation.

A document is its ids and an end id. It is cut at multiples of 2048 ids, and whole pieces of it are packed. Pieces are counted by size class (every
``CLASS`` lengths), a histogram of fixed width. A linear program over patterns, ways to fill one sequence with classes, finds how often each pattern is
used for the fewest sequences; its columns are made on demand by the dynamic program of the unbounded knapsack, priced with the program's duals. Whole
uses of a pattern are kept; what the fractions leave over is a few pieces for each class, packed by best fit, largest first. Then piece number r of its
class looks up the use and the place it belongs to. Pieces are numbered where they are made (task and counter), with the counts of the tasks before
added, so no class, however common, meets in one task; only the pieces of one sequence do.

A null text is an empty one, and has the end id alone. Rows that repeat a key, or have none, are documents of their own. A very long text is tokenized
whole, by one task. Other columns, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import broadcast_if_small
from ..session import materialise
from .common import ranges, text_of, use_package

CAPACITY = 2048
CLASS = 4
END = np.array([1], "<u4")
MEMO_BYTES = 150_000_000
WORDS_A_CALL = 1000
# Texts of these letters mean the same in lower case to the tokenizer, which composes characters and lowers them one by one.
_LATIN = re.compile("[\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u012f\u0131-\u024f]*")
TOKENIZER = "word_bpe_49k.json"
BATCH_CHARS = 3_000_000
OFFSET_ROWS = 200_000
STEADY = 0.7
HOPE = 0.9e-9  # gain below which a pattern is not tried; a step asks for more
GAP = 1.5e-3  # the program ends when its value is proven to be within this part of the best, or within half a sequence

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, task int, number long"
CLOSING = ".,;:!?#*$%&"  # marks that are cut off the end of a word by the tokenizer as well


def _lowered(text: str) -> str:
    """The text in lower case where that means the same."""
    return text.lower() if "<|" not in text and _LATIN.fullmatch(text) else text


class WordIds(dict):
    """Ids of words as packed integers, each word encoded once by the library.

    This tokenizer never joins or looks across white space, so the ids of a text are those of its words in order, in upper or lower case alike. Words are forgotten when they
    take more than ``MEMO_BYTES``; that only costs time.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.held = Tokenizer.from_file(path), 0
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # for words of letters in lower case, which the other steps of the tokenizer leave as they are
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of every text. Only distinct words of the texts become Python strings."""
        cut = pc.ascii_split_whitespace(pa.array(map(_lowered, texts), pa.large_string()))
        coded = cut.flatten().dictionary_encode()
        words, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if self.held > MEMO_BYTES:
            self.clear()
            self.held = 0
        found = list(map(self.get, words))
        new = [i for i, known in enumerate(found) if known is None]
        self._learn([words[i] for i in new if words[i]])
        for i in new:
            found[i] = self.get(words[i], b"")  # a text may begin or end with an empty word
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<u4")[ranges((np.cumsum(size) - size)[code], size[code])]
        ends = np.append(0, np.cumsum(size[code]))[cut.offsets.to_numpy()].tolist()
        for a, b in zip(ends, ends[1:]):
            yield np.concatenate((ids[a:b], END))

    def _learn(self, words: list[str]) -> None:
        """Adds new words; closing marks are cut off first and their ids added.

        Words of letters alone end with their first token that ends a word, so many of them go into one call.
        """
        closed, new = {}, []
        for w in words:
            if w[-1] in CLOSING:
                core = w.rstrip(CLOSING)
                if core and core[-1] < "\u0250" and core[-1] != "\u0130" and core[-1].isalnum():
                    closed[w] = core
                    continue
            new.append(w)
        parts = {p for w, core in closed.items() for p in (core, w[len(core) :])}
        new = [p for p in parts.union(new) if p not in self]
        plain, other = [], []
        for p in new:
            (plain if p.isalpha() and (p.isascii() or _LATIN.fullmatch(p)) else other).append(p)
        for at in range(0, len(plain), WORDS_A_CALL):
            part = plain[at : at + WORDS_A_CALL]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part).lower()], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(part):
                other += part
                continue
            whole = ids.tobytes()
            self.update(zip(part, [whole[a:b] for a, b in zip([0, *ends], ends)]))
        for word, found in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            self[word] = np.array(found.ids, "<u4").tobytes()
        for word, core in closed.items():
            self[word] = self[core] + self[word[len(core) :]]
        self.held += 180 * (len(new) + len(closed)) + 10 * sum(map(len, new))


def _portions(texts: list[str]) -> Iterator[list[str]]:
    """Texts in order, a bounded number of characters at a time."""
    held, n = [], 0
    for text in texts:
        if held and n + len(text) > BATCH_CHARS:
            yield held
            held, n = [], 0
        held.append(text)
        n += len(text)
    if held:
        yield held


def pieces(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Every document cut at multiples of the capacity; ``number`` counts the pieces of a class within a task."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        words = WordIds(tokenizer or public_tokenizers.path(TOKENIZER))
        task, counters = TaskContext.get().partitionId(), [0] * (-(-CAPACITY // CLASS) + 1)
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), []
            at = 0
            for portion in _portions(batch.column(1).to_pylist()):
                for ids in words.of(portion):
                    for start in range(0, len(ids), CAPACITY):
                        part = ids[start : start + CAPACITY]
                        kind = -(-len(part) // CLASS)
                        rows.append((keys[at], start, len(part), zlib.crc32(part.tobytes()), len(ids), kind, task, counters[kind]))
                        counters[kind] += 1
                    at += 1
            if rows:
                names = [f.split(" ")[0] for f in _PIECES.split(", ")]
                kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(over, _PIECES)


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total price for every capacity when class ``w`` weighs ``w`` and may be taken any number of times, and the class taken last (0: none)."""
    # values from the back, so that those of c - 1, ..., 0 lie in order
    back, last, room, held = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64), np.empty(capacity), 0.0
    for c in range(1, capacity + 1):
        offers = np.add(back[capacity + 1 - c :], price[1 : c + 1], room[:c])
        w = offers.argmax()
        offer = offers.item(w)
        if offer > held:
            held, last[c] = offer, w + 1
        back[capacity - c] = held
    return back[::-1].copy(), last


def _taken(value: np.ndarray, last: np.ndarray, capacity: int) -> list[int]:
    out = []
    while capacity > 0:
        if last[capacity]:
            out.append(int(last[capacity]))
            capacity -= out[-1]
        else:
            capacity -= 1
    return out


def _all_taken(last: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """How often each class (column) is taken for each capacity (row)."""
    out, left, at = np.zeros((len(capacity), len(last)), np.int64), capacity.copy(), np.flatnonzero(capacity > 0)
    while len(at):
        w = last[left[at]]
        out[at, w] += 1  # column 0: room that is left free
        left[at] -= np.maximum(w, 1)
        at = at[left[at] > 0]
    out[:, 0] = 0
    return out


def generate(demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often the linear program uses them: least number of sequences that hold ``demand[w]`` pieces of every class ``w``.

    Simplex steps on an explicit inverse; the start fills each pattern with one class. Of each pricing run, the best pattern with every class is
    offered, so one run serves many steps.
    """
    classes = np.flatnonzero(demand)
    if not len(classes):
        return []
    m = len(classes)
    place = {int(w): i for i, w in enumerate(classes)}
    # a slight unevenness keeps steps from going in circles
    want = demand[classes] * (1 + 1e-7 * np.sin(np.arange(m)))
    columns: list[dict[int, int]] = [{int(w): int(capacity // w)} for w in classes]
    inverse = np.diag([1.0 / (capacity // w) for w in classes])
    cost, amount = np.ones(m), inverse @ want

    dual, room = cost @ inverse, np.empty((m, m))

    def step(pattern: dict[int, int], price: float, sign: float = 1.0) -> bool:
        nonlocal inverse, amount, dual
        at = [place[w] for w in pattern]
        times = sign * np.array(list(pattern.values()), np.float64)
        gain = price - float(dual[at] @ times)
        if gain > -1e-9:
            return False
        way = inverse[:, at] @ times
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(way > 1e-9, amount / way, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            return False
        row = inverse[out] / way[out]
        left = amount[out] / way[out]
        np.subtract(inverse, np.multiply(way[:, None], row, room), inverse)
        inverse[out] = row
        amount = np.maximum(amount - way * left, 0.0)
        amount[out] = max(left, 0.0)
        dual = dual + gain * row
        cost[out], columns[out] = price, pattern if sign > 0 else {}
        return True

    # Prices between the program's duals and those of the best bound so far keep the columns from jumping about; the first are the lengths themselves.
    steady, bound, part = classes / capacity, float(want @ classes) / capacity, STEADY
    for _ in range(50 * m):
        dual = cost @ inverse
        if dual.min() < -1e-9 and step({int(classes[dual.argmin()]): 1}, 0.0, -1.0):  # more pieces than wanted: the column that takes one away
            continue
        mixed = part * steady + (1 - part) * np.maximum(dual, 0.0)
        price = np.full(capacity + 1, -1.0)
        price[classes] = mixed
        value, last = knapsack(price, capacity)
        total, proven = float(cost @ amount), float(want @ mixed) / max(value[capacity], 1e-12)
        if proven > bound:
            steady, bound = mixed, proven
        if total <= bound * (1 + max(GAP, 0.5 / bound)):
            break
        gains = mixed + value[capacity - classes]
        moved, chosen = False, np.argsort(-gains, kind="stable")[: max(8, m // 8)]
        taken = _all_taken(last, capacity - classes[chosen])
        taken[np.arange(len(chosen)), classes[chosen]] += 1
        first = {row.tobytes(): i for i, row in reversed(list(enumerate(taken)))}  # each pattern at its first place
        taken = taken[sorted(first.values())]
        times, at = taken[:, classes].astype(np.float64), 0
        while at < len(taken):
            # the next that may gain with the duals as they are; the step itself decides
            hopeful = np.flatnonzero(1.0 - times[at:] @ dual <= -HOPE)
            if not len(hopeful):
                break
            at += int(hopeful[0])
            moved |= step({int(w): int(taken[at, w]) for w in np.flatnonzero(taken[at])}, 1.0)
            at += 1
        if not moved and part == 0.0:
            break
        part = STEADY if moved else 0.0
    return [(p, float(x)) for p, x in zip(columns, amount) if p and x > 1e-9]


def _best_fit(left: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """Patterns for the few pieces left over: largest first, each where it leaves the least room."""
    made, room = [], [[] for _ in range(capacity + 1)]
    for w in range(len(left) - 1, 0, -1):
        for _ in range(int(left[w])):
            at = next((r for r in range(w, capacity + 1) if room[r]), None)
            if at is None:
                made.append({})
                number, at = len(made) - 1, capacity
            else:
                number = room[at].pop()
            made[number][w] = made[number].get(w, 0) + 1
            room[at - w].append(number)
    return made


def plan(demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often each is used, holding every piece counted in ``demand``."""
    used, left = [], demand.astype(np.int64).copy()
    for pattern, amount in sorted(generate(demand, capacity), key=lambda p: -p[1]):
        times = int(amount + 1e-6)
        # the program may plan more than there is of a class
        times = min([times, *(left[w] // n for w, n in pattern.items())])
        if times > 0:
            used.append((pattern, int(times)))
            for w, n in pattern.items():
                left[w] -= n * times
    return used + [(p, 1) for p in _best_fit(left, capacity)]


def _segments(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """``(class, first, last, each, sequence)``: numbers of a class from ``first`` to ``last`` go to sequences from ``sequence`` on, ``each`` at a time."""
    out, next_number, sequence = [], {}, 0
    for pattern, times in patterns:
        for w, n in pattern.items():
            first = next_number.get(w, 0)
            next_number[w] = first + n * times
            out.append((w, first, first + n * times - 1, n, sequence))
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of every piece."""
    spark = docs.sparkSession
    use_package(spark)
    cut = materialise(pieces(docs, tokenizer), "pieces")
    counts = materialise(cut.groupBy("task", "class").agg(F.count(F.lit(1)).alias("n")), "counts")
    n_classes = -(-CAPACITY // CLASS)
    demand = np.zeros(n_classes + 1, np.int64)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():  # one row for each class
        demand[r["class"]] = r["n"]
    segments = spark.createDataFrame(_segments(plan(demand, n_classes)), "class int, first long, last long, each long, base long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("task", "class", before.alias("before"))
    ranked = cut.join(broadcast_if_small(offsets, OFFSET_ROWS), ["task", "class"]).withColumn("number", F.col("number") + F.col("before"))
    # one row for each pattern and class in it: at most some thousands
    placed = ranked.join(F.broadcast(segments), "class").filter("number BETWEEN first AND last").withColumn(
        "sequence_id", F.expr("base + (number - first) DIV each")
    )
    earlier = Window.partitionBy("sequence_id").orderBy(F.col("class").desc(), "number").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset")
    )
