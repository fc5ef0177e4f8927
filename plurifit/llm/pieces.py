"""Token counts by a tokenizer compiled into a transducer.

The piece model joins neighbours by rank, and whether two tokens may stand side by side depends on these two alone. So
the last token of every prefix of a text is determined, and reading a text is a walk of a deterministic machine:

* a **state** is the set of open tokens: what has been read of a token that may still grow, and the token before it;
* a **transition** on a character carries the change of the number of tokens of the prefix read so far.

States are compiled when they are first met and shared by all texts of a worker. Walks over whole words are
remembered as one transition each.

A chunk of a text maps every state it may be entered in to a state and a count. All entering states meet at the chunk's
first reset (a word start or a character outside the model), so the map is stored as the part before it, the count from there to the
last reset, and the part after it. Such maps compose associatively; the maps of a text are composed in chunk order.

Null text is an empty text: no tokens. Null keys are kept, repeated rows give repeated results, an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

MODEL_FILE = "piece_bpe_32k.model"
CHUNK_CHARS = 1 << 16
SPACE = "▁"
MOST_STATES = 300_000
MOST_WORDS = 700_000
LONG_WORD = 48

State = tuple[tuple[str, str | None, int], ...]
START: State = (("", None, 0),)


class Pieces:
    """Ranks of the joinable pieces, and which tokens may follow each other."""

    def __init__(self, rank: dict[str, int]):
        self.rank = rank
        self.chars = frozenset(p for p in rank if len(p) == 1)
        self.open = frozenset(p[:k] for p in rank for k in range(1, len(p)))
        self.may_follow = lru_cache(1 << 19)(self._may_follow)

    @classmethod
    def read(cls, name: str) -> Pieces:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        usable.sort(key=model.get_score, reverse=True)
        return cls({model.id_to_piece(i): k for k, i in enumerate(usable)})

    def split(self, text: str) -> list[str]:
        """Tokens of a short text: the best-ranked neighbours are joined first, the left ones on a tie."""
        parts = list(text)
        while len(parts) > 1:
            best = min((self.rank.get(a + b, len(self.rank)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == len(self.rank):
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _may_follow(self, left: str | None, token: str) -> bool:
        return self.split((left or "") + token) == ([token] if left is None else [left, token])


class ChunkMap(NamedTuple):
    """``head`` is read in the entering state; without a reset the whole chunk is its head and ``tail`` is None."""

    head: str
    count: int
    tail: str | None


class WordCounts(dict):
    """Tokens of whole words, remembered up to a bound that only limits memory."""

    def __init__(self, walk):
        super().__init__()
        self.walk = walk

    def __missing__(self, word: str) -> int:
        n = self.walk(word)
        if len(word) <= LONG_WORD:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = n
        return n


class Transducer:
    _made: dict[str, Transducer] = {}

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        apart = "".join(re.escape(c) for c in "\n\r\t" if c not in pieces.chars)
        self.words = re.compile(f"{SPACE}+[^{SPACE}{apart}]*|[^{SPACE}{apart}]+|[{apart}]" if apart else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.reset = re.compile(f"(?<=[^{SPACE}])(?={SPACE})" + (f"|(?<=[{apart}])|(?<=.)(?=[{apart}])" if apart else ""), re.S)
        self._clear()
        self.counts = WordCounts(self.walk)

    @classmethod
    def of(cls, name: str) -> Transducer:
        if name not in cls._made:
            cls._made[name] = cls(Pieces.read(name))
        return cls._made[name]

    def _clear(self) -> None:
        self.numbers: dict[State, int] = {START: 0}
        self.states: list[State] = [START]
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def _compile(self, state: State, char: str) -> tuple[State, int]:
        if char not in self.pieces.chars:
            return START, len(char.encode())
        grown, last, count = [], None, None
        for begun, before, ahead in state:
            token = begun + char
            if count is None and token in self.pieces.rank and self.pieces.may_follow(before, token):
                last, count = token, ahead + 1
            if token in self.pieces.open:
                grown.append((token, before, ahead))
        assert count is not None, "no token ends here"
        return (*((t, b, a - count) for t, b, a in grown), ("", last, 0)), count

    def walk(self, text: str) -> int:
        """Number of tokens of a text read from the start state."""
        at, total, moves = 0, 0, self.moves
        for char in text:
            try:
                at, change = moves[at][char]
            except KeyError:
                state, change = self._compile(self.states[at], char)
                if len(self.states) >= MOST_STATES:
                    self._clear()
                    moves, at = self.moves, None
                number = self.numbers.get(state)
                if number is None:
                    number = self.numbers[state] = len(self.states)
                    self.states.append(state)
                    moves.append({})
                if at is not None:
                    moves[at][char] = (number, change)
                at = number
            total += change
        return total

    def count(self, text: str) -> int:
        """Tokens of a text that begins at a reset."""
        return sum(map(self.counts.__getitem__, self.words.findall(text)))

    def map_of(self, chunk: str) -> ChunkMap:
        first = self.reset.search(chunk)
        if first is None:
            return ChunkMap(chunk, 0, None)
        at = len(chunk)
        while at > first.start() and not self.reset.match(chunk, at):
            at -= 1
        return ChunkMap(chunk[: first.start()], self.count(chunk[first.start() : at]), chunk[at:])

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First ``a``, then ``b``."""
        if a.tail is None:
            joined = self.map_of(a.head + b.head)
            if joined.tail is None:
                return ChunkMap(joined.head, b.count, b.tail)
            return self.compose(joined, ChunkMap("", b.count, b.tail)) if b.tail is not None else joined
        met = self.map_of(a.tail + b.head)
        if b.tail is None:
            return ChunkMap(a.head, a.count + (self.count(met.head) + met.count if met.tail is not None else 0), met.head if met.tail is None else met.tail)
        return ChunkMap(a.head, a.count + self.count(a.tail + b.head) + b.count, b.tail)

    def total(self, whole: ChunkMap) -> int:
        """Tokens of a text whose map is ``whole``, entered in the start state."""
        return self.count(whole.head) + whole.count + (self.count(whole.tail) if whole.tail else 0)


def scan(machine: Transducer, maps: list[ChunkMap]) -> ChunkMap:
    """All maps composed by halves, as a parallel prefix scan does."""
    while len(maps) > 1:
        maps = [reduce(machine.compose, maps[i : i + 2]) for i in range(0, len(maps), 2)]
    return maps[0]


def _maps(batches: Iterator[pa.RecordBatch], model: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    machine = Transducer.of(model)
    for batch in batches:
        rows = []
        for row, key, size, text in zip(*(c.to_pylist() for c in batch.columns)):
            marked = SPACE + text.replace(" ", SPACE) if text else ""
            for number, at in enumerate(range(0, len(marked) or 1, CHUNK_CHARS)):
                rows.append((row, key, size, number, *machine.map_of(marked[at : at + CHUNK_CHARS])))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def _totals(batches: Iterator[pa.RecordBatch], model: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    machine = Transducer.of(model)
    for batch in batches:
        counts = [
            machine.total(scan(machine, [ChunkMap(m["head"], m["count"], m["tail"]) for m in maps]))
            for maps in batch.column("maps").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], schema=schema)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL_FILE, limit: int = 4096) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    front = [T.StructField("key", df.schema[key].dataType), T.StructField("n_bytes", T.LongType())]
    chunks = T.StructType([
        T.StructField("row", T.LongType()), *front, T.StructField("chunk", T.LongType()), T.StructField("head", T.StringType()),
        T.StructField("count", T.LongType()), T.StructField("tail", T.StringType()),
    ])
    totals = T.StructType([*front, T.StructField("n_tokens", T.LongType())])
    arrow_chunks, arrow_totals = to_arrow_schema(chunks), to_arrow_schema(totals)
    texts = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"), text_of(text).alias("text")
    )
    maps = texts.mapInArrow(lambda b: _maps(b, model, arrow_chunks), chunks)
    joined = maps.groupBy("row").agg(
        F.first("key").alias("key"), F.first("n_bytes").alias("n_bytes"),
        F.sort_array(F.collect_list(F.struct("chunk", "head", "count", "tail"))).alias("maps"),
    )
    counted = joined.select("key", "n_bytes", "maps").mapInArrow(lambda b: _totals(b, model, arrow_totals), totals)
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
