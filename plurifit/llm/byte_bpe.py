"""Byte-level BPE encoding and decoding by a global shuffle of distinct pre-tokens.

1. Every task cuts its whole texts into pre-tokens and numbers the distinct ones of a block of
   documents. A document becomes the list of these numbers in order: the positions.
2. The distinct pre-tokens of all blocks are shuffled by their text, so each is encoded in one place, once,
   and decoded again through the table of token bytes. A very common pre-token has one row per block, not
   one per occurrence, so it cannot fill a task.
3. Ids and bytes return to their block and are put back in order by the positions.

The decoded bytes of each block are compared with the text it was cut from. A scan that gives other rows when it is
read again fails the job instead of giving wrong ids.

Null text is an empty text: no tokens. A null key is kept. Repeated rows give repeated results. An empty table gives an empty one.
Columns other than the key and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_task, pack, ranges, text_of, unpack

RANKS_FILE = "byte_bpe_multi_50k.tiktoken"
BLOCK_CHARS = 32_000_000
BLOCK_WORDS = 500_000
MEMO_WORDS = 50_000

# The published pattern with its letter, digit and space classes written out for texts of ASCII and Latin letters.
# Such texts are cut by the faster standard module, all others by the pattern itself; both give the same pieces.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_SIMPLE = re.compile(f"[\x00-\x7f{_LETTERS}]*")
_SPACE = r"\t\n\x0b\x0c\r "
_FAST = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_SPACE}{_LETTERS}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_exact = None


def pieces(text: str) -> list[str]:
    """The matches of the published pattern in a text."""
    if _SIMPLE.fullmatch(text):
        return _FAST.findall(text)
    global _exact
    if _exact is None:
        import public_tokenizers
        import regex

        _exact = regex.compile(public_tokenizers.PATTERN)
    return _exact.findall(text)


def read_ranks(name: str) -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encodes one pre-token; decodes ids by the table id -> bytes."""

    _made: dict[str, Codec] = {}

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        ranks = read_ranks(name)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.encoding = tiktoken.Encoding("table", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, name: str) -> Codec:
        if name not in cls._made:
            cls._made[name] = cls(name)
        return cls._made[name]

    def encode(self, piece: str) -> list[int]:
        return self.encoding._encode_single_piece(piece)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Numbers(dict):
    """The number of each distinct pre-token of a block, in order of first use."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


def _blocks(batches: Iterator[pa.RecordBatch]):
    """Documents of each batch by block: (block, [(key, numbers, checksum of the block's bytes so far)], distinct pre-tokens so far, whether the block ends)."""
    part, n = TaskContext.get().partitionId(), 0
    numbers, rows, chars, crc = Numbers(), [], 0, 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            crc = zlib.crc32(text.encode(), crc)
            rows.append((key, np.fromiter(map(numbers.__getitem__, pieces(text)), np.uint32), crc))
            chars += len(text)
            if chars >= BLOCK_CHARS or len(numbers) >= BLOCK_WORDS:
                yield part << 32 | n, rows, numbers, True
                numbers, rows, chars, crc, n = Numbers(), [], 0, 0, n + 1
        if rows:
            yield part << 32 | n, rows, numbers, False
            rows = []
    yield part << 32 | n, rows, numbers, True


def _position_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    at = 0
    for block, rows, _, ended in _blocks(batches):
        if rows:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * len(rows), pa.int64()), pa.array([k for k, _, _ in rows], schema.field("key").type),
                    pa.array(range(at, at + len(rows)), pa.int64()), pa.array([pack(ids) for _, ids, _ in rows], pa.binary()),
                    pa.array([crc for _, _, crc in rows], pa.int64()),
                ],
                schema=schema,
            )
        at = 0 if ended else at + len(rows)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, _, numbers, ended in _blocks(batches):
        words = iter(numbers)
        for at in range(0, len(numbers), 20_000) if ended else ():
            some = list(islice(words, 20_000))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.string()), pa.array(np.full(len(some), block)), pa.array(np.arange(at, at + len(some), dtype=np.int32))],
                names=["word", "block", "number"],
            )


def _encoded_rows(batches: Iterator[pa.RecordBatch], ranks_file: str) -> Iterator[pa.RecordBatch]:
    """Encodes each distinct pre-token of a task once; one packed row per block and batch."""
    codec, memo = Codec.of(ranks_file), {}
    for batch in batches:
        blocks, numbers, words = batch.column("block").to_numpy(), batch.column("number").to_numpy(), batch.column("word").to_pylist()
        entries = []
        for word in words:
            entry = memo.get(word)
            if entry is None:
                ids = codec.encode(word)
                entry = memo[word] = (ids, codec.decode(ids))
                if len(memo) > MEMO_WORDS:
                    memo.clear()
            entries.append(entry)
        order = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks[order])) + 1
        out_block, out = [], []
        for members in np.split(order, cuts) if len(order) else ():
            some = [entries[i] for i in members]
            out_block.append(int(blocks[members[0]]))
            out.append(pack(
                numbers[members].astype(np.uint32), np.array([len(e[0]) for e in some], np.uint32),
                np.array([i for e in some for i in e[0]], np.uint32), np.array([len(e[1]) for e in some], np.uint32),
                np.frombuffer(b"".join(e[1] for e in some), np.uint8),
            ))
        yield pa.RecordBatch.from_arrays([pa.array(out_block, pa.int64()), pa.array(out, pa.binary())], names=["block", "packed"])


def _reassemble(docs: pa.Table, words: pa.Table, schema: pa.Schema, keep_ids: bool) -> pa.Table:
    """Ids and bytes of all pre-tokens of the block lie in one array each; a document is gathered from them by its positions."""
    parts = [unpack(b) for b in words.column("packed").to_pylist()]
    number, counts, ids, sizes, raw = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.uint32) for k in range(5))
    del parts
    order = np.argsort(number, kind="stable")
    if len(order) and not np.array_equal(number[order], np.arange(len(order))):
        raise RuntimeError("a block came back with other pre-tokens: its input is not the same when read again")
    (id_at, counts), (raw_at, sizes) = (((np.cumsum(c) - c)[order], c[order]) for c in (counts.astype(np.int64), sizes.astype(np.int64)))
    decimals = _decimals(int(ids.max()) if len(ids) else 0)
    crc, made = 0, []
    keys, places, packed, crcs = (docs.column(c).to_pylist() for c in ("key", "place", "packed", "crc"))
    for i in sorted(range(len(places)), key=places.__getitem__):
        seq = unpack(packed[i])[0]
        if len(seq) and int(seq.max()) >= len(order):
            raise RuntimeError("a block came back with other pre-tokens: its input is not the same when read again")
        own = ids[ranges(id_at[seq], counts[seq])]
        data = raw[ranges(raw_at[seq], sizes[seq])].tobytes()
        crc = zlib.crc32(data, crc)
        if crc != crcs[i]:
            raise RuntimeError("decoded bytes differ from the text: its input is not the same when read again")
        digits = decimals[own].ravel()
        row = [keys[i], len(own), hashlib.sha256(digits[digits != 0].tobytes()[:-1]).hexdigest(), hashlib.sha256(data).hexdigest()]
        made.append(row + ([own.tolist()] if keep_ids else []))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made) if made else [[]] * len(schema), schema)], schema=schema)


def _decimals(most: int) -> np.ndarray:
    """Digits and a comma of every number up to ``most``, zeros behind."""
    return np.array([b"%d," % i for i in range(most + 1)]).view(np.uint8).reshape(most + 1, -1)


def encode_decode(df: DataFrame, key: str = "doc_id", text: str = "text", ranks_file: str = RANKS_FILE, keep_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids]) of every text.

    ``df`` is read twice, for the words and for the positions, so it should be a stored table.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = df.select(F.col(key).alias("key"), text_of(text).alias("text"))
    key_type = df.schema[key].dataType
    position_schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("key", key_type), T.StructField("place", T.LongType()),
        T.StructField("packed", T.BinaryType()), T.StructField("crc", T.LongType()),
    ])
    arrow_positions = to_arrow_schema(position_schema)
    positions = rows.mapInArrow(in_task(lambda b: _position_rows(b, arrow_positions)), position_schema)
    words = rows.mapInArrow(in_task(_word_rows), "word string, block long, number int")
    encoded = words.repartition("word").mapInArrow(lambda b: _encoded_rows(b, ranks_file), "block long, packed binary")

    out = [T.StructField(key, key_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    out_schema = T.StructType(out + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []))
    arrow_out = to_arrow_schema(out_schema)
    return (
        positions.groupBy("block").cogroup(encoded.groupBy("block"))
        .applyInArrow(lambda left, right: _reassemble(left, right, arrow_out, keep_ids), out_schema)
    )
