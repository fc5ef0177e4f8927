"""Leaner ways of the text operators against plain versions of the same step."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plurifit.llm import byte_bpe, jaccard, secrets

ODD = ["", " ", "a", "A b\tc", "\t\n", "ÀB àb x\x1cy", "one two three four five", "one two three four five six", "ab ba ab ba ab ba", "x" * 70_000 + " Y " + "z" * 40_000, "q w e r t " * 9000]


def test_shingle_sets_of_many_texts():
    texts = ODD * 30

    def plain(text):
        words = [bytes(w).lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode())]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = list(jaccard.shingle_sets(pa.array(texts)))
    assert [len(s) for s in sets] == [len(plain(t)) for t in texts]
    assert all(np.array_equal(s, jaccard.shingles(t)) for s, t in zip(sets[: len(ODD)], ODD))
    for i, a in enumerate(ODD):
        for j, b in enumerate(ODD):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain(a) & plain(b))


def test_deviate_of_stretches(spark):
    rng = random.Random(8)
    alphabets = ["0123456789", "0123456789abcdef", "0123456789ABCDEF", secrets.BASE32, secrets.ALPHABET[:62], secrets.ALPHABET, "etaoinshr", "vwxyzAB", "ab"]
    runs = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in secrets.LENGTHS for _ in range(6)] + ["a" * 20, "uv" * 12, "A7" * 16, "vw+/" * 8]
    run = F.col("run")
    frame = spark.createDataFrame([(r,) for r in runs], "run string").select(
        "run", secrets.deviate(run).alias("whole"), secrets.uneven(run).alias("uneven"), secrets.stretch_deviate(run).alias("rest"))
    rows = frame.cache().collect()
    assert all(r["whole"] == max(r["uneven"], r["rest"]) for r in rows)
    found = 0
    for n in secrets.LENGTHS:
        for limit in (5, 20, 40, 60):
            cut = frame.filter(F.length("run") == n).filter(secrets.plainly_uneven(run, F.lit(secrets.most_squares(n, limit)))).collect()
            assert all(r["uneven"] > limit for r in cut)
            found += len(cut)
    assert found


def test_null_runs_of_unwanted_classes_are_not_cut(spark):
    texts = spark.createDataFrame([("d", 0, ["abcdefghij" * 10])], "digest string, place long, parts array<string>")
    plan = secrets.null_runs(texts).filter(F.col("class").isin([20]))._jdf.queryExecution().optimizedPlan().toString()
    assert ".{20}" in plan and ".{24}" not in plan and ".{96}" not in plan


def test_blocks_leave_documents_batch_by_batch(monkeypatch):
    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(byte_bpe, "TaskContext", Task)
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 200)
    texts = ["a b c a", "", "d" * 150 + " a", "e f " * 30, "g a b", "", "h"]
    batches = [pa.RecordBatch.from_pydict({"key": [i], "text": [t]}) for i, t in enumerate(texts)]
    schema = pa.schema([("block", pa.int64()), ("key", pa.int64()), ("place", pa.int64()), ("packed", pa.binary()), ("crc", pa.int64())])
    positions = list(byte_bpe._position_rows(iter(batches), schema))
    assert [p.num_rows for p in positions] == [1] * len(texts)  # nothing waits for the end of its block
    positions = pa.Table.from_batches(positions)
    assert len(set(positions.column("block").to_pylist())) > 1
    words = pa.Table.from_batches(list(byte_bpe._word_rows(iter(batches))))
    encoded = pa.Table.from_batches(list(byte_bpe._encoded_rows(iter(words.to_batches()), byte_bpe.RANKS_FILE)))
    out = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("i", pa.string()), ("d", pa.string()), ("ids", pa.list_(pa.int32()))])
    got = {}
    for block in set(positions.column("block").to_pylist()):
        own = [t.filter(pa.compute.equal(t.column("block"), block)) for t in (positions, encoded)]
        got |= {r["key"]: r for r in byte_bpe._reassemble(*own, out, True).to_pylist()}
        with pytest.raises(RuntimeError):
            byte_bpe._reassemble(own[0].set_column(4, "crc", pa.array([1] * len(own[0]), pa.int64())), own[1], out, True)
    codec = byte_bpe.Codec.of(byte_bpe.RANKS_FILE)
    for i, t in enumerate(texts):
        ids = codec.encoding.encode_ordinary(t)
        assert got[i] == {"key": i, "n": len(ids), "i": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), "d": hashlib.sha256(t.encode()).hexdigest(), "ids": ids}


def test_pipeline_tokenizes_few_texts_at_a_time(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(corpus_pipeline, "materialise", lambda df, name: seen.append((name, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))) or df)
    corpus_pipeline.tokenize(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "")
    assert seen == [("tokenized", "500")]
