"""Hard negatives, packing and the prefix tree against plain versions, on null, empty, repeated and tied rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from plurifit.llm import negatives, packing, prefix_tree

VECTORS = "vec_id long, embedding array<float>, label int, score double, rank int"


def vectors(n=600, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = [float(x) for x in np.round(rng.normal(size=6) / 3, 1)]  # coarse, so many scores tie
        rows.append((i, v, int(rng.integers(0, 4)) if i % 3 else 0, None, None))
    rows += [rows[0], rows[51], (900, None, 1, None, None), (950, [0.1, None] * 3, 1, None, None), (1000, [float("nan")] * 6, 1, None, None), (1050, [0.5] * 6, None, None, None)]
    rows += [(None, [0.5] * 6, 1, None, None), (1100, [], 2, None, None), (1150, [0.5] * 3, 2, None, None), (1200, [-0.1] * 6, 9, None, None)]
    return rows + [(2000 + i, [0.3] * 6, 1, None, None) for i in range(300)]  # copies


def mined(rows):
    """Plain version."""
    known = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        known[i] = label, [int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (6 - len(v))
    out = set()
    for anchor in (i for i in known if i % 50 == 0):
        label, v = known[anchor]
        order = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, (_, w) in known.items() if i != anchor)
        alike = [(-s, i) for s, i in order if known[i][0] == label][:5]
        other = [(-s, i) for s, i in order if known[i][0] != label]
        for p, positive in alike:
            fits = [(s, i) for s, i in other if 50 * p <= 100 * s <= 95 * p][:3]
            out |= {(anchor, positive, k + 1, i, p, s) for k, (s, i) in enumerate(fits)}
    return out


@pytest.mark.parametrize("sizes", [{}, {"BUCKET": 16, "ANCHORS": 3, "ANCHORS_AT_ONCE": 2, "NARROW": 2}])
def test_hard_negatives(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(negatives, name, value)
    got = negatives.hard_negatives(spark.createDataFrame(vectors(), VECTORS)).collect()
    found = {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got}
    assert len(got) == len(found) > 50 and found == mined(vectors())


def test_hard_negatives_of_nothing_and_of_large_components(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(50 * i, [1e6 * (i + 1), 3e30], i % 2, None, None) for i in range(6)]
    assert negatives.hard_negatives(spark.createDataFrame(rows, VECTORS)).count() >= 0


DOCS = "doc_id long, text string, length long, class string"
TEXTS = [None, "", "one", " \n\t ", "İ? <|endoftext|>x <|STARTOFTEXT|> it's ½² Σας 日本語. end", "Word, WORD word; don't!" * 300, "a" * 5000, "tie tie", "tie tie"]


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice(["The", "quick", "brünn,", "fox.", "42"]) for _ in range(rng.randint(1, 900))) for _ in range(150)]
    rows = [(i, t, 7, "clash") for i, t in enumerate(texts)] + [(None, "no key", 7, None)]
    got = packing.pack(spark.createDataFrame(rows, DOCS)).collect()
    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == {r[0] for r in rows}
    for key, text, *_ in rows:
        ids, at = library.encode(text or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(docs[key], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes())
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(sequences) <= sum(r.length for r in got) / 2048 * 1.03 + 1
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_documents_are_packed_apart(spark):
    got = packing.pack(spark.createDataFrame([(1, "same text", 0, "")] * 500, DOCS)).collect()
    assert len(got) == 500 and len({(r.sequence_id, r.offset) for r in got}) == 500


@pytest.mark.parametrize("capacity, demand", [(10, {3: 7, 4: 5, 6: 4, 10: 2}), (64, {w: 1 + w % 5 for w in range(1, 65)}), (8, {}), (8, {8: 3})])
def test_plan_holds_every_piece(capacity, demand):
    counts = np.zeros(capacity + 1, np.int64)
    for w, n in demand.items():
        counts[w] = n
    held = defaultdict(int)
    patterns = packing.plan(counts, capacity)
    for pattern, times in patterns:
        assert sum(w * n for w, n in pattern.items()) <= capacity
        for w, n in pattern.items():
            held[w] += n * times
    assert dict(held) == demand
    need = sum(w * n for w, n in demand.items())
    assert sum(t for _, t in patterns) <= -(-need // capacity) + max(1, need // capacity // 20)


def test_knapsack_against_all_ways():
    rng = random.Random(1)
    price = np.array([-1.0] + [rng.random() for _ in range(12)])
    value, last = packing.knapsack(price, 12)
    best = [0.0] * 13
    for c in range(1, 13):
        best[c] = max(best[c - 1], *(best[c - w] + price[w] for w in range(1, c + 1)))
    assert list(value) == pytest.approx(best)
    assert sum(price[w] for w in packing._taken(value, last, 12)) == pytest.approx(best[12])


TURNS = "conv_id long, turn long, role string, text string, depth long, digest binary"


def turns():
    rng = random.Random(5)
    out = []
    for c in range(120):
        for t in range(rng.randint(1, 7)):
            out.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "no", "", None, "größer"])))
    out += [(200, t, "user", f"long {t}") for t in range(60)] + [(201, None, "user", "first"), (201, 3, "user", "x"), (201, 3, "user", "x"), (203, 1, "u", "base is absent")]
    out += [(300 + i, t, "user", "same") for i in range(40) for t in range(3)] + [(None, 1, "user", "no key")]
    rng.shuffle(out)
    return [(*r, None, None) for r in out]


def tree(rows):
    """Plain version."""
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v, key=lambda r: r[:2])] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = leaves[path] or 1
        saved[path] += (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        if path:
            children[path[:-1]] += 1
            leaves[path[:-1]] += leaves[path]
            saved[path[:-1]] += saved[path]
    return sorted(
        (m[0], len(p), str(members[p[:-1]][0] if p else None), len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    )


@pytest.mark.parametrize("sizes", [{}, {"SHARD": 20, "STRIPE": 3, "QUEUE": 2, "IDS_A_BLOCK": 3}])
def test_prefix_tree(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(prefix_tree, name, value)
    got = prefix_tree.prefix_tree(spark.createDataFrame(turns(), TURNS)).collect()
    assert sorted((r[0], r[1], str(r[2]), *r[3:]) for r in got) == tree(turns())


def test_prefix_tree_of_nothing(spark):
    assert prefix_tree.prefix_tree(spark.createDataFrame([], TURNS)).count() == 0


def test_queue_spills():
    queue = prefix_tree.SpillingQueue(3)
    rng, sent = random.Random(1), []
    for i in range(50):
        sent.append(((rng.randint(0, 9), b"k"), (i, 1, 2)))
        queue.push(sent[-1])
    got = [(a, m) for a in sorted({a for a, _ in sent}) for m in queue.pop_at(a)]
    assert sorted(got) == sorted(sent) and not queue.heap and not queue.runs


def test_packing_takes_patterns_of_all_capacities_at_once():
    rng = np.random.default_rng(5)
    price = np.where(rng.random(41) < 0.5, rng.integers(0, 9, 41) / 8.0, -1.0)
    value, last = packing.knapsack(price, 40)
    found = packing._all_taken(last, np.arange(41))
    for capacity in range(41):
        assert found[capacity].tolist() == np.bincount(packing._taken(value, last, capacity), minlength=41).tolist()


def test_words_with_marks_are_learned_in_joint_calls():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    words = packing.WordIds(public_tokenizers.path(packing.TOKENIZER))
    library, calls = words.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **how):
            calls.extend(texts)
            return library.encode_batch_fast(texts, **how)

    words.tokenizer = Counted()
    texts = ["alpha### beta*** gamma%%% delta&&& epsilon$$$ été.### straße,*** 12### it's### <|a|>### a#b##", "alpha beta gamma#.#"]
    found = [ids.tolist() for ids in words.of(texts)]
    assert found == [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert not any(w in calls for w in ("alpha###", "beta***", "alpha", "beta"))  # no call of their own


def test_packing_looks_distinct_words_up_once():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    looked = []

    class Counted(packing.WordIds):
        def get(self, word, *other):
            looked.append(word)
            return super().get(word, *other)

        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word)

    words = Counted(public_tokenizers.path(packing.TOKENIZER))
    texts = ["alpha beta " * 500, "", " \t", " Beta\x0b alpha\n" * 500]
    library = words.tokenizer
    assert [ids.tolist() for ids in words.of(texts)] == [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert 0 < len(looked) < 20
