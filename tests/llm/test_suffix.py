import random

import numpy as np
import pytest

from chronofold.llm import suffix
from chronofold.llm.suffix import kasai, remove_repeats, room_of, sliding_min, suffix_array
from tests.llm.brute import repeats


def run(spark, rows):
    df = spark.createDataFrame([(d, t, b"x") for d, t in rows], "doc_id long, text string, spans binary")
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect()}


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(k) for k in (16, 30, 80)]
    rows = []
    for i in range(n):
        t = text(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            x = rng.choice(passages)
            a = rng.randrange(len(x) // 2)
            k = rng.randint(0, len(t))
            t = t[:k] + x[a : a + rng.randint(60, len(x))] + t[k:]
        rows.append((i * 3, t))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 20, 4)] + [(2000, "ab" * 400), (2001, "x" * 350), (2002, passages[0] * 3)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == repeats(rows)


def test_split_anchor(monkeypatch):
    """Shards of an anchor that is too large are merged by binary search to the same marks."""
    rng = random.Random(9)
    core = bytes(rng.randrange(97, 122) for _ in range(90))
    texts = [bytes(rng.randrange(97, 99) for _ in range(rng.randint(5, 30))) + core + bytes(rng.randrange(97, 99) for _ in range(rng.randint(5, 30))) for _ in range(300)]
    texts = [t for t in texts if len(t) >= suffix.SIZE]
    doc, start = np.arange(len(texts)), np.zeros(len(texts), np.int32)
    want = [x.tolist() for x in suffix._compared(doc, start, texts)]
    monkeypatch.setattr(suffix, "SHARD", 2000)
    assert [x.tolist() for x in suffix._compared(doc, start, texts)] == want and len(want[0]) > 10


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a" * 99), (4, "a" * 99), (5, "b" * 100), (6, "b" * 100), (7, "\0" * 130), (8, "é" * 60), (9, "x" + "é" * 60)]
    assert run(spark, rows) == repeats(rows)
    assert run(spark, []) == {}
    twice = run(spark, [(1, "q" * 150), (1, "q" * 150), (None, "q" * 150)])
    assert twice[1][:3] == (150, 149, 1) and twice[None][:3] == (150, 150, 1)


def test_parts():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 500).astype(np.uint8)
    raw = data.tobytes()
    runs = np.array([1, 120, 3, 200, 176])
    room = room_of(runs)
    end = np.arange(500) + room
    order, rank = suffix_array(data, room)
    full = lambda i: (raw[i : end[i]], i)
    assert [full(i) for i in order] == sorted(full(i) for i in range(500)) and rank[order].tolist() == list(range(500))
    before = np.full(500, -1)
    before[order[1:]] = order[:-1]
    got = kasai(data, room, before, np.cumsum(runs) - runs, runs, 500)
    capped = kasai(data, room, before, np.cumsum(runs) - runs, runs, 9)
    assert capped.tolist() == np.minimum(got, 9).tolist()
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(raw[a : end[a]], raw[b : end[b]])) if x != y), min(room[a], room[b]))
    assert all(got[i] == (0 if before[i] < 0 else common(i, before[i])) for i in range(500))
    x = rng.integers(0, 99, 200)
    assert sliding_min(x, 77).tolist() == [x[i : i + 77].min() for i in range(124)]


@pytest.mark.parametrize("hot", [2, 30])
def test_hot_anchors(spark, monkeypatch, hot):
    """Windows of anchors with many places travel one by one: the same spans, also where batches cut their groups."""
    rows = corpus(5, 90)
    passage = "".join(random.Random(8).choice("abcdefgh ") for _ in range(260))
    rows += [(5000 + i, f"{i} head {i * 7} " + passage + f" tail {i}") for i in range(70)] + [(None, passage), (5000, "0 head 0 " + passage + " tail 0")]
    monkeypatch.setattr(suffix, "HOT", hot)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = run(spark, rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = repeats([(10**9 if d is None else d, t) for d, t in rows[:-1]])
    assert {10**9 if d is None else d: x for d, x in got.items()} == want
