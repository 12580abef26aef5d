"""Equality is decided by bytes or by a hash that repetitive texts do not defeat; texts beyond a chunk; path constants."""

import random

import numpy as np
import pytest
import sentencepiece

from chronofold.llm import common, minhash, pieces, quality
from chronofold.llm.common import CHUNK, distinct_ranges, gram_hashes, range_hashes, same_ranges
from chronofold.llm.minhash import near_duplicates
from chronofold.llm.suffix import remove_repeats
from tests.llm.brute import near, repeats
from tests.llm.test_minhash import copies
from tests.llm.test_scoring import base

DOCS = "doc_id long, text string"


def doubled(n, a="a", b="b"):
    """Two words of n bytes, each built by doubling with its complement: a polynomial hash modulo 2^64 cannot tell them apart."""
    x, y = a, b
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


def ranges(parts):
    end = np.cumsum([len(p) for p in parts])
    return np.frombuffer(b"".join(parts), np.uint8), end - [len(p) for p in parts], end


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_doubling_words(spark, n):
    x, y = doubled(n)
    data, start, end = ranges([x.encode(), y.encode(), x.encode()])
    h = range_hashes(data, start, end)
    assert h[0] == h[2] != h[1]
    texts = [f"{x} {y} {x}", f"{y} {x}"]
    ids, offsets = pieces.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(texts)
    plain = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{plain} {x}"), (2, f"{plain} {y}"), (3, f"{x}\n{y}\n{x}"), (4, " ".join([x, *"abcd", y, *"abcd"])), (5, " ".join([x, *"abcd", x, *"abcd"])), (6, x + y), (7, y + x), (8, "pre " + y)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(df).collect()}
    assert got == {d: base(t) for d, t in rows}
    assert sorted(tuple(r) for r in near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()) == near(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect()} == repeats(rows)


def test_ranges(monkeypatch):
    rng = random.Random(5)
    parts = [bytes(rng.randrange(3) for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 40]))) for _ in range(3000)]
    data, start, end = ranges(parts)
    want = len(set(parts))

    def holds():
        first, back, _ = distinct_ranges(data, start, end)
        assert len(first) == want and all(parts[first[k]] == p for k, p in zip(back, parts))

    assert len(np.unique(range_hashes(data, start, end))) == want
    holds()
    k = np.array([rng.randrange(3000) for _ in range(3000)])
    size = np.minimum(end - start, (end - start)[k])
    assert same_ranges(data, start, start[k], size).tolist() == [parts[i][:n] == parts[j][:n] for i, (j, n) in enumerate(zip(k, size))]
    monkeypatch.setattr(common, "range_hashes", lambda data, s, e, words=None: (e - s).astype(np.uint64))  # bytes still decide
    holds()
    raw = data.tobytes()
    grams = gram_hashes(data, 24)
    assert len(grams) == len(raw) - 23 and len(np.unique(grams)) == len({raw[i : i + 24] for i in range(len(raw) - 23)})


def test_windows_under_one_hash(monkeypatch):
    text = "a b c d e f a b c d e g h a b c d e z y x w v"
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    want = base(text)[4]
    assert quality.base_counts(data, offsets)[4][0] == want == 15
    monkeypatch.setattr(quality, "mix", lambda x: x * np.uint64(0))
    assert quality.base_counts(data, offsets)[4][0] == want


def test_texts_beyond_a_chunk(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    long = " ".join(rng.choice(vocab) + ("\n" if rng.random() < 0.05 else "") for _ in range(190_000))
    assert len(long.encode()) > 2 * CHUNK and len(long.encode()) > pieces.BATCH
    tail = long[-3000:]
    rows = [(2, long), (3, long[:-40] + "other end"), (4, tail), (5, "x" * (CHUNK + 100)), (1, "short text " * 20)]
    df = spark.createDataFrame([(d, t, "en") for d, t in rows], DOCS + ", lang string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(df).collect()}
    assert got == {d: base(t) for d, t in rows}
    assert sorted(tuple(r) for r in near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()) == near(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect()} == repeats(rows)
    ids = {r.doc_id: r.ids for r in pieces.tokenize(df).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert all(ids[d] == sp.encode(t) for d, t in rows)


def test_constants_of_paths_do_not_change_results(spark, monkeypatch):
    """SMALL, PIVOT_ROUNDS and MEMBERS choose how members of a list meet, LONG how a word is relaxed, WIDE where edges are kept."""
    rows = copies(7)
    df = spark.createDataFrame(rows, DOCS)
    got = lambda: sorted([tuple(r) for r in near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()], key=repr)
    want = near(rows)
    for small, rounds, members in ((1000, 2, 256), (1, 0, 3), (1, 1, 7)):
        for name, value in (("SMALL", small), ("PIVOT_ROUNDS", rounds), ("MEMBERS", members)):
            monkeypatch.setattr(minhash, name, value)
        assert got() == want
    rng = random.Random(1)
    texts = ["".join(rng.choice("theinationzé中") for _ in range(rng.randint(1, 90))) for _ in range(300)]
    ids = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(texts)
    for long, wide in ((0, 16), (10_000, 16), (48, 1), (48, 3), (0, 2)):
        monkeypatch.setattr(pieces, "LONG", long)
        monkeypatch.setattr(pieces, "WIDE", wide)
        out, offsets = pieces.encode(texts)
        assert [out[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == ids
