import random

import numpy as np
import sentencepiece

from chronofold.llm import pieces


def reference(texts):
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(texts)


def split(ids, offsets):
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


HARD = ["Hello  world\n x", " a", "", "é\tü  ", "▁a b", "ｆｕｌｌ", "<s>hi</s>", "​z", " ", "    ", "a" * 500, "中文没有空格的文本梦" * 30, "x" + " " * 40 + "y", "\n\n\t", "🙂👍🏽 ok", "the the the", "internationalization" * 10, "a▁▁b"]


def test_same_ids_as_the_library():
    rng = random.Random(2)
    words = ["the", "naïve", "Haus", "running", "über", "ción", "aaaa", "\n", "  ", "...", "123", "Wörter", "don't", "日本", "x"]
    texts = HARD + [" ".join(rng.choice(words) + rng.choice(["", rng.choice(words)]) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    ids, offsets = pieces.encode(texts)
    got = split(ids, offsets)
    want = reference(texts)
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []
    assert pieces.decode(ids, offsets) == [t.replace("▁", " ").encode() for t in texts]
    assert pieces.encode([]) [0].tolist() == [] and pieces.decode(np.array([0, 1, 2]), np.array([0, 3])) == [b""]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.ids, r.n_ids, r.round_trip) for r in pieces.tokenize(docs).collect()}
    rows = docs.collect()
    want = reference([r.text for r in rows])
    assert len(got) == len(rows) and all(got[r.doc_id] == (w, len(w), True) for r, w in zip(rows, want))
    back = {r.doc_id: r.text for r in pieces.untokenize(pieces.tokenize(docs.limit(20))).collect()}
    assert all(back[r.doc_id] == r.text for r in docs.limit(20).collect())


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 3), (None, "", 3), (2, "b", 3), (2, "b", 3)], "doc_id long, text string, ids int")
    rows = pieces.tokenize(df).collect()
    assert sorted(r.n_ids for r in rows) == [0, 0, 1, 1] and all(r.round_trip for r in rows)
    assert pieces.tokenize(df.limit(0)).count() == 0
