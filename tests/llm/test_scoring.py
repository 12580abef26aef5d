import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.llm import compression, quality
from chronofold.llm.projections import near_vectors, threshold
from tests.llm.brute import WORD, roots, words

D = "/root/testdata/sf0.01"


def base(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            cover |= set(range(i, i + 5))
    lines, dup = set(), 0
    for x in (text or "").split("\n"):
        if WORD.search(x.encode()):
            dup += x in lines
            lines.add(x)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover)


def shares(texts):
    c = Counter(x for t in texts for x in words(t))
    n = sum(c.values())
    return {w: k for w, k in c.items() if k >= n / 500}, n


def js(p, q):
    p, q = np.array(p, float) / max(1, sum(p)), np.array(q, float) / sum(q)
    m = (p + q) / 2
    return (sum(0.5 * x * np.log2(x / y) for a in (p, q) for x, y in zip(a, m) if x > 0)) ** 0.5


def test_quality_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").where("doc_id < 400")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()] + [(9001, None, "en"), (9002, "", None), (9003, "a b\na b\n\n a b", "xx"), (9004, "é\tü " * 300, "en")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    big = {x for x in {r[2] for r in rows if r[2]} if sum(len(words(t)) for _, t, y in rows if y == x) >= quality.REFERENCE_WORDS}
    for lang in big | {None}:
        texts = [t for _, t, x in rows if lang is None or x == lang]
        common, n = shares(texts)
        best = sorted(common.items(), key=lambda x: -x[1])[: quality.TOP]
        assert len(common) <= quality.TOP
        ref = [k for _, k in best] + [n - sum(k for _, k in best)]
        classes = np.bincount(np.concatenate([quality.CLASSES[np.frombuffer((t or "").encode(), np.uint8)] for t in texts]), minlength=8)
        for i, t, x in rows:
            if (x if x in big else None) == lang:
                own = Counter(words(t))
                hist = [own[w] for w, _ in best]
                hist.append(sum(own.values()) - sum(hist))
                r = got[i]
                b = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                assert b == base(t), i
                assert r.word_distance == pytest.approx(js(hist, ref), abs=1e-9)
                mine = np.bincount(quality.CLASSES[np.frombuffer((t or "").encode(), np.uint8)], minlength=8)
                assert r.class_distance == pytest.approx(js(mine, classes), abs=1e-9)
                failed = b[0] < 10 or 100 * b[4] > 20 * b[0]
                apart = (r.class_distance > quality.CLASS_LIMIT and len((t or "").encode()) >= quality.CLASS_GUARD) or (r.word_distance > quality.WORD_LIMIT and b[0] >= quality.WORD_GUARD)
                assert r.base_failed == failed and r.kept == (not failed and not apart)


def test_quality_sorts_labels(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    r = quality.judge(docs).join(spark.read.parquet(f"{D}/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {x.quality: x.kept for x in r}
    assert kept[1] > 0.99 and kept[0] < 0.5
    empty = quality.judge(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0


def test_quality_of_languages_without_a_reference(spark):
    """Clean texts in another script are kept at every size of their language, and those without a language."""
    rng = random.Random(2)
    letters = {"ru": "абвгдежзиклмнопрстуфхцчшщыьэюя", "zh": "的一是不了人我在有他这中大来上国个到说们", "el": "αβγδεζηθικλμνξοπρστυφχψω"}
    prose = lambda x, n: " ".join("".join(rng.choice(letters[x]) for _ in range(rng.randint(1, 9))) for _ in range(n))
    made = [(10000 + 100 * k + i, prose(x, 300), lang) for k, (x, lang) in enumerate([("ru", "ru"), ("zh", "zh"), ("el", None), ("el", "")]) for i in range(3)]
    made += [(20000 + i, prose("ru", 300), "bg") for i in range(40)]  # over REFERENCE_WORDS
    made += [(40000 + i, prose("ru", 20) + " &&& %%% ### $$$ *** ||| <<< >>>" * 40, "bg" if i else "ru") for i in range(2)]  # junk
    made += [(30000, "слово " * 100, "ru"), (30001, "слово", "zh")]
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang")
    got = {r.doc_id: r for r in quality.judge(docs.unionByName(spark.createDataFrame(made, docs.schema))).collect()}
    assert max(got[d].class_distance for d, *_ in made[:12]) > quality.CLASS_LIMIT
    assert [d for d, *_ in made if not got[d].kept] == [40000, 40001, 30000, 30001]
    assert sum(not r.kept and not r.base_failed for r in got.values()) > 30  # those of the large languages are judged
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spanish = {r.doc_id: r for r in quality.judge(small).join(small.where("lang = 'es'").select("doc_id"), "doc_id").collect()}
    assert sum(r.n_words for r in spanish.values()) < quality.REFERENCE_WORDS
    assert {d for d, r in spanish.items() if not r.kept and not r.base_failed} == {14, 17, 47, 48}  # words strewn with symbols


def test_quality_counts_languages_in_passes(spark, monkeypatch):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = lambda: sorted((r.doc_id, r.kept, round(r.class_distance, 9), round(r.word_distance, 9)) for r in quality.judge(docs).collect())
    want = rows()
    for n in (1, 3):
        monkeypatch.setattr(quality, "LANGUAGES", n)
        assert rows() == want


def auc(pairs):
    pairs = sorted(pairs)
    pos = [i for i, (_, y) in enumerate(pairs, 1) if y]
    return (sum(pos) - len(pos) * (len(pos) + 1) / 2) / (len(pos) * (len(pairs) - len(pos)))


def test_compression_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = compression.fit(compression.training_rows(docs, labels))
    out = compression.score(docs, model)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert auc([(r.score, r.quality) for r in rows]) > 0.93
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93
    assert all(r.held_out == compression.held_out(r.doc_id) for r in rows)
    odd = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "é" * 100000, "z")], "doc_id long, text string, score string")
    got = compression.score(odd, model).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got) and compression.score(odd.limit(0), model).count() == 0
    assert compression.fit([]) and compression.fit([(b"a", 1), (b"b", 0)])


def vectors(rng, n, dim=24):
    out = []
    while len(out) < n:
        c = rng.standard_normal(dim)
        for _ in range(rng.choice([1, 1, 2, 5, 40])):
            out.append((c + rng.choice([0, 0.1, 0.2, 0.27]) * rng.standard_normal(dim)).tolist())
    return out[:n]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v, int(rng.integers(0, 3))) for i, v in enumerate(vectors(rng, 700))]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(0, 60, 3)] + [(2000 + i, rows[0][1], rows[0][2]) for i in range(50)]
    rows += [(3000, None, 1), (3001, [0.0] * 24, 1), (3002, [float("nan")] * 24, 1), (3003, rows[0][1], None), (3004, [None] * 24, 1), (3005, [1.0, 2.0], 1), (3006, [2.0, 4.0], 1), (3007, [], 1), (3008, [float("inf")] + [1.0] * 23, 1)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, w int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    links, true = [], 0
    fine = [i for i, (_, v, y) in enumerate(rows) if y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for a in fine:
        for b in fine:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links.append((a, b))
    true = 2 * len(links)
    found = sum(v[0] for v in got.values())
    assert 0.99 * true <= found <= true
    root = roots(len(rows), links)
    low = {}
    for i, r in enumerate(root):
        low[r] = min(low.get(r, 1 << 60), rows[i][0])
    same = sum(got[rows[i][0]][1] == low[root[i]] for i in range(len(rows)))
    assert same >= 0.995 * len(rows)
    assert got[3000] == (0, 3000, True) and got[3005] == (1, 3005, True) and got[3006] == (1, 3005, False)
    assert near_vectors(df.limit(0)).count() == 0 and 15 <= threshold() <= 20
