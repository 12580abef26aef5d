"""What the methods of op5, op7 and op10 promise, by plain code."""

import math

import numpy as np
import pytest
import zstandard

from chronofold.llm import compression, license_texts, licenses, projections
from chronofold.llm.projections import near_vectors


def brute_links(rows, limit=0.93):
    out = set()
    for a, (i, v, y) in enumerate(rows):
        for j, u, z in rows[:a]:
            if y == z and len(u) == len(v):
                x, w = np.array(v) / np.abs(v).max(), np.array(u) / np.abs(u).max()
                if x @ w / math.sqrt((x @ x) * (w @ w)) >= limit:
                    out.add((j, i))
    return out


def degrees(links):
    n = {}
    for pair in links:
        for x in pair:
            n[x] = n.get(x, 0) + 1
    return n


def test_tables_and_blocks(spark, monkeypatch):
    """Several lines a table, many blocks a cell: the same links at the promised recall, none twice, none below the limit."""
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(150):
        c, y = rng.standard_normal(16), int(rng.integers(0, 2))
        for _ in range(rng.choice([1, 2, 6])):
            rows.append((len(rows), (c + rng.choice([0.0, 0.15, 0.3]) * rng.standard_normal(16)).tolist(), y))
    links = brute_links(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = degrees(links)
    for depth, block in ((0, 30), (2, 1024), (5, 7)):
        monkeypatch.setattr(projections, "depths", lambda limit, depth=depth: (1,) * depth)
        monkeypatch.setattr(projections, "BLOCK", block)
        got = {r.vec_id: r.n_links for r in near_vectors(df).collect()}
        assert all(n <= want.get(i, 0) for i, n in got.items())
        assert sum(got.values()) >= 0.99 * 2 * len(links) > 200


def test_recall_of_a_pair_at_the_limit():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(1)[:, None] * a
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * side / np.linalg.norm(side, axis=1)[:, None]
    lines, w = projections.directions(64), projections.window(0.93)
    count = np.array([projections.collisions(x[None] @ lines, y[None] @ lines, w)[0, 0] for x, y in zip(a, b)])
    assert (count >= projections.threshold()).mean() >= 0.995
    exact = np.abs(a @ lines - b @ lines)
    assert (count >= (exact <= w).sum(1)).all() and (count <= (exact <= w * 1.04).sum(1)).all()
    for k in (1, 4, 9):
        assert (projections.cells(a, k, 0.93) == projections.cells(b, k, 0.93)).any(1).mean() >= 0.995
    steps = projections.depths(0.93)
    assert sorted(steps) == list(steps) and steps[0] > 1000 and len(steps) > 20


def test_numbers_of_any_size(spark):
    """Tiny, huge and denormal numbers, one dimension, equal rows, an empty table."""
    v = [1.0, 2.0, 3.0]
    rows = [(1, [x * 1e-200 for x in v], 1), (2, [x * 1e200 for x in v], 1), (3, v, 1), (4, [-x for x in v], 1), (5, [5e-324, 0.0, 0.0], 1), (6, [1.7e308, 0.0, 0.0], 1), (7, [2.0], 1), (8, [1e-300], 1), (9, [2.0], 1), (10, [1e-200, 2e-200, 3e-200], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (2, 7), 8: (2, 7), 9: (2, 7), 10: (0, 10)}
    assert near_vectors(df.limit(0)).count() == 0


def test_scores_by_plain_code(spark):
    """Sizes, the difference and the fit, each written out."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = compression.training_rows(docs, labels)
    model = compression.fit(rows)

    def size(text, dictionary):
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=compression.LEVEL)
        c = zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
        return sum(len(c.compress(text[i : i + compression.BLOCK])) for i in range(0, len(text), compression.BLOCK))

    def difference(text):
        return (size(text, model.bad) - size(text, model.good)) / len(text) if text else 0.0

    assert len(model.good) == len(model.bad) and any(t in model.good for t, y in rows[::2] if y) and not any(t in model.good + model.bad for t, _ in rows[1::2] if len(t) > 2000)
    held = [(difference(t), y) for t, y in rows[1::2]]
    w0 = w1 = 0.0
    for _ in range(20000):  # gradient ascent of the same ridge likelihood, the difference taken 50-fold
        g0 = g1 = 0.0
        x = np.array([50 * v for v, _ in held])
        err = np.array([y for _, y in held]) - 1 / (1 + np.exp(-(w0 + w1 * x)))
        g0, g1 = err.sum() - 1e-6 * w0, (err * x).sum() - 1e-3 * w1
        w0, w1 = w0 + 4 * g0 / len(held), w1 + 4 * g1 / len(held)
        if abs(g0) + abs(g1) < 1e-9 * len(held):
            break
    odd = [(1, ""), (2, None), (3, "x" * 3 * compression.BLOCK), (4, rows[0][0].decode()), (4, rows[0][0].decode()), (None, "é " * 20000)] + [(r.doc_id, r.text) for r in docs.limit(40).collect()]
    got = compression.score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    plain = sorted((repr(i), 1 / (1 + math.exp(-(w0 + 50 * w1 * difference((t or "").encode()))))) for i, t in odd)
    assert [s for _, s in sorted((repr(r.doc_id), r.score) for r in got)] == pytest.approx([s for _, s in plain], abs=1e-3)
    assert compression.score(docs.limit(0), model).count() == 0


def test_full_license_texts(spark):
    """Whole texts are found in long documents at their place, also with a tenth of the words changed; families do not hide each other."""
    rng = np.random.default_rng(2)
    filler = lambda n: " ".join("w%d" % rng.integers(0, 5000) for _ in range(n))
    rows, want = [], set()
    for i, (name, text) in enumerate(sorted(license_texts.TEXTS.items())):
        words = text.split()
        for k in rng.choice(len(words), len(words) // 60, replace=False):
            words[k] = "changed"
        rows += [(2 * i, filler(700) + " " + text + " " + filler(300)), (2 * i + 1, filler(90) + "\n" + "\n".join(words) + " " + filler(900))]
        want |= {(2 * i, name), (2 * i + 1, name)}
    rows.append((900, filler(3000)))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), license_texts.TEXTS).collect()
    found = {(r.doc_id, r.license) for r in got}
    assert want <= found and all(r.doc_id != 900 and r.containment >= 0.8 for r in got)
    assert all(1 if d % 2 else r.containment == 1.0 for r in got for d in [r.doc_id] if (d, r.license) in want)


def test_templates_from_a_folder(spark, tmp_path):
    (tmp_path / "A").write_text("alpha beta gamma delta epsilon zeta eta theta")
    got = licenses.scan(spark.createDataFrame([(1, "x alpha beta gamma delta epsilon zeta eta theta y")], "doc_id long, text string"), licenses.templates_from(str(tmp_path))).collect()
    assert [(r.doc_id, r.license, r.word_start, r.word_end) for r in got] == [(1, "A", 1, 9)]
