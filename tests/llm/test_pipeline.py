import random
from collections import Counter

import corpus_pipeline as cp
from chronofold.llm import quality
from tests.llm.brute import near, repeats, shingles

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    s1 = cp.quality_rules(spark, docs, D)
    assert s1.columns == docs.columns and {r.doc_id: r for r in s1.collect()} == {d: rows[d] for d in kept}
    s2 = cp.near_dedup(spark, s1, D)
    want = {d for d, _, c, _ in near([(d, rows[d].text) for d in kept]) if d == c}
    assert {r.doc_id for r in s2.collect()} == want and s2.columns == docs.columns
    s3 = cp.suffix_dedup(spark, s2, D).collect()
    gone = repeats([(d, rows[d].text) for d in want])
    assert {r.doc_id for r in s3} == want
    for r in s3:
        n, removed, _, _ = gone[r.doc_id]
        assert (r.text == rows[r.doc_id].text) == (removed == 0) and n - removed - 8 <= len(r.text.encode()) <= n - removed
    s4 = cp.mix_sources(spark, spark.createDataFrame(s3), D).collect()
    assert set(Counter(r.doc_id for r in s4)) == want and max(Counter(r.doc_id for r in s4).values()) <= 3
    out = cp.run(spark, D).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in s4) and all(r.round_trip for r in out)


def test_near_dedup_of_repeated_ids(spark):
    """Two texts under one id, repeated rows, a null id, null and empty texts."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, a), (2, b), (3, a), (3, c), (4, b), (None, b), (None, c), (5, None), (6, ""), (6, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in cp.near_dedup(spark, docs, D).collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (3, c), (5, None), (6, "")], key=repr)
    assert cp.near_dedup(spark, docs.where("false"), D).count() == 0


def test_near_dedup_takes_pairs_from_80_percent(spark):
    """Pairs planted between 0.80 and 0.85, some above and some below, among the given texts."""
    rng = random.Random(8)
    texts, between = [], 0
    for i in range(160):
        w = [f"v{rng.randint(0, 5000)}" for _ in range(120)]
        x = list(w)
        for at in rng.sample(range(4, 116), 3 + i % 2)[:2] if i % 8 else range(10, 110, 25):
            x[at] = "changed"
        for at in range(2 + i % 3):
            x[at] = "edge"
        a, b = shingles(" ".join(w)), shingles(" ".join(x))
        between += 80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b)
        texts += [" ".join(w), " ".join(x)]
    assert between > 40
    rows = list(enumerate(texts)) + [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = {d for d, _, _, kept in near(rows, 80) if kept}
    assert want < {d for d, _, _, kept in near(rows) if kept}
    assert {r.doc_id for r in cp.near_dedup(spark, docs, D).collect()} == want


def test_stages_after_near_copies_from_80_percent(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    s1 = cp.quality_rules(spark, docs, D)
    want = {d for d, _, _, kept in near([(r.doc_id, r.text) for r in s1.collect()], 80) if kept}
    s2 = cp.near_dedup(spark, s1, D)
    assert {r.doc_id for r in s2.collect()} == want and s2.columns == docs.columns
    s3 = cp.suffix_dedup(spark, s2, D).collect()
    gone = repeats([(d, rows[d].text) for d in want])
    assert {r.doc_id for r in s3} == want
    for r in s3:
        n, removed, _, _ = gone[r.doc_id]
        assert (r.text == rows[r.doc_id].text) == (removed == 0) and n - removed - 8 <= len(r.text.encode()) <= n - removed
    s4 = cp.mix_sources(spark, spark.createDataFrame(s3), D).collect()
    out = cp.run(spark, D).collect()
    assert set(Counter(r.doc_id for r in s4)) == want and Counter(r.doc_id for r in out) == Counter(r.doc_id for r in s4)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, kept string, near_id long, spans binary, id int, mix string"


def odd(spark, rows):
    """Documents with columns whose names the stages use themselves."""
    return spark.createDataFrame([(d, t, lang, src, None if t is None else len(t), 7, "no", 1, b"x", 3, "m") for d, t, lang, src in rows], SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_suffix_stage_keeps_every_text(spark):
    """Two texts under one id, repeated rows, null ids, a null and an empty text."""
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, a), (5, a + " tail one"), (5, b), (None, c + " " + a), (None, b + " end"), (7, None), (8, ""), (9, c), (9, c), (2, "short")]
    docs = odd(spark, [(d, t, "en", None) for d, t in rows])
    out = cp.suffix_dedup(spark, docs, D)
    got = Counter((r.doc_id, r.text, r.n_chars) for r in out.collect())
    want = Counter({(1, a): 1, (5, " tail one"): 1, (5, b): 1, (None, " "): 1, (None, " end"): 1, (7, None): 1, (8, ""): 1, (9, c): 2, (2, "short"): 1})
    assert out.columns == cp.COLUMNS and got == Counter({(d, t, None if t is None else len(t)): n for (d, t), n in want.items()})
    assert cp.suffix_dedup(spark, docs.limit(0), D).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, ties, clashing names, a text beyond a chunk, and empty tables, through every stage."""
    long = prose(9, 120_000)
    rows = [(None, prose(4, 40), None, None), (3, prose(5, 40), "en", "s"), (3, prose(6, 40), "en", "s"), (3, prose(6, 40), "en", "s"), (4, prose(6, 40), "xx", None), (5, None, None, "s"), (6, "", "en", "t"), (7, long, "en", "t")]
    docs = odd(spark, rows)
    now, left = docs, {}
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), D).count() == 0
        if name != "sentencepiece":
            now = stage(spark, now, D)
            assert now.columns == cp.COLUMNS
            left[name] = Counter((r.doc_id, r.text) for r in now.collect())
    assert left["quality_rules"] == Counter((d, t) for d, t, *_ in rows if t)
    want = Counter((d, t) for d, t, *_ in rows[:3] + rows[7:])
    assert left["minhash_near_dedup"] == left["suffix_array_dedup"] == want and set(left["mixing"]) == set(want)
    for folder, table in (("odd", docs), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{folder}/documents.parquet")
    out = cp.run(spark, f"{tmp_path}/odd").collect()
    assert Counter(r.doc_id for r in out) == Counter(d for (d, _), n in left["mixing"].items() for _ in range(n)) and all(r.round_trip for r in out)
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
