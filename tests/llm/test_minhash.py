import random

from chronofold.llm.minhash import near_duplicates
from tests.llm.brute import near

VOCAB = [f"w{i}" for i in range(300)]


def copies(seed=1):
    rng = random.Random(seed)
    rows, n = [], 0
    passage = [rng.choice(VOCAB) for _ in range(60)]
    for g in range(12):
        base = [rng.choice(VOCAB) for _ in range(rng.randint(20, 150))] + (passage if g % 2 else [])
        for k in range(rng.choice([1, 2, 3, 25])):
            w = list(base)
            for _ in range(k % 5):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            rows.append((n, (" " if k % 2 else "\n").join(w).upper() if k % 3 == 0 else " ".join(w)))
            n += 1
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, cid string")
    got = sorted((tuple(r) for r in near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    assert got == near(rows)


def test_against_brute_force(spark):
    check(spark, copies())


def test_large_group_and_chain(spark):
    """One group of 120 near copies with growing drift: members far apart link only through others."""
    rng = random.Random(4)
    w = [rng.choice(VOCAB) + str(i) for i in range(200)]
    rows = []
    for i in range(120):
        if i % 3 == 0:
            w = list(w)
            w[rng.randrange(200)] = f"z{i}"
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    check(spark, rows)


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one two"), (9, "ONE  two"), (10, "one two three"), (4, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (11, "é " * 400), (11, "é " * 400), (None, "n u l l i d"), (None, "n u l l i d")]
    check(spark, rows)
    check(spark, [])
