import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.llm import chat, licenses, mixing, sharding
from tests.llm.brute import words

D = "/root/testdata/sf0.01"


def check_shards(rows, texts):
    n = len(rows)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(s, [])) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_sharding(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = sharding.shard(docs).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()])
    linked = [r for r in rows if r.group_rows > 1]
    assert linked and sum(r.group_cut == 0 for r in linked) >= 0.9 * len(linked)


def test_sharding_edges(spark):
    rng = random.Random(1)
    texts = [(i, "hot") for i in range(400)] + [(1000 + i, f"t{rng.randint(0, 300)}") for i in range(500)] + [(5, None), (None, None), (6, ""), (6, ""), (None, "x")]
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in texts], "doc_id long, text string, shard int, g string")
    rows = sharding.shard(df).collect()
    check_shards(rows, texts)
    hot = Counter(r.shard for r in rows if r.text_crc32 == zlib.crc32(b"hot"))
    assert len(hot) <= 24  # 400 rows need 18 shards of 22 or 23
    assert sharding.shard(df.limit(0)).count() == 0 and sharding.shard(df.limit(1)).count() == 1


def test_sharding_goes_on_until_no_move_is_accepted(spark):
    rng = random.Random(6)
    rows, quota = [], sharding.quotas(6000, 8)
    while len(rows) < 6000:
        g = len(rows)
        rows += [(g + i, g) for i in range(min(rng.randint(2, 150), 6000 - g))]
    scratch = sharding.Scratch(spark)
    cells = scratch.cut(sharding._cells(spark.createDataFrame(rows, "doc_id long, g long"), quota))

    def cut(rounds):
        by = defaultdict(list)
        for r in sharding.propagate(cells.select("*"), quota, sharding.Scratch(spark), rounds).collect():
            by[r.g].append(r.n)
        assert sum(map(sum, by.values())) == len(rows)
        return sum(sum(v) - max(v) for v in by.values())

    assert cut(sharding.ROUNDS) == cut(sharding.ROUNDS + 5) < cut(3)


def test_mixing(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    tokens = {r.doc_id: (r.source, max(1, len(words(r.text)))) for r in docs.collect()}
    rows = mixing.mix(docs).collect()
    assert {r.doc_id for r in rows} == set(tokens)
    total = Counter()
    for s, n in tokens.values():
        total[s] += n
    p = {s: n / sum(total.values()) for s, n in total.items()}
    a = rows[0].exponent
    z = sum(x**a for x in p.values())
    w = {s: x**a / z for s, x in p.items()}
    entropy = -sum(x * math.log(x) for x in w.values()) / math.log(len(w))
    spread = max(w[s] / p[s] for s in p) / min(w[s] / p[s] for s in p)
    # the exponent is the largest that is flat enough, unless the repetition limit binds
    assert 0 < a < 1 and (entropy == pytest.approx(mixing.ENTROPY, abs=1e-4) and spread <= mixing.REPEAT + 1e-6 or spread == pytest.approx(mixing.REPEAT, rel=1e-3))
    least = min(w[s] / p[s] for s in p)
    out = defaultdict(list)
    for r in rows:
        assert (r.source, r.n_tokens) == tokens[r.doc_id] and r.weight == pytest.approx(w[r.source], rel=1e-6)
        out[r.source].append((r.token_offset, r.n_tokens, r.epoch, r.doc_id))
    for s, v in out.items():
        v.sort()
        budget = w[s] / p[s] / least * total[s]
        at = 0
        for offset, n, epoch, _ in v:
            assert offset == at and epoch == offset // total[s]
            at += n
        assert budget - 1 <= at < budget + max(n for _, n, _, _ in v) + 1
        assert len({d for _, _, e, d in v if e == 0}) == sum(x == s for x, _ in tokens.values())


def test_mixing_limits_and_edges(spark):
    sources = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long")
    assert mixing.exponent(sources, 0.5, 100.0) == pytest.approx(_brute(sources, 0.5, 100.0), abs=1e-3)
    assert mixing.exponent(sources, 0.999, 3.0) == pytest.approx(1 - math.log(3) / math.log(90), abs=1e-4)
    assert mixing.exponent(sources, 0.0, 9.0) == 1.0
    df = spark.createDataFrame([(1, None, None, 2), (1, None, None, 2), (None, "", "s", 3), (2, "a b", "t", 4)], "doc_id long, text string, source string, epoch int")
    rows = mixing.mix(df).collect()
    assert Counter((r.doc_id, r.source) for r in rows if r.epoch == 0) == {(1, ""): 2, (None, "s"): 1, (2, "t"): 1}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df).count() >= 4


def _brute(sources, entropy, repeat):
    t = [r.tokens for r in sources.collect()]
    p = [x / sum(t) for x in t]
    best = 0.0
    for i in range(20001):
        a = i / 20000
        w = [x**a for x in p]
        w = [x / sum(w) for x in w]
        if -sum(x * math.log(x) for x in w) >= entropy * math.log(len(w)):
            best = a
    return max(best, 1 - math.log(repeat) / math.log(max(p) / min(p)))


def test_licenses(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = docs.collect()
    sure = {"Released under the MIT License.": "MIT-statement", "Licensed under the Apache License, Version 2.0.": "Apache-2.0-statement", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-statement", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0-statement"}
    want = {(r.doc_id, n) for r in rows for t, n in sure.items() if t in r.text}
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    assert len(want) > 20 and want <= got
    assert {d for d, _ in got} <= {r.doc_id for r in rows if "icense" in r.text}
    import re

    rng = random.Random(3)
    made = []
    for i in range(80):
        t = licenses.TEMPLATES[rng.choice(sorted(licenses.TEMPLATES))].split()
        if rng.random() < 0.5 and len(t) > 20:
            t[rng.randrange(len(t))] = "changed"
        filler = [f"f{rng.randint(0, 99)}" for _ in range(rng.randint(0, 300))]
        k = rng.randint(0, len(filler))
        made.append((i, " ".join(filler[:k] + t + filler[k:])))
    tokens = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", t.lower().encode())
    grams = lambda t: [tuple(tokens(t)[i : i + 5]) for i in range(max(1, len(tokens(t)) - 4))]
    found = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    for i, t in made:
        own = set(grams(t))
        for n, x in licenses.TEMPLATES.items():
            assert ((i, n) in found) == (len(own & set(grams(x))) >= 0.8 * len(set(grams(x)))), (i, n)
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "Released under the MIT License.", 0), (3, "x " * 50000 + "released UNDER the mit license", 0)], "doc_id long, text string, license int")
    assert {(r.doc_id, r.license) for r in licenses.scan(odd).collect()} == {(None, "MIT-statement"), (3, "MIT-statement")} and licenses.scan(odd.limit(0)).count() == 0


def test_licenses_under_five_words(spark):
    from chronofold.llm.queries import QUERIES

    tokens = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode())

    def places(t, line):
        w, x = tokens(t), tokens(line)
        return {(i, i + len(x)) for i in range(len(w) - len(x) + 1) if w[i : i + len(x)] == x}

    rows = spark.read.parquet(f"{D}/documents.parquet").collect()
    want = {(r.doc_id, *p) for r in rows for p in places(r.text, "All rights reserved.")}
    got = [r for r in QUERIES["op5_license_scan"](spark, D).collect()]
    assert want and {(r.doc_id, r.word_start, r.word_end) for r in got if r.license == "all-rights-reserved-line"} == want
    assert {"MIT-statement", "Apache-2.0-statement"} <= {r.license for r in got}
    made = [(1, "All rights reserved."), (2, "f " * 3000 + "ALL Rights\nreserved by x " + "f " * 500 + "all rights reserved"), (3, "all rights are reserved"), (4, "rights reserved"), (5, "MIT"), (6, "a b unlicensed c"), (7, None), (8, "")]
    lines = {"three": "All rights reserved.", "one": "Unlicensed"}
    out = licenses.scan(spark.createDataFrame(made, "doc_id long, text string"), lines).collect()
    assert Counter((r.doc_id, r.license, r.word_start, r.word_end) for r in out) == Counter((d, n, *p) for d, t in made for n, x in lines.items() for p in places(t, x))


def brute_pair(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    show = lambda ts: "".join(f"<|{r}|>\n{t}\n" for r, t in ts)

    def spans(ts):
        out, at = [], 0
        for r, t in ts:
            at += len(r) + 5
            if r == "assistant":
                out.append((at, at + len(t)))
            at += len(t) + 1
        return out

    return n, show(a[:n]), show(a[n:]), show(b[n:]), spans(a[n:]), spans(b[n:])


def test_preferences(spark):
    turns = spark.read.parquet(f"{D}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()]
    extra = [(c + 5000, t, r, x if t < 2 else x + "é!") for c, t, r, x in rows if c % 3 == 0] + [(c + 9000, t, r, x) for c, t, r, x in rows if c % 5 == 0] + [(7777, None, None, None), (7777, 1, "assistant", ""), (None, 0, "user", "q")]
    rows += extra
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, prompt string")
    got = {r.conv_id: r for r in chat.preferences(df).collect()}
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    best = {}
    for c in sorted(convs, key=lambda c: (c is None, c)):
        best.setdefault(convs[c][0], c)
    assert set(got) == set(convs)
    for c, v in convs.items():
        r, first = got[c], best[v[0]]
        assert r.chosen_id == first
        if c == first:
            assert r.status == "first" and r.prompt is None
        else:
            n, prompt, a, b, sa, sb = brute_pair(convs[first], v)
            assert (r.n_prompt_turns, r.prompt, r.chosen_text, r.rejected_text) == (n, prompt, a, b)
            assert [tuple(x) for x in r.chosen_spans] == sa and [tuple(x) for x in r.rejected_spans] == sb
            assert r.status == ("same" if v == convs[first] else "pair")
    assert chat.preferences(df.limit(0)).count() == 0
    assert np.isscalar(len(got))
