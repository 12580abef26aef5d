"""Near-duplicate vectors by collision counting over many sorted one-dimensional projections.

Vectors of one label (and one dimension) are projected on random directions. Two unit vectors at the cosine limit are
apart by a normal deviate of width w = sqrt(2 - 2 * limit) on each, two unrelated ones by sqrt(2).

* Candidates. A table sorts the classes (equal vectors of a label are one) into cells along ``k`` lines at once, each cut into
  steps of ``STEP`` widths. A pair at the limit shares a cell of a table with probability p^k, an unrelated one with q^k; there are
  as many tables as give ``RECALL`` for a pair at the limit. k grows with the logarithm of the label's classes, chosen
  for least work: comparisons of a class grow with the power log p / log q = 0.22 of them, and not in proportion. A small label
  has k = 0: one table with one cell.
* Counting. Members of a cell meet in blocks of about ``BLOCK``. On each of ``LINES`` further lines a pair collides if one
  lies in the window of half-width w centred on the other. The count that a true pair reaches with probability RECALL
  follows from the binomial law; pairs that pass it are verified by the exact cosine. A pair that shares cells of several
  tables counts in the first.

A block pair gives each class its number of links and a spanning forest of the links, never the links themselves: dense
groups stay linear in rows. Comparisons within a dense group grow with the square of its distinct vectors: links are counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import Scratch, U, components, mix, random_words

LINES, RECALL, BLOCK, STEP = 40, 0.9995, 1024, 6.0
#: Work of a posting in comparisons of a pair, as measured: it carries the vector.
POSTING = 300
DEPTH = 48  # lines of a table at most: those of 10^13 classes of a label
TILE = 128  # queries that are counted at once: their counts fit a core's cache
UNITS = 64  # steps of a window's half-width on the integer lines that are counted
SENT = 1 << 24  # bytes of vectors that are posted together
FOUND = "node long, n long, to long"


def directions(dim: int, lines: int = LINES, seed: int = 20240) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, lines))


def window(limit: float) -> float:
    return math.sqrt(2 - 2 * limit)


def threshold(lines: int = LINES, recall: float = RECALL) -> int:
    """Least count that a pair at the limit reaches with probability ``recall``: one width, so p = P(|N| <= 1)."""
    p = math.erf(1 / math.sqrt(2))
    below = 0.0
    for k in range(lines + 1):
        below += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if below > 1 - recall:
            return k
    return lines


def same_step(width: float, step: float) -> float:
    """Probability that values apart by a normal deviate of a width fall into one step of randomly placed ones."""
    x = step / width
    return math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2))


def tables(k: int, limit: float) -> int:
    """Tables of k lines that a pair at the limit shares a cell in with probability RECALL."""
    each = same_step(window(limit), STEP * window(limit)) ** k
    return 1 if k == 0 else math.ceil(math.log(1 - RECALL) / math.log(1 - each))


@lru_cache(8)
def depths(limit: float) -> tuple[int, ...]:
    """From how many classes of a label on one more line a table is less work: by the k-th entry, k + 1."""
    q = same_step(math.sqrt(2), STEP * window(limit))
    work = lambda n, k: tables(k, limit) * (n * q**k + POSTING)
    out, k = [], 0
    n = 1.0
    while n < 1e14 and k < DEPTH:
        n *= 1.05
        best = min(range(k, DEPTH + 1), key=lambda j: work(n, j))
        out += [int(n)] * (best - k)
        k = best
    return tuple(out)


@lru_cache(64)
def _grid(dim: int, k: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    n = tables(k, limit)
    return directions(dim, n * k, 31 + k), np.random.default_rng([77, dim, k]).random(n * k)


def cells(unit: np.ndarray, k: int, limit: float) -> np.ndarray:
    """Cell of each unit vector in every table, as a hash."""
    n = tables(k, limit)
    out = np.zeros((len(unit), n), U)
    if k:
        lines, shift = _grid(unit.shape[1], k, limit)
        step = np.floor(unit @ lines / (STEP * window(limit)) + shift).astype(np.int64).view(U).reshape(len(unit), n, k)
        for j in range(k):
            out = mix(out + step[:, :, j] * U(0x9E3779B97F4A7C15))
    return mix(out + random_words(41, n))


def collisions(queries: np.ndarray, base: np.ndarray, width: float) -> np.ndarray:
    """Per query and base row, on how many lines the base lies in the window centred on the query.

    Lines are cut into integers, UNITS to a half-width; a value within one unit beyond a window still counts.
    """
    scale, half = UNITS / width, UNITS + 1
    # beyond +-30 widths a value sits at the edge: vectors have unit length, so such lines do not occur but by chance
    a, b = (np.clip(np.rint(x * scale), -30 * UNITS, 30 * UNITS).astype(np.int16) for x in (queries, base))
    low = (a - np.int16(half)).view(np.uint16)
    b = b.view(np.uint16)
    out = np.zeros((len(a), len(b)), np.int8)
    apart, hit = np.empty((min(TILE, len(a)), len(b)), np.uint16), np.empty((min(TILE, len(a)), len(b)), bool)
    for s in range(0, len(a), TILE):
        n = len(a[s : s + TILE])
        for k in range(a.shape[1]):
            np.subtract(b[None, :, k], low[s : s + n, k, None], out=apart[:n])
            np.less_equal(apart[:n], np.uint16(2 * half), out=hit[:n])
            out[s : s + n] += hit[:n].view(np.int8)
    return out


def unit_vectors(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """(rows scaled by powers of two so that squares neither vanish nor overflow, their lengths)."""
    x = np.array(rows, np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x, np.sqrt((x * x).sum(1))


def _post(limit: float):
    """Postings of each class under its cells: (key, place, table, k, cid, label, w, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            i = 0
            while i < whole.num_rows:
                # rows whose postings are about SENT bytes together
                left = whole.slice(i)
                size = np.array([8 * d * tables(k, limit) for d, k in zip(left.column("dim").to_pylist(), left.column("k").to_pylist())])
                n = max(1, int(np.searchsorted(np.cumsum(size), SENT)))
                batch, i = left.slice(0, n), i + n
                vectors, dims, ks = batch.column("v").to_pylist(), batch.column("dim").to_numpy(), batch.column("k").to_numpy()
                label = batch.column("label_key").to_numpy().view(U)
                for d, k in sorted(set(zip(dims.tolist(), ks.tolist()))):
                    at = np.flatnonzero((dims == d) & (ks == k))
                    x, norm = unit_vectors([vectors[j] for j in at])
                    own = cells(x / norm[:, None], k, limit)
                    t = own.shape[1]
                    key = mix(own + (mix(label[at] + U(d)))[:, None]).view(np.int64)
                    rows = batch.take(pa.array(np.repeat(at, t)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.ravel()), pa.array(np.tile(np.arange(t, dtype=np.int32), len(at))), *[rows.column(c) for c in ("k", "cid", "label_key", "w", "v")]],
                        names=["key", "table", "k", "cid", "label_key", "w", "v"],
                    )

    return run


POSTED = "key long, table int, k int, cid long, label_key long, w long, v array<double>"


def _compare(limit: float):
    width, least = window(limit), threshold()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf[pdf["side"] == 0].sort_values("cid")
        right = pdf[pdf["side"] == 1].sort_values("cid")
        same = not len(right)
        if same:
            right = left
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "n": [], "to": []}).astype("int64")
        parts = []
        # two labels or dimensions under one key by chance do not meet
        for name in set(zip(left["label_key"], left["v"].map(len), left["table"])):
            l_, r_ = (np.array([x == name for x in zip(s["label_key"], s["v"].map(len), s["table"])]) for s in (left, right))
            i, j = _linked(left[l_], right[r_], same, name[2], width, least, limit)
            parts.append((np.flatnonzero(l_)[i], np.flatnonzero(r_)[j]))
        i, j = (np.concatenate(x) for x in zip(*parts))
        wl, wr = left["w"].to_numpy(), right["w"].to_numpy()
        cl, cr = left["cid"].to_numpy(), right["cid"].to_numpy()
        n_left = np.bincount(i, weights=wr[j], minlength=len(left)).astype(np.int64)
        n_right = np.bincount(j, weights=wl[i], minlength=len(right)).astype(np.int64)
        low = np.arange(len(left) + (0 if same else len(right)))
        shift = 0 if same else len(left)
        while len(i):  # least member of each local component
            m = np.minimum(low[i], low[j + shift])
            new = low.copy()
            np.minimum.at(new, i, m)
            np.minimum.at(new, j + shift, m)
            new = np.minimum(new, new[new])
            if (new == low).all():
                break
            low = new
        ids = cl if same else np.concatenate([cl, cr])
        tree = np.flatnonzero(low != np.arange(len(low)))
        degree = n_left + n_right if same else np.concatenate([n_left, n_right])
        node = np.concatenate([ids, ids[tree]])
        n = np.concatenate([degree, np.zeros(len(tree), np.int64)])
        to = np.concatenate([ids, ids[low[tree]]])
        use = (n > 0) | (node != to)
        return pd.DataFrame({"node": node[use], "n": n[use], "to": to[use]})

    return run


def _linked(left: pd.DataFrame, right: pd.DataFrame, same: bool, table: int, width: float, least: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of left, row of right) at the limit or over it whose first common cell is in this table."""
    none = np.zeros(0, np.int64)
    if not len(left) or not len(right):
        return none, none
    x, nx = unit_vectors([*left["v"]])
    y, ny = unit_vectors([*right["v"]])
    a = directions(x.shape[1])
    i, j = np.nonzero(collisions(x / nx[:, None] @ a, y / ny[:, None] @ a, width) >= least)
    if same:
        i, j = i[i < j], j[i < j]
    good = np.zeros(len(i), bool)
    for s in range(0, len(i), 1 << 14):
        p, q = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
        good[s : s + len(p)] = (x[p] * y[q]).sum(1) / (nx[p] * ny[q]) >= limit
    i, j = i[good], j[good]
    if table and len(i):
        k = int(left["k"].iloc[0])
        mine, other = cells(x / nx[:, None], k, limit)[:, :table], cells(y / ny[:, None], k, limit)[:, :table]
        first = ~(mine[i] == other[j]).any(1)
        i, j = i[first], j[first]
    return i, j


def near_vectors(vectors: DataFrame, limit: float = 0.93) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``vectors`` has vec_id, embedding (array of numbers) and label; other columns are ignored. A null label, a null,
    empty or zero vector, or one with null or non-finite numbers links with nothing and keeps its own id. Numbers may be as
    small or large as doubles are. Rows with one vec_id count as rows of their own; a component whose ids are all null has a
    null component_id and is kept. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0.0), F.lit(False)) & F.col("label").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.col("label").cast("string").alias("label")).withColumn("cid", F.when(fine, F.xxhash64("label", F.transform("v", lambda x: x + 0.0))))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + 0.0))
    names = scratch.cut(rows.select("vec_id", "cid"))
    classes = scratch.cut(rows.where("cid is not null").groupBy("cid").agg(F.xxhash64(F.first("label")).alias("label_key"), F.count("*").alias("w"), F.first("v").alias("v")).withColumn("dim", F.size("v")))
    steps = F.array(*[F.lit(x).cast("long") for x in depths(limit)])
    sizes = classes.groupBy("label_key", "dim").agg(F.count("*").alias("n")).select("label_key", "dim", F.size(F.filter(steps, lambda x: x <= F.col("n"))).alias("k"))
    posted = scratch.cut(classes.join(sizes, ["label_key", "dim"]).select("cid", "label_key", "w", "v", "dim", "k").mapInArrow(_post(limit), POSTED))
    blocks = posted.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb"))
    dealt = posted.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("cid", F.lit(5)), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    dealt = dealt.select(F.xxhash64("key", lo, hi).alias("pair"), (F.col("block") > F.col("other")).cast("int").alias("side"), "cid", "label_key", "table", "k", "w", "v")
    found = scratch.cut(dealt.groupBy("pair").applyInPandas(_compare(limit), FOUND))
    scratch.drop(posted, classes)
    degree = found.groupBy(F.col("node").alias("cid")).agg(F.sum("n").alias("deg"))
    roots = components(found.where("node != to").select(F.col("node").alias("a"), F.col("to").alias("b")), scratch).select(F.col("node").alias("cid"), "root")
    low = names.where("cid is not null").groupBy("cid").agg(F.min("vec_id").alias("low"), F.count("*").alias("w")).join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = low.groupBy("root").agg(F.min("low").alias("component_id"))
    named = low.join(least, "root").join(degree, "cid", "left").select("cid", (F.coalesce("deg", F.lit(0)) + F.col("w") - 1).cast("long").alias("n_links"), "component_id")
    out = names.where("cid is not null").join(named, "cid").select("vec_id", "n_links", "component_id")
    out = out.unionByName(names.where("cid is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
