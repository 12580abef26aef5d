"""Shared parts: scratch tables, text packing, hashing of words and shingles, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Text bytes that are worked on at once: arrays of it fit a core's cache, and two workers' memory stays small.
CHUNK = 1 << 19
SHINGLE = 5


class Scratch:
    """Tables written to the shared folder that the session names in spark.checkpoint.dir; they cut lineage.

    Without that setting a local session gets a temporary folder; a cluster session is an error. Results read their tables when
    they are used, so folders stay until ``remove``: whoever has written a result out may drop all that it was made from.
    """

    open: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            root = _local_root()
        self.root = f"{root.rstrip('/')}/chronofold-{uuid.uuid4().hex}"
        self.n = 0
        Scratch.open.append(self)

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "lz4_raw").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *dfs: DataFrame) -> None:
        """Remove tables of this scratch folder that nothing reads any more."""
        jvm = self.spark._jvm
        for df in dfs:
            for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
                if self.root.rpartition("/")[2] in f:
                    p = jvm.org.apache.hadoop.fs.Path(f)
                    p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


    def remove(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        if self in Scratch.open:
            Scratch.open.remove(self)


@contextmanager
def scratch_dropped() -> Iterator[None]:
    """Removes the scratch folders that were opened inside, at the end. Results made inside must have been written out."""
    before = list(Scratch.open)
    try:
        yield
    finally:
        for s in [s for s in Scratch.open if s not in before]:
            s.remove()


@lru_cache(1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="chronofold-")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over all 64."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def random_words(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0xD1B54A32D192ED03 % (1 << 64)))


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


_SEEDS = random_words(1, 4)


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one little-endian number, zeros beyond the end: a view, not a copy."""
    wide = np.empty(len(data) + 8, np.uint8)
    wide[: len(data)], wide[len(data) :] = data, 0
    return np.ndarray((len(data) + 1,), "<u8", wide, strides=(1,))


_HEAD = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U)  # masks of the first k bytes of a word


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (counts[i] of them), for all i end to end."""
    total = int(counts.sum())
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(total)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray | None = None, salt: int = 0) -> np.ndarray:
    """Hash of the byte ranges [start, end): every block of 8 bytes is mixed with its place in the range, then summed.

    Blocks go through a non-linear mixer before they are added, so no repetitive text cancels out (as it can in a polynomial
    modulo 2^64). Another ``salt`` gives an independent hash. Where equality must be certain, ``distinct_ranges`` compares the bytes.
    """
    words = words_at(data) if words is None else words
    size = end - start
    salted = U(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    out = mix((words[start] & _HEAD[np.minimum(size, 8)]) ^ _SEEDS[0] ^ salted)
    long = np.flatnonzero(size > 8)
    if len(long):
        blocks = (size[long] - 1) >> 3  # beyond the first
        place = spread(np.ones(len(long), np.int64), blocks)
        at = np.repeat(start[long], blocks) + 8 * place
        block = words[at] & _HEAD[np.minimum(np.repeat(end[long], blocks) - at, 8)]
        mixed = mix(block ^ mix(place.astype(U) * _SEEDS[1] + _SEEDS[2]) ^ salted)
        out[long] += np.add.reduceat(mixed, np.cumsum(blocks) - blocks)
    return mix(out + size.astype(U) * (_SEEDS[3] | U(1)))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes (a multiple of 8) at each position that has as many."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    words = words_at(data)
    out = words[:n] ^ _SEEDS[0]
    for j in range(8, k, 8):
        out = mix(out) + words[j : n + j]
    return mix(out)


def same_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Whether the ``size`` bytes at a equal those at b, for each pair."""
    words = words_at(data) if words is None else words
    out = ((words[a] ^ words[b]) & _HEAD[np.minimum(size, 8)]) == 0
    long = np.flatnonzero((size > 8) & out)
    if len(long):
        blocks = (size[long] - 1) >> 3
        ahead = 8 * spread(np.ones(len(long), np.int64), blocks)
        left = np.minimum(np.repeat(size[long], blocks) - ahead, 8)
        differ = (words[np.repeat(a[long], blocks) + ahead] ^ words[np.repeat(b[long], blocks) + ahead]) & _HEAD[left]
        out[long] = np.bitwise_or.reduceat(differ, np.cumsum(blocks) - blocks) == 0
    return out


def distinct_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first range of each distinct byte string, number of each range's string, hashes).

    Hashes propose, bytes decide: should two strings share a hash, strings are told apart by their bytes.
    """
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U)
    words = words_at(data)
    h = range_hashes(data, start, end, words)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    rep = first[back]
    size = end - start
    other = np.flatnonzero(rep != np.arange(len(rep)))
    fine = (size[other] == size[rep[other]]) & same_ranges(data, start[other], start[rep[other]], np.minimum(size[other], size[rep[other]]), words)
    if not fine.all():
        raw, names = data.tobytes(), {}
        back = np.array([names.setdefault(raw[s:e], len(names)) for s, e in zip(start.tolist(), end.tolist())], np.int64)
        first = np.unique(back, return_index=True)[1]
    return first, back, h


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words ``[^\\x20\\x09-\\x0D]+``; a row's end ends a word."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~WHITE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


_PLACE = random_words(2, 64) | U(1)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the k-word shingles in word order; a row of 1 to k-1 words has its whole sequence as one."""
    n = len(words)
    h, r = np.zeros(0, U), np.zeros(0, np.int64)
    if n >= k:
        h = words[: n - k + 1] * _PLACE[0]
        for j in range(1, k):
            h = h + mix(words[j : n - k + 1 + j] + _PLACE[j]) * _PLACE[j]
        ok = rows[: n - k + 1] == rows[k - 1 :]
        h, r = mix(h[ok]), rows[: n - k + 1][ok]
    count = np.bincount(rows, minlength=n_rows)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(rows, short)
        own = []
        for i, row in zip(first, short):
            x = np.full(1, count[row], U) * _PLACE[40]
            for j in range(count[row]):
                x = x + mix(words[i + j : i + j + 1] + _PLACE[j]) * _PLACE[j]
            own.append(x)
        h = np.concatenate([h, mix(np.concatenate(own))])
        r = np.concatenate([r, short])
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r


def shingle_sets(texts: pa.Array, k: int = SHINGLE, limit: int = CHUNK) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for runs of rows; A-Z in lower case."""
    for lo, hi, data, offsets in chunks(texts, limit):
        data = LOWER[data]
        s, e, rows = word_bounds(data, offsets)
        words = range_hashes(data, s, e)
        h, r = shingle_hashes(words, rows, hi - lo, k)
        at = np.searchsorted(r, np.arange(hi - lo + 1))
        yield lo, [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:])]


def ids_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return pc.fill_null(batch.column(name).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the links; root names the component.

    Contraction: each node joins its neighbour that a per-round hash orders first, edges are rewritten to
    the joined nodes, loops and repeats go; a constant share of nodes goes each round. Then the steps are
    chained back. No component is ever held by one task.
    """
    x, y = F.col(a), F.col(b)
    edges = scratch.cut(links.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a != b").distinct())
    steps: list[DataFrame] = []
    seed = 0
    while edges.limit(1).count():
        seed += 1
        order = lambda c: F.struct(F.xxhash64(c, F.lit(seed)).alias("h"), c.alias("n"))
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        step = both.groupBy("node").agg(F.min(order(F.col("to"))).alias("m")).select("node", F.least("m", order(F.col("node")))["n"].alias("root"))
        step = scratch.cut(step)
        left, right = step.select(F.col("node").alias("a"), F.col("root").alias("ra")), step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(left, "a").join(right, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a != b").distinct()
        steps.append(step)
        old, edges = edges, scratch.cut(moved)
        scratch.drop(old)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[-1]
    for step in reversed(steps[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = step.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return scratch.cut(out) if len(steps) > 1 else out


LEVEL = 1024  # buckets that are summed together before sums are summed on


def running_offsets(sums: DataFrame, keys: list[str], at: str, n: str, name: str) -> DataFrame:
    """Adds the sum of ``n`` over all rows of ``keys`` with a smaller ``at`` (a number from 0, one row each).

    In two levels: a window task holds LEVEL rows, or one row for every LEVEL.
    """
    from pyspark.sql import Window

    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    rows = sums.withColumn("_level", F.floor(F.col(at) / LEVEL))
    upper = rows.groupBy(*keys, "_level").agg(F.sum(n).alias("_sum"))
    upper = upper.withColumn("_below", F.coalesce(F.sum("_sum").over(before(*keys).orderBy("_level")), F.lit(0)))
    upper = upper.select(*[F.col(k).alias(f"_u{k}") for k in keys], F.col("_level").alias("_u"), "_below")
    on = F.col("_level") == F.col("_u")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_u{k}"))
    inner = F.coalesce(F.sum(n).over(before(*keys, "_level").orderBy(at)), F.lit(0))
    return rows.withColumn("_inner", inner).join(upper, on).select(*sums.columns, (F.col("_inner") + F.col("_below")).cast("long").alias(name))


def bucketed_rank(df: DataFrame, keys: list[str], order: list[Column], scratch_rows: int = 1024, name: str = "rank") -> DataFrame:
    """Adds a gapless rank from 0 within ``keys`` in the order of ``order`` buckets, without one task per key.

    Rows fall into hash buckets of their order columns; ranks are counted per (key, bucket) and offset by
    a running sum over the buckets, in two levels. The order of rows is by bucket, then by ``order``: fixed, but not sorted.
    Bucket count grows with the table: about ``scratch_rows`` rows each.
    """
    from pyspark.sql import Window

    total = df.count()
    n = max(1, total // scratch_rows)
    rows = df.withColumn("_b", F.pmod(F.xxhash64(*order, F.lit(97)), F.lit(n)).cast("int"))
    sums = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    offsets = running_offsets(sums, keys, "_b", "_n", "_o").select(*[F.col(k).alias(f"_k{k}") for k in keys], F.col("_b").alias("_c"), "_o")
    inner = Window.partitionBy(*keys, "_b").orderBy(*order)
    ranked = rows.withColumn("_r", F.row_number().over(inner) - 1)
    on = F.col("_b") == F.col("_c")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k{k}"))
    return ranked.join(offsets, on).select(*df.columns, (F.col("_r") + F.col("_o")).cast("long").alias(name))
