"""Near duplicates by MinHash signatures and a signature-coordinate inverted join.

Every document's set of 5-word shingles gets a signature of ``COORDINATES`` minima. A document is posted
under its (coordinate, value) pairs; two sets with Jaccard similarity p agree on a coordinate with probability p,
so at the asked similarity they collide in at least ``matches`` of the coordinates with probability ``RECALL`` or more.

* Values that only one set has are dropped; a set with fewer than ``matches`` shared values links with nothing.
* Prefix: a set's shared values are ordered rarest first. Two sets that agree on ``matches`` of them agree on one
  among the first ``shared - matches + 1`` of each, so only these are posted; the long lists of frequent
  values (templates, common passages) are skipped and only looked at when collisions are counted.
* Lists of up to ``SMALL`` members give all their pairs. A longer list is a group of near copies: its members
  are compared with a pivot, verified links are joined to components, and only members that are still in
  different components are compared further, with new pivots and last block by block with each other, where only
  links come out. Links inside a component that is already known cannot change it. No list is cut.
* Pairs with enough collisions are confirmed on the full shingle sets of both texts.

Texts with equal shingle sets are one class (64-bit set fingerprint), so copies never make pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import Scratch, U, components, mix, random_words, shingle_sets

COORDINATES, RECALL, SMALL, PIVOT_ROUNDS, MEMBERS = 96, 0.999, 8, 2, 256
_A, _B = random_words(11, COORDINATES) | U(1), random_words(12, COORDINATES)
SIGNED = "doc_id long, n_shingles long, cid long, sig array<int>, text_key long"


def matches(percent: int) -> int:
    """Collisions that a pair at the similarity reaches with probability RECALL, by the binomial law: 70 at 85, 64 at 80."""
    p, tail = percent / 100, 0.0
    for m in range(COORDINATES, 1, -1):
        tail += comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if tail >= RECALL:
            return m
    return 1


def fingerprint(s: np.ndarray) -> int:
    """Of a sorted shingle set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([s.sum(dtype=U) + U(len(s)) * U(0x9E3779B97F4A7C15) + mix(s).sum(dtype=U) * U(3)], U))[0].astype(np.int64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """COORDINATES minima of each non-empty set, as int32."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDINATES), np.int32)
    for k in range(COORDINATES):
        out[:, k] = (np.minimum.reduceat(flat * _A[k] + _B[k], at) >> U(32)).astype(np.uint32).view(np.int32)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, sets in shingle_sets(batch.column("text")):
            n = len(sets)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig: list = [None] * n
            cid: list = [None] * n
            if full:
                got = signatures([sets[i] for i in full])
                for i, row in zip(full, got):
                    sig[i], cid[i] = row, fingerprint(sets[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, n).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(cid, pa.int64()), pa.array(sig, pa.list_(pa.int32())), batch.column("text_key").slice(lo, n)],
                names=["doc_id", "n_shingles", "cid", "sig", "text_key"],
            )


def _confirm(percent: int):
    """Streams (target, part, member, text) rows, the target's own first, and keeps members that reach the similarity.

    A part holds the target and about 64 members; one shingle set is kept at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base = None, None
        for batch in batches:
            targets, parts, members = (batch.column(c).to_pylist() for c in ("target", "part", "member"))
            a, b = [], []
            for lo, sets in shingle_sets(batch.column("text")):
                for i, s in enumerate(sets, lo):
                    if members[i] != fingerprint(s):
                        continue  # another text under the same doc_id
                    if targets[i] == members[i]:
                        now, base = (targets[i], parts[i]), s
                    elif now == (targets[i], parts[i]):
                        both = np.count_nonzero(base[np.minimum(np.searchsorted(base, s), len(base) - 1)] == s)
                        if 100 * both >= percent * (len(base) + len(s) - both):
                            a.append(targets[i])
                            b.append(members[i])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _compare(percent: int):
    """Streams rows by (key, bi, bj), two blocks of a list, and gives the links between their components."""
    enough = matches(percent)

    def links(key: int, bi: int, bj: int, rows: list[tuple]) -> list[tuple[int, int]]:
        _, _, _, cid, root, sig, p, blk, text = zip(*rows)
        sets = [s for _, part in shingle_sets(pa.array(text, pa.large_string())) for s in part]
        fine = np.array([fingerprint(s) == c for s, c in zip(sets, cid)])
        cid, root, sig, blk = np.array(cid), np.array(root), np.array(sig, np.int32), np.array(blk)
        n = np.array([len(s) for s in sets])
        left, right = np.flatnonzero((blk == bi) & fine), np.flatnonzero((blk == bj) & fine)
        same = np.zeros((len(left), len(right)), np.int16)
        for k in range(COORDINATES):
            same += sig[left, k][:, None] == sig[right, k][None, :]
        ok = (same >= enough) & (root[left][:, None] != root[right][None, :])
        ok &= 100 * np.minimum(n[left][:, None], n[right][None, :]) >= percent * np.maximum(n[left][:, None], n[right][None, :])
        ok &= (cid[left][:, None] < cid[right][None, :]) if bi == bj else (cid[left][:, None] != cid[right][None, :])
        if not ok.any():
            return []
        # a pair belongs to the first value that both lists of values share
        names: dict[int, int] = {}
        earlier = [[names.setdefault(v, len(names)) for v in x[: x.index(key)]] for x in p]
        held = np.zeros((len(rows), max(1, len(names))), np.float32)
        for i, x in enumerate(earlier):
            held[i, x] = 1
        ok &= held[left] @ held[right].T == 0
        out = []
        for i, j in zip(*np.nonzero(ok)):
            x, y = sets[left[i]], sets[right[j]]
            both = np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                out.append((int(cid[left[i]]), int(cid[right[j]])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[:3] != now:
                    out += links(*now, rows) if rows else []
                    now, rows = r[:3], []
                rows.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
                out = []
        out = links(*now, rows) if rows else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return run


class _Linker:
    def __init__(self, docs: DataFrame, percent: int, scratch: Scratch):
        self.scratch, self.percent, self.matches = scratch, percent, matches(percent)
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.docs = texts
        self.signed = scratch.cut(texts.withColumn("text_key", F.xxhash64("text")).mapInArrow(_sign, SIGNED))
        self.classes = scratch.cut(self.signed.where("cid is not null").groupBy("cid").agg(F.first("sig").alias("sig"), F.first("n_shingles").alias("n"), F.min("doc_id").alias("doc_id")))
        self.postings = scratch.cut(self._postings())
        self.texts: DataFrame | None = None

    def _postings(self) -> DataFrame:
        """(key, cid, central, p) of the rarest shared values of each class, rarest first in p.

        ``central``: how many sets share the class's values in all. The text that a group's copies were made from shares
        most with them, so the most central member of a list is its best pivot.
        """
        c = self.classes
        posts = c.select("cid", F.posexplode("sig").alias("k", "v")).select("cid", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
        shared = posts.groupBy("key").agg(F.count("*").alias("freq")).where("freq > 1")
        own = posts.join(shared, "key").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("freq", "key"))).alias("p"))  # COORDINATES entries at most
        central = F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["freq"])
        cut = own.where(F.size("p") >= self.matches).select("cid", central.alias("central"), F.transform(F.slice("p", F.lit(1), F.size("p") - (self.matches - 1)), lambda x: x["key"]).alias("p"))
        return cut.select(F.explode("p").alias("key"), "cid", "central", "p")

    def _alike(self) -> Column:
        """Sizes allow the similarity and signatures collide in enough coordinates."""
        same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        return (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent) & (same >= self.matches)

    def _agree(self, pairs: DataFrame) -> DataFrame:
        side = lambda x: self.classes.select(F.col("cid").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").where(self._alike()).select("a", "b")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Verified links among pairs of classes."""
        pairs = self.scratch.cut(self._agree(pairs))
        if self.texts is None:
            # the texts of every class that is posted at all: one pass over the documents for all rounds
            posted = self.postings.select("cid").distinct().join(self.classes.select("cid", "doc_id"), "cid")
            here = posted.where("doc_id is not null").join(self.docs, "doc_id").select(F.col("cid").alias("member"), "text")
            lost = posted.where("doc_id is null").select("cid").join(self.docs.where("doc_id is null").mapInArrow(_fingerprints, "cid long, text string"), "cid").select(F.col("cid").alias("member"), "text")
            self.texts = self.scratch.cut(here.unionByName(lost).dropDuplicates(["member", "text"]))
        many = pairs.groupBy("a").agg(F.ceil(F.count("*") / 64).alias("parts"))
        parts = pairs.join(many, "a").select(F.col("a").alias("target"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("member"))
        own = parts.select("target", "part", F.col("target").alias("member")).distinct()
        asked = parts.unionByName(own).join(self.texts, "member")
        first = (F.col("member") != F.col("target")).cast("int")
        dealt = asked.withColumn("o", first).repartition("target", "part").sortWithinPartitions("target", "part", "o").select("target", "part", "member", "text")
        return self.scratch.cut(dealt.mapInArrow(_confirm(self.percent), "a long, b long"))

    def _blockwise(self, open_: DataFrame) -> DataFrame:
        """Links between different components of the open lists: blocks of a list meet in pairs, only links come out."""
        blocks = open_.groupBy("key").agg(F.ceil(F.count("*") / MEMBERS).alias("nb"))
        rows = open_.join(blocks, "key").withColumn("blk", F.pmod(F.xxhash64("cid", F.lit(9)), F.col("nb")).cast("int"))
        rows = rows.select("key", "cid", "root", "sig", "p", "blk", F.explode(F.sequence(F.lit(0), F.col("nb").cast("int") - 1)).alias("other"))
        dealt = rows.join(self.texts, F.col("cid") == F.col("member")).select("key", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "cid", "root", "sig", "p", "blk", "text")
        dealt = dealt.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
        return self.scratch.cut(dealt.mapInArrow(_compare(self.percent), "a long, b long"))

    def joined(self, comp: DataFrame, links: DataFrame) -> DataFrame:
        """(node, root) with further links: only their ends' roots are joined anew."""
        root = lambda x: comp.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
        ends = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
        ends = self.scratch.cut(ends.where("ra != rb"))
        if not ends.limit(1).count():
            return comp
        above = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")), self.scratch).select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comp, "node", "left_anti").select("node", F.col("node").alias("root"))
        return self.scratch.cut(comp.unionByName(new).join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")))

    def run(self) -> DataFrame:
        """(cid, root) of every class that links with another."""
        lists = self.postings.groupBy("key").agg(F.count("*").alias("m"), F.max_by("cid", F.struct("central", "cid")).alias("pivot")).where("m > 1")
        posted = self.postings.join(lists, "key")
        star = posted.where("cid != pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b"))
        small = posted.where(F.col("m") <= SMALL).select("key", "cid", "pivot").where("cid != pivot")
        rest = small.select("key", F.col("cid").alias("a")).join(small.select("key", F.col("cid").alias("b")), "key").where("a < b").select("a", "b")
        comp = components(self.confirm(star.unionByName(rest).distinct()), self.scratch)
        long_lists = posted.where(F.col("m") > SMALL).select("key", "cid", "central", "p", "pivot")
        for turn in range(PIVOT_ROUNDS + 1):
            open_ = self.scratch.cut(self._open(long_lists, comp))
            if not open_.limit(1).count():
                break
            if turn < PIVOT_ROUNDS:
                # the next central member of the list's largest component against all that are not in it
                order = F.struct("central", "cid") if turn == 0 else F.struct(F.xxhash64("cid", F.lit(turn)).alias("h"), "cid")
                pick = open_.where("cid != pivot").groupBy("key", "root").agg(F.count("*").alias("n"), F.max_by("cid", order).alias("next"))
                pivot = pick.groupBy("key").agg(F.max(F.struct("n", "root", "next")).alias("top")).select("key", F.col("top.root").alias("main"), F.col("top.next").alias("next"))
                pairs = open_.join(pivot, "key").where("root != main").select(F.least("cid", "next").alias("a"), F.greatest("cid", "next").alias("b"))
                links = self.confirm(pairs.distinct())
            else:
                links = self._blockwise(open_)
            comp = self.joined(comp, links)
        return comp.select(F.col("node").alias("cid"), "root")

    def _open(self, lists: DataFrame, comp: DataFrame) -> DataFrame:
        """Members of lists that still hold more than one component."""
        now = lists.join(comp.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        mixed = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
        return now.join(mixed, "key").join(self.classes.select("cid", "n", "sig"), "cid")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, sets in shingle_sets(batch.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.int64()), batch.column("text").slice(lo, len(sets)).cast(pa.string())], names=["cid", "text"])


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), text_key (hash of its text), kept.

    ``docs`` has doc_id and text; other columns are ignored. Null or empty texts link with nothing and stay.
    Rows with equal texts are linked, rows of one doc_id count as rows of their own; a null doc_id is never the
    smallest, and a component of null ids alone has a null component_id and keeps all its rows.
    """
    scratch = Scratch(docs.sparkSession)
    linker = _Linker(docs, percent, scratch)
    roots = linker.run()
    classes = linker.classes.select("cid", "doc_id").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    low = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = classes.join(low, "root").select("cid", "component_id")
    signed = linker.signed.select("doc_id", "n_shingles", "cid", "text_key")
    linked = signed.where("cid is not null").join(named, "cid").select("doc_id", "n_shingles", "component_id", "text_key")
    out = linked.unionByName(signed.where("cid is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))

