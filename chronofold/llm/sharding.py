"""Sharding by balanced label propagation: equal texts move together while shards keep equal row counts.

Law ``rows``: shard sizes are at most one apart. Documents with equal texts are linked. They start on shards by a
hash of their id. In each round, until no move is accepted, a join over the links tells every linked row where its neighbours
are: rows on the lesser shards of a group move to where most of it is, as far as the quotas allow: a shard takes in what
its room and the rows that leave it make up for. A group beyond one shard's share gets as many shards as it fills. Rows of one group on one shard are alike, so propagation runs on (group, shard, count) cells: 40
a group at most, however large the group. Unlinked documents cost no cut edges wherever they are; they fill what the
groups leave. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import Scratch, bucketed_rank

SHARDS = 40
ROUNDS = 60  # a bound only: rounds end when no move is accepted


def quotas(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def acceptance(room: list[int], flows: list[tuple[int, int, int]]) -> list[float]:
    """Share of the wanted moves into each shard that fits its room and what leaves it: the largest such shares."""
    n = len(room)
    inflow = [0] * n
    for _, b, k in flows:
        inflow[b] += k
    share = [1.0] * n
    for _ in range(100):
        leaving = [0.0] * n
        for a, b, k in flows:
            leaving[a] += k * share[b]
        new = [min(share[s], max(0.0, (room[s] + leaving[s]) / inflow[s])) if inflow[s] else 1.0 for s in range(n)]
        if max(x - y for x, y in zip(share, new)) < 1e-6:
            break
        share = new
    return share


def propagate(cells: DataFrame, quota: list[int], scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """Cells (g, shard, n) after the rounds. The loads of all shards, a bounded list, are read each round."""
    cells = scratch.cut(cells)
    for turn in range(rounds):
        load = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [q - load.get(s, 0) for s, q in enumerate(quota)]
        quota_of = F.element_at(F.array(*[F.lit(max(1, q)).cast("long") for q in quota]), F.col("shard") + 1)
        # neighbours' votes: each group's shards, those where most of it is first (one entry per shard)
        votes = cells.select("g", F.struct((-F.col("n")).alias("less"), F.xxhash64("g", "shard").alias("tie"), "shard", "n", quota_of.alias("quota")).alias("vote"))
        votes = votes.groupBy("g").agg(F.array_sort(F.collect_list("vote")).alias("votes"))
        # its shards are targets until their quotas hold the group
        whole = F.aggregate("votes", F.lit(0).cast("long"), lambda s, v: s + v["n"])
        none = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("to"))
        targets = F.aggregate("votes", none, lambda s, v: F.when(s["held"] < F.col("whole"), F.struct((s["held"] + v["quota"]).alias("held"), F.array_append(s["to"], v["shard"]).alias("to"))).otherwise(s), lambda s: s["to"])
        wanted = votes.withColumn("whole", whole).select("g", targets.alias("targets")).where(F.size("targets") < F.size("votes"))
        # every cell looks up what its neighbours want, by a join over the links
        moves = cells.join(wanted, "g").where(~F.array_contains("targets", F.col("shard")))
        to = F.element_at("targets", (F.pmod(F.xxhash64("g", "shard", F.lit(turn)), F.size("targets")) + 1).cast("int"))
        moves = scratch.cut(moves.select("g", "shard", "n", to.alias("to")))
        flows = [(r["shard"], r["to"], r["n"]) for r in moves.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()]  # shards^2 at most
        if not flows:
            break
        accept = acceptance(room, flows)
        share = F.element_at(F.array(*[F.lit(x) for x in accept]), F.col("to") + 1)
        luck = F.pmod(F.xxhash64("g", "shard", F.lit(turn + 1000)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        taken = F.least(F.col("n"), F.floor(F.col("n") * share + F.when(share < 1.0, luck).otherwise(0.0)))
        moved = moves.withColumn("taken", taken).where("taken > 0")
        if not moved.limit(1).count():
            break
        change = moved.select("g", F.col("to").alias("shard"), F.col("taken").alias("n")).unionByName(moved.select("g", "shard", (-F.col("taken")).alias("n")))
        new = scratch.cut(cells.unionByName(change).groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
        scratch.drop(cells, moves)
        cells = new
    return cells


def _cells(rows: DataFrame, quota: list[int]) -> DataFrame:
    """(g, shard, n): each row on a shard by a hash of its id, as often as the shard's quota says."""
    ends = [sum(quota[: s + 1]) for s in range(len(quota))]
    at = F.pmod(F.xxhash64("doc_id", "g", F.lit(31)), F.lit(max(1, ends[-1])))
    start = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in ends]), lambda x: x <= at))
    return rows.groupBy("g", F.least(start, F.lit(len(quota) - 1)).cast("int").alias("shard")).agg(F.count("*").alias("n"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, group_rows, group_cut.

    ``docs`` has doc_id and text; other columns are ignored. A null text has size 16 and is linked with nothing; an empty
    text is a text. Repeated rows are rows of their own. ``group_rows``: rows with this text; ``group_cut``: how many of
    them are on other shards.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = scratch.cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"), F.when(text.isNotNull(), F.xxhash64(text)).alias("g"),
    ))
    total = rows.count()
    quota = quotas(total, shards)
    groups = scratch.cut(rows.where("g is not null").groupBy("g").agg(F.count("*").alias("whole")).where("whole > 1"))
    large = F.col("whole") > max(8, total // shards // 4)
    dealt = rows.join(groups, "g")
    # groups that take much of a shard go first, small ones to what those leave
    first = _cells(dealt.where(large), quota)
    first = propagate(first, quota, scratch)
    load = {r["shard"]: r["n"] for r in first.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    rest = [max(0, q - load.get(s, 0)) for s, q in enumerate(quota)]
    cells = scratch.cut(first.unionByName(propagate(_cells(dealt.where(~large), rest), rest, scratch)))
    # rows of a group by rank onto its cells
    ends = F.sum("n").over(Window.partitionBy("g").orderBy("shard"))
    spread = cells.withColumn("end", ends).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("cells"))
    linked = bucketed_rank(rows.join(groups, "g").select("doc_id", "size", "text_crc32", "g", "whole"), ["g"], [F.col("doc_id"), F.col("g")], name="r")
    at = F.size(F.filter("cells", lambda c: c["end"] <= F.col("r")))
    linked = linked.join(spread, "g").select("doc_id", "size", "text_crc32", "g", "whole", F.element_at("cells", at + 1)["shard"].alias("shard"))
    linked = scratch.cut(linked)
    load = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    if any(load.get(s, 0) > q for s, q in enumerate(quota)):
        # the few rows that chance put beyond a quota go back to the pool
        over = F.element_at(F.array(*[F.lit(q).cast("long") for q in quota]), F.col("shard") + 1)
        held = bucketed_rank(linked, ["shard"], [F.col("g"), F.col("doc_id")], name="r")
        linked = scratch.cut(held.withColumn("shard", F.when(F.col("r") < over, F.col("shard"))).drop("r"))
        load = {r["shard"]: r["n"] for r in linked.where("shard is not null").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    single = rows.join(groups.select("g"), "g", "left_anti").withColumn("whole", F.lit(1).cast("long")).withColumn("shard", F.lit(None).cast("int"))
    loose = single.select(*linked.columns).unionByName(linked.where("shard is null"))
    ends_at, have = [], 0
    for s, q in enumerate(quota):
        have += q - load.get(s, 0)
        ends_at.append(have)
    pool = bucketed_rank(loose, [], [F.col("doc_id"), F.col("text_crc32")], name="r")
    fill = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in ends_at]), lambda x: x <= F.col("r")))
    placed = scratch.cut(linked.where("shard is not null").unionByName(pool.withColumn("shard", fill.cast("int")).select(*linked.columns)))
    here = placed.where("whole > 1").groupBy("g", "shard").agg(F.count("*").alias("here"))
    slots = bucketed_rank(placed, ["shard"], [F.col("doc_id"), F.col("text_crc32")], name="slot")
    out = slots.join(here, ["g", "shard"], "left")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("whole").alias("group_rows"), (F.col("whole") - F.coalesce("here", F.lit(1))).alias("group_cut"))
