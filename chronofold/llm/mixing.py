"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent a and normalised: a = 1 keeps them, a smaller one flattens. The
exponent is the largest at which the entropy of the weights reaches ``ENTROPY`` of the most it can be, but not so
small that a source would be repeated more than ``REPEAT`` times as often as the least repeated one. It is bisected
(64 sections a step). The budget is the least with which every source is read once: no document is left out, and a
source with r times its share's weight is read r times.

The weights are realised by block permutations: a source's documents fall into blocks of about ``BLOCK``; every
epoch orders the blocks, and the documents in each, by hashes of the epoch. A last, partial epoch goes as far as its
token budget. Positions are running token sums within a block on top of sums over the blocks, so no task holds a
source. DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from chronofold.llm.common import Scratch

ENTROPY, REPEAT, BLOCK, SECTIONS, STEPS = 0.98, 2.0, 4096, 64, 4
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    """Words, at least 1: an empty document takes a place too."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))).cast("long")


def exponent(sources: DataFrame, entropy: float = ENTROPY, repeat: float = REPEAT, steps: int = STEPS) -> float:
    """Of a table (source, tokens): the exponent. Each step is one aggregate over sources x SECTIONS grid points."""
    first = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if first["n"] < 2:
        return 1.0
    sources = sources.select((F.col("tokens") / F.lit(float(first["t"]))).alias("p"))

    def section(holds: Callable[[Row], bool]) -> tuple[float, float]:
        """The last grid step between exponents where ``holds`` is true and where it is false; it changes once."""
        low, high = 0.0, 1.0
        for _ in range(steps):
            grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
            power = F.pow("p", "a")
            at = sources.withColumn("a", F.explode(F.array(*[F.lit(x) for x in grid])))
            less = F.pow("p", F.col("a") - 1)
            rows = at.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log(power)).alias("plogp"), (F.max(less) / F.min(less)).alias("repeat")).orderBy("a").collect()  # SECTIONS + 1
            start = holds(rows[0])
            change = next((i for i, r in enumerate(rows) if holds(r) != start), None)
            if change is None:
                return (1.0, 1.0) if start else (0.0, 0.0)
            low, high = rows[change - 1]["a"], rows[change]["a"]
        return low, high

    # entropy falls and calm comes as the exponent rises
    flat, _ = section(lambda r: math.log(r["z"]) - r["plogp"] / r["z"] >= entropy * math.log(first["n"]))
    sharp, calm = section(lambda r: r["repeat"] > repeat)
    return max(flat, calm if sharp != calm else 0.0 if sharp == 0.0 else 1.0)


def weights(sources: DataFrame, entropy: float = ENTROPY, repeat: float = REPEAT) -> DataFrame:
    """source, tokens, weight, epochs (reads of the source), budget (tokens), exponent."""
    a = exponent(sources, entropy, repeat)
    sums = sources.agg(F.sum("tokens").cast("double").alias("t"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(a))).alias("z"), F.min(F.pow(F.col("tokens").cast("double"), F.lit(a - 1))).alias("least")).first()
    x = F.col("tokens").cast("double")
    if sums["t"] is None:
        return sources.select("source", "tokens", *[F.lit(0.0).alias(n) for n in ("weight", "epochs")], F.lit(0).cast("long").alias("budget"), F.lit(a).alias("exponent"))
    epochs = F.round(F.pow(x, F.lit(a - 1)) / F.lit(sums["least"]), 9)
    return sources.select("source", "tokens", (F.pow(x, F.lit(a)) / F.lit(sums["z"])).alias("weight"), epochs.alias("epochs"), F.round(epochs * x).cast("long").alias("budget"), F.lit(a).alias("exponent"))


def mix(docs: DataFrame, entropy: float = ENTROPY, repeat: float = REPEAT) -> DataFrame:
    """One row per emitted copy: doc_id, source, text_key, n_tokens, epoch, block, token_offset, weight, exponent.

    ``docs`` has doc_id, text and source; other columns are ignored. A null source is the source ''. ``token_offset`` is
    the copy's place in its source's stream of tokens; a copy is emitted while the offset is below the source's budget.
    Repeated rows are documents of their own; null or empty texts count one token; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = scratch.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.xxhash64(text).alias("text_key"), n_tokens(text).alias("n_tokens")))
    sources = scratch.cut(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")))
    plan = scratch.cut(weights(sources, entropy, repeat).join(sources.select("source", F.ceil(F.col("n") / BLOCK).alias("n_blocks")), "source"))
    key = F.xxhash64("doc_id", "text_key")
    dealt = rows.join(plan.select("source", "tokens", "n_blocks", "weight", "epochs", "budget", "exponent"), "source")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(key, F.lit(3)), F.col("n_blocks")).cast("int")).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil("epochs").cast("int") - 1)))
    sums = rows.join(plan.select("source", "tokens", "n_blocks", "epochs"), "source").groupBy("source", "tokens", "epochs", F.pmod(F.xxhash64(key, F.lit(3)), F.col("n_blocks")).cast("int").alias("block")).agg(F.sum("n_tokens").alias("in_block"))
    sums = sums.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil("epochs").cast("int") - 1)))
    # blocks in the order of a hash of the epoch: cut into bands by it, so that a window task holds a band of about 1024 blocks
    bands = plan.select("source", F.greatest(F.lit(1), F.floor(F.col("n_blocks") / 1024)).cast("long").alias("n_bands"))
    hashed = sums.join(bands, "source").withColumn("h", F.shiftrightunsigned(F.xxhash64("source", "block", "epoch"), 1))
    hashed = hashed.withColumn("band", F.floor(F.col("h") / F.lit(float(1 << 63)) * F.col("n_bands")))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    below = hashed.groupBy("source", "epoch", "band").agg(F.sum("in_block").alias("in_band"))
    below = below.select("source", "epoch", "band", F.coalesce(F.sum("in_band").over(before("source", "epoch").orderBy("band")), F.lit(0)).alias("below"))  # one row per band
    within = F.coalesce(F.sum("in_block").over(before("source", "epoch", "band").orderBy("h", "block")), F.lit(0))
    starts = hashed.withColumn("within", within).join(below, ["source", "epoch", "band"]).select("source", "epoch", "block", (F.col("within") + F.col("below") + F.col("epoch") * F.col("tokens")).alias("block_offset"))
    inner = Window.partitionBy("source", "epoch", "block").orderBy(F.xxhash64(key, F.col("epoch")), "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("before", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(starts, ["source", "epoch", "block"])
    placed = placed.withColumn("token_offset", F.col("before") + F.col("block_offset")).where(F.col("token_offset") < F.col("budget"))
    return placed.select("doc_id", "source", "text_key", "n_tokens", "epoch", "block", "token_offset", "weight", "exponent")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mixture reads it; columns as they were, whatever their names.

    Rows are told apart by id and text: a null id and a null text match themselves, repeated rows are read as often as each of them
    would be. An empty table gives no rows.
    """
    copies = mix(docs).groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.count_if(F.col("epoch") == 0).alias("rows"))
    each = copies.select(F.struct(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), F.ceil(F.col("n") / F.col("rows")).cast("int").alias("n")).alias("mix"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    both = rows.join(each, F.col("id").eqNullSafe(F.col("mix.id")) & (F.col("key") == F.col("mix.key")))
    return both.select("doc", F.explode(F.sequence(F.lit(1), F.col("mix.n")))).select("doc.*")
