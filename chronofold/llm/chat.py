"""Preference formatting: chosen and rejected conversations with their common start rendered once.

The prompt is the longest common prefix of turns (equal role and text). What follows is each side's completion, with
the spans of assistant turns that a trainer should learn from; all else is masked. A shared start that takes in a whole
side gives an empty completion for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"


def render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))))


def learned_spans(turns: Column) -> Column:
    """Character spans [start, end) of assistant texts within the rendered turns."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["role"]) + 5
        end = start + F.length(t["text"])
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct((end + 1).cast("long").alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def common_turns(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))  # the shorter side is filled with nulls
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Adds n_prompt_turns, prompt, chosen_text, rejected_text, chosen_spans, rejected_spans to rows with chosen and rejected turns.

    Null turns are no turns, a null role or text is empty.
    """
    clean = lambda c: F.transform(F.coalesce(F.col(c).cast(TURNS), F.array().cast(TURNS)), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    rows = pairs.withColumns({"chosen": clean("chosen"), "rejected": clean("rejected")}).withColumn("n_prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.size(c))
    return rows.withColumns({
        "prompt": render(F.slice("chosen", F.lit(1), F.col("n_prompt_turns"))),
        "chosen_text": render(rest(F.col("chosen"))), "rejected_text": render(rest(F.col("rejected"))),
        "chosen_spans": learned_spans(rest(F.col("chosen"))), "rejected_spans": learned_spans(rest(F.col("rejected"))),
    })


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order (by turn, then role and text; null first)."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("t"))
    return whole.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def preferences(turns: DataFrame) -> DataFrame:
    """One row per conversation: those with one first turn form a group, its smallest conv_id is preferred to each other.

    conv_id (the rejected side), chosen_id, status (``pair``; ``same``: equal conversations; ``first``: the group's
    preferred one, paired with nothing), and the columns of format_pairs, null for ``first``. ``turns`` has conv_id, turn,
    role, text; rows with a null conv_id are one conversation; repeated rows are turns of their own. A conversation is one
    row by its nature; groups are joined by their first turn and never collected.
    """
    all_ = conversations(turns).withColumn("key", F.sha2(F.to_json(F.element_at("turns", 1)), 256))
    best = all_.groupBy("key").agg(F.min_by(F.struct("conv_id", "turns"), F.struct(F.col("conv_id").isNull(), F.col("conv_id"))).alias("best"))
    rows = all_.join(best, "key").select("conv_id", F.col("best.conv_id").alias("chosen_id"), F.col("best.turns").alias("chosen"), F.col("turns").alias("rejected"))
    out = format_pairs(rows)
    first = F.col("conv_id").eqNullSafe(F.col("chosen_id"))
    status = F.when(first, "first").when(F.col("chosen") == F.col("rejected"), "same").otherwise("pair")
    names = ["n_prompt_turns", "prompt", "chosen_text", "rejected_text", "chosen_spans", "rejected_spans"]
    return out.select("conv_id", "chosen_id", status.alias("status"), *[F.when(~first, F.col(n)).alias(n) for n in names])
