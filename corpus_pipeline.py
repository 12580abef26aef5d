"""The corpus pipeline: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import minhash, mixing, pieces, quality, suffix
from chronofold.llm.common import Scratch, scratch_dropped

#: Jaccard similarity, in percent, from which texts are near copies. The 85 of op8 is the contract of that query alone.
NEAR = 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, in one pass over the texts: the verdict comes with the columns.

    Null and empty texts fail the base rules and go; a null id or language stays as it is; repeated rows are judged each for itself;
    other columns than those of documents go; an empty table gives no rows.
    """
    return quality.judge(docs, carry=COLUMNS).where("kept").select(*[F.col(f"carry_{c}").alias(c) for c in COLUMNS])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (of repeated rows of it, one).

    Rows are told apart by id and text, so that two texts under one id are judged each for itself. Null and empty texts link
    with nothing and stay; a null id is never the smallest; other columns go; an empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    rows = minhash.near_duplicates(docs, percent=NEAR).groupBy("doc_id", "text_key").agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    out = Scratch(spark).cut(rows.where("not kept or n > 1").select(F.col("doc_id").alias("near_id"), F.col("text_key").alias("near_key"), "kept"))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("near_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("near_key"))
    rest, again = docs.join(out, on, "left_anti").select(*COLUMNS), out.where("kept")
    if not again.limit(1).count():
        return rest
    once = docs.join(again, on).dropDuplicates(["near_id", "near_key"])
    return rest.unionByName(once.select(*COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that occur earlier in the corpus; n_chars is of what is left.

    Every row comes out with its own text: rows are told apart by id and text, null ids are cut as well. A null or empty
    text stays as it is, repeated rows lose the same spans, other columns go; an empty table gives no rows.
    """
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    out = suffix.remove_repeats(docs, carry=rest)
    cut = F.col("n_removed") > 0
    left = {c: F.col(f"carry_{c}").alias(c) for c in rest}
    left["n_chars"] = F.when(cut, F.length("kept_text")).otherwise(F.col("carry_n_chars")).cast("long").alias("n_chars")
    return out.select("doc_id", F.col("kept_text").alias("text"), *[left[c] for c in rest])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of light sources again as the mixture's weights ask.

    A null source is a source of its own, null and empty texts take a place, repeated rows are documents of their own; other
    columns go; an empty table gives no rows.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row: none for a null or empty text, null ids stay null, repeated rows are encoded each for itself; an empty
    table gives no rows."""
    return pieces.tokenize(docs)


STAGES = [("quality_rules", quality_rules), ("minhash_near_dedup", near_dedup), ("suffix_array_dedup", suffix_dedup), ("mixing", mix_sources), ("sentencepiece", sentencepiece)]
#: No SQL for MinHash components, suffix arrays and piece merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents, each written as Parquet and read again by the next; the last one's rows.

    The scratch tables of a stage go when its rows are written, those rows when the next stage's are.

    Documents may have other columns and nulls anywhere; an empty table gives no rows.
    """
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch_dropped():  # what a stage keeps is written before its own tables go
            kept = scratch.cut(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
