"""Queries of the operators over whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import chat, compression, license_texts, licenses, minhash, mixing, pieces, projections, quality, sharding, suffix
from chronofold.llm.sql import SQL  # noqa: F401  read by the entry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op1_sentencepiece(spark, d):
    return pieces.tokenize(table(spark, d, "documents"))


@query
def op2_balanced_sharding(spark, d):
    return sharding.shard(table(spark, d, "documents"))


@query
def op3_preference_formatting(spark, d):
    out = chat.preferences(table(spark, d, "conversations"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumns({c: spans(c) for c in ("chosen_spans", "rejected_spans")})


@query
def op4_quality_rules(spark, d):
    return quality.judge(table(spark, d, "documents")).drop("class_distance", "word_distance")


@query
def op5_license_scan(spark, d):
    return licenses.scan(table(spark, d, "documents"), licenses.TEMPLATES | licenses.LINES | license_texts.TEXTS)


@query
def op6_temperature_mixing(spark, d):
    return mixing.mix(table(spark, d, "documents"))


@query
def op7_compression_classifier(spark, d):
    docs = table(spark, d, "documents")
    return compression.score(docs, compression.fit(compression.training_rows(docs, table(spark, d, "labels"))))


@query
def op8_minhash_near_dedup(spark, d):
    return minhash.near_duplicates(table(spark, d, "documents")).drop("text_key")


@query
def op9_suffix_array_dedup(spark, d):
    return suffix.remove_repeats(table(spark, d, "documents")).drop("kept_text", "text_key")


@query
def op10_embedding_near_dedup(spark, d):
    return projections.near_vectors(table(spark, d, "embeddings"))
