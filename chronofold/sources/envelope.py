"""Strict envelope parsing: JSON lines to typed event rows, the rest to rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions import jsonpath as J
from chronofold.model import ENVELOPE, SEQUENCE

U32 = (1 << 32) - 1


FIELDS = ("event_id", "event_type", "payload", "metadata", "sequence", "version")


def _kind(name: str) -> Column:
    return F.schema_of_variant(F.col(f"p.{name}"))


def split_envelopes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of rows (value, source_id, position, line_no, batch_id).

    Types are strict: payload is a JSON string, metadata an object of strings, sequence an unsigned
    integer; version may be missing (1). Unknown fields are ignored, blank lines skipped.
    """
    rows = J.with_strict_json(lines.where("trim(value) != ''"), F.col("value"), "v")
    v, text = F.col("v"), lambda name: F.try_variant_get(f"p.{name}", "$", "string")
    # each field is taken from the record once
    rows = rows.select("*", F.explode(F.array(F.struct(*[F.variant_get(v, f"$.{n}", "variant").alias(n) for n in FIELDS]))).alias("p"))
    seq, version = _kind("sequence"), _kind("version")
    entries = F.try_variant_get("p.metadata", "$", "map<string,variant>")
    big = F.try_variant_get("p.sequence", "$", "decimal(20,0)")
    reason = (
        F.when(v.isNull(), "not JSON")
        .when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object")
        .when(F.coalesce(_kind("event_id"), F.lit("")) != "STRING", "event_id is no string")
        .when(F.coalesce(_kind("event_type"), F.lit("")) != "STRING", "event_type is no string")
        .when(F.coalesce(_kind("payload"), F.lit("")) != "STRING", "payload is no string")
        .when(~F.coalesce(_kind("metadata").startswith("OBJECT"), F.lit(False)), "metadata is no object")
        .when(~F.forall(F.map_values(entries), lambda x: F.schema_of_variant(x) == "STRING"), "metadata has other values than strings")
        .when(F.col("p.sequence").isNull(), "sequence is missing")
        .when(~(((seq == "BIGINT") & (big >= 0)) | (seq.isin("DECIMAL(19,0)", "DECIMAL(20,0)") & (big > F.lit((1 << 63) - 1)) & (big < F.lit(str(1 << 64)).cast("decimal(20,0)")))), "sequence is no unsigned integer")
        .when(version.isNotNull() & ~((version == "BIGINT") & F.try_variant_get("p.version", "$", "bigint").between(0, U32)), "version is no unsigned integer")
    )
    rows = rows.withColumn("reason", F.coalesce(reason, F.when(big.isNull(), "sequence is no unsigned integer")))
    good = rows.where("reason is null").select(
        text("event_id").alias("event_id"),
        text("event_type").alias("event_type"),
        text("payload").alias("payload"),
        F.try_variant_get("p.metadata", "$", "map<string,string>").alias("metadata"),
        F.coalesce(F.try_variant_get("p.version", "$", "int"), F.lit(1)).alias("version"),
        big.cast(SEQUENCE).alias("sequence"),
        "source_id", "position", "line_no", "batch_id",
    )
    return good, rows.where("reason is not null").select(F.col("value").alias("raw"), "reason", "source_id", "position", "line_no")


def require_all(lines: DataFrame) -> DataFrame:
    """Events only; the first bad record fails the read."""
    good, bad = split_envelopes(lines)
    raised = bad.select(F.raise_error(F.concat(F.lit("bad event record: "), "reason", F.lit(" at "), "position")).cast("string").alias("event_id"))
    shape = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "event_id" else F.col("event_id") for f in ENVELOPE.fields]
    return good.unionByName(raised.select(*shape))


def decode_wire(frames: DataFrame) -> DataFrame:
    """Defaults of the wire form: version 0 is 1; an empty event_id is the position, else type-sequence."""
    name = F.coalesce(F.expr("nullif(event_id, '')"), F.expr("nullif(position, '')"), F.concat_ws("-", "event_type", F.col("sequence").cast("string")))
    return frames.withColumns({"event_id": name, "version": F.when(F.coalesce("version", F.lit(0)) == 0, 1).otherwise(F.col("version"))})
