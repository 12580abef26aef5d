"""Envelope, vocabularies and the schemas that modules exchange."""

from __future__ import annotations

from pyspark.sql import types as T

# Closed vocabularies of the projection model.
OPERATIONS = ("upsert", "delete")
ON_EXISTING = ("ignore", "replace")
SKIP_REASONS = ("already_projected", "stale_sequence", "unsupported_version", "already_deleted", "tombstoned", "entity_absent")
ADAPTER_ERRORS = ("write_failed", "unsupported_version")
OUTCOMES = ("created", "updated", "deleted", "skipped", "failed")
CAPABILITIES = ("write", "idempotent", "upsert", "transactions", "delete")
FAILURE_POLICIES = ("fail_fast", "continue_on_error")
MIGRATION_POLICIES = ("strict", "ignore_unmatched")
STOPPED_REASONS = ("caught_up", "shutdown", "retry_exhausted")
KINDS = ("sql", "document", "keyvalue", "graph", "custom")
#: Adapter type -> kind.
ADAPTER_KINDS = {"sqlite": "sql", "postgres": "sql", "mysql": "sql", "file": "document", "mongodb": "document", "keyvalue": "keyvalue", "redis": "keyvalue", "graph": "graph", "neo4j": "graph"}

SEQUENCE = T.DecimalType(20, 0)
ENVELOPE = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("version", T.IntegerType()),
    T.StructField("sequence", SEQUENCE),
    T.StructField("source_id", T.StringType()),
    T.StructField("position", T.StringType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("batch_id", T.LongType()),
])
REJECT = "raw string, reason string, source_id string, position string, line_no long"

#: Offset that maps an unsigned 64-bit sequence onto an order-preserving signed long.
SEQ_OFFSET = 1 << 63

FOLD_IN = (
    "adapter_id string, kind string, target string, entity_key string, rank int, batch_id long, seq long, position string, line_no long, "
    "event_id string, facet string, operation string, mode string, permanent boolean, body string, ends string, aux string, "
    "event_type string, adapter_order int, source_version int, projected_version int"
)
FOLD_OUT = (
    "row_type string, adapter_id string, kind string, target string, entity_key string, batch_id long, seq long, position string, line_no long, "
    "event_id string, facet string, permanent boolean, ends string, event_type string, adapter_order int, source_version int, projected_version int, "
    "outcome string, reason string, live boolean, body string, lanes string"
)
