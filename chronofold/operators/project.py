"""Mappings as Column expressions: from envelope rows to keyed writes, no I/O, no fold."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions import jsonpath as J
from chronofold.operators.upcast import UpcasterRegistry
from chronofold.plans.mapping import DocumentMapping, EdgeMapping, KeyValueMapping, Mapping, NodeMapping, SqlMapping

PROJECTED = ["adapter_kind", "target", "entity_key", "facet", "operation", "mode", "permanent", "body", "ends", "projected_version", "unsupported", "build_error"]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def write_columns(m: Mapping, payload: Column, find: Callable[[str], Column]) -> dict[str, Column]:
    """Key, body, edge ends and build error of one mapping; ``find`` gives the value at a path.

    The body is JSON text: of the mapped columns for SQL, of the filled template for the other kinds.
    """
    leaves: list[Column] = []
    ends = F.lit(None).cast("string")
    if isinstance(m, SqlMapping):
        values = {c: find(p) for c, p in sorted(m.columns.items())}
        ids = [values[k] for k in m.primary_key]
        leaves = list(values.values())
        key = J.json_key(ids)
        body = F.to_json(F.call_function("named_struct", *[x for c, v in values.items() for x in (F.lit(c), v)]))
    else:
        if isinstance(m, EdgeMapping):
            ids = [find(p) for p in (m.from_, m.to, m.discriminator) if p is not None]
            texts = [J.text(x) for x in ids]
            key = F.to_json(F.array(F.lit(m.edge_type), *texts))
            ends = F.to_json(F.array(*texts[:2]))
            template = m.properties
        else:
            path = {DocumentMapping: "id", KeyValueMapping: "key", NodeMapping: "key"}[type(m)]
            template = {DocumentMapping: "document", KeyValueMapping: "value", NodeMapping: "properties"}[type(m)]
            ids, template = [find(getattr(m, path))], getattr(m, template)
            key = J.text(ids[0])
        body = F.to_json(J.template(template or {}, find, leaves))
    error = (
        F.when(payload.isNull(), F.lit("payload is no JSON object"))
        .when(_any([~J.is_scalar(x) for x in ids]), F.lit("identity is no scalar"))
        .when(_any([x.isNull() for x in leaves]), F.lit("a mapped field is missing"))
    )
    return {"entity_key": key, "body": F.when(F.lit(m.operation == "upsert"), body), "ends": ends, "build_error": error}


NAMES = ("target", "entity_key", "facet", "operation", "mode", "permanent", "body", "ends", "projected_version", "unsupported", "build_error")
TYPES = {"permanent": "boolean", "unsupported": "boolean", "projected_version": "int"}


def leaf_columns(leaves: dict[tuple[int, str], set[str]]) -> dict[str, Column]:
    """Columns of the payload's values that ``projection`` reads: each is taken from the payload once, whatever reads it."""
    own = lambda v, types: F.col("event_type").isin(sorted(types)) & (F.col("version") == v)
    return {_leaf(v, path): F.when(own(v, types), J.resolve(path, F.col("parsed"), F.col("metadata"))) for (v, path), types in leaves.items()}


def _leaf(version: int, path: str) -> str:
    return f"leaf_{version}_{path.encode().hex()}"


def _finder(event_type: str, m: Mapping, payload: Column, direct: bool, leaves: dict) -> Callable[[str], Column]:
    def find(path: str) -> Column:
        if not direct or not path.startswith("payload."):
            return J.resolve(path, payload, F.col("metadata"))
        leaves.setdefault((m.version, path), set()).add(event_type)
        return F.col(_leaf(m.version, path))

    return find


def projection(mappings: dict[str, Mapping], upcasters: UpcasterRegistry | None, leaves: dict[tuple[int, str], set[str]]) -> dict[str, Column]:
    """Columns of the write that an event makes by the mapping of its type: each is one CASE over the event types.

    Reads event_type, version, metadata, ``parsed`` (the payload as VARIANT) and the ``leaf_columns`` of ``leaves``, to which it adds what
    it needs. An event type without a mapping has null columns.
    """
    upcasters = upcasters or UpcasterRegistry()
    cases: dict[str, Column] = {}
    for event_type, m in mappings.items():
        here = F.col("event_type") == event_type
        payload, unsupported, why = upcasters.apply(event_type, F.col("version"), m.version, F.col("parsed"))
        own = write_columns(m, payload, _finder(event_type, m, payload, not upcasters.sources(event_type, m.version), leaves))
        own |= {
            "target": F.lit(m.target), "facet": F.lit(m.facet or ""), "operation": F.lit(m.operation), "mode": F.lit(m.mode), "permanent": F.lit(m.permanent),
            "projected_version": F.lit(m.version), "unsupported": unsupported, "build_error": F.when(unsupported, why).otherwise(own["build_error"]),
        }
        for n in NAMES:
            cases[n] = cases[n].when(here, own[n]) if n in cases else F.when(here, own[n])
    return {n: (cases[n] if n in cases else F.lit(None)).cast(TYPES.get(n, "string")) for n in NAMES}


def project(events: DataFrame, kind: str, mappings: dict[str, Mapping], upcasters: UpcasterRegistry | None = None) -> DataFrame:
    """Envelope rows of mapped event types with the PROJECTED columns added. ``events`` has ``parsed``."""
    here = F.col("event_type").isin(list(mappings)) if mappings else F.lit(False)
    leaves: dict[tuple[int, str], set[str]] = {}
    columns = projection(mappings, upcasters, leaves)
    at = leaf_columns(leaves)
    return events.where(here).withColumns(at).withColumns({"adapter_kind": F.lit(kind)} | columns).drop(*at)


def preview(events: DataFrame, kind: str, mappings: dict[str, Mapping], upcasters: UpcasterRegistry | None = None) -> DataFrame:
    """What would be written, without folding or writing."""
    return project(with_parsed(events), kind, mappings, upcasters).select("event_id", "event_type", "sequence", *[n for n in PROJECTED if n != "adapter_kind"])


def with_parsed(events: DataFrame) -> DataFrame:
    """The payload parsed once for all kinds."""
    return J.with_strict_json(events, F.col("payload"), "parsed", objects=True)


def node_or_edge(mappings: dict[str, Mapping]) -> tuple[dict[str, NodeMapping], dict[str, EdgeMapping]]:
    return ({k: m for k, m in mappings.items() if isinstance(m, NodeMapping)}, {k: m for k, m in mappings.items() if isinstance(m, EdgeMapping)})
