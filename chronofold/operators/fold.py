"""Keyed ordered fold over projected writes.

``ordered_fold`` is exact for every mix of operations. Rows meet by (adapter, target, key) in one
shuffle, are sorted by arrival order in the JVM and stream through the state machine: a task holds
one entity's state, never its history, so an entity with a very long history costs time but no memory.

``latest_fold`` is the closed form for streams of replace upserts and non-permanent deletes: built-in
partial aggregation, so hot keys combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from chronofold.functions import jsonpath as J
from chronofold.model import FOLD_IN, FOLD_OUT
from chronofold.operators.decide import Entity

KEY = ["adapter_id", "target", "entity_key"]
#: Arrival order; ``rank`` puts the earlier state before the batch and node changes before edge writes of one instant.
ORDER = ["batch_id", "seq", "position", "line_no", "rank", "event_id"]
_IN = [x.split()[0] for x in FOLD_IN.split(", ")]
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
_OUT = pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in FOLD_OUT.split(", "))])
_OUT_NAMES = _OUT.names


#: Input columns that outcome rows carry along.
_CARRIED = [n for n in _OUT_NAMES if n in _IN]


def _values(column: pa.Array) -> list:
    """``to_pylist`` without an object of Arrow's for each value, which takes most of a fold's time."""
    if column.null_count == len(column):
        return [None] * len(column)
    if column.null_count and not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):  # numpy has no null of theirs
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def _fold_batches(batches: Iterator[pa.RecordBatch], instants: bool = False, only: str | None = None) -> Iterator[pa.RecordBatch]:
    schema = _OUT
    now: tuple | None = None
    entity, ends, touched, written = Entity(""), None, False, None
    states: list[dict] = []

    def close() -> None:
        if touched and only != "outcome":
            states.append(dict(zip(("adapter_id", "kind", "target", "entity_key"), now)) | {"row_type": "state", "live": entity.live, "body": entity.body, "lanes": entity.lanes_json(), "ends": ends, "reason": entity.ends_json()})

    used = ["adapter_id", "kind", "target", "entity_key", "seq", "event_id", "facet", "operation", "mode", "permanent", "body", "ends", "aux", "batch_id"]
    for batch in batches:
        at, outcome, reason, live = [], [], [], []
        for i, (adapter, kind, target, key, seq, eid, facet, op, mode, permanent, body, own_ends, aux, instant) in enumerate(zip(*[_values(batch.column(n)) for n in used])):
            if now is None or key != now[3] or target != now[2] or adapter != now[0] or kind != now[1]:
                close()
                now, entity, ends, touched, written = (adapter, kind, target, key), Entity(kind), None, False, None
            ends = own_ends or ends
            if op == "seed":
                entity.load(facet, body, aux)
                touched = True
            elif op == "node":  # alone it gives no state: the edge has no writes of its own
                label, _, node = aux.partition("\x1f")
                entity.node_changed(label, node, mode == "dead", seq, eid, permanent, spare=instants and written == instant)
            else:
                x, why = entity.step(op, mode, facet, seq, eid, permanent, body)
                touched = True
                if x in ("created", "updated"):
                    written = instant
                at.append(i)
                outcome.append(x)
                reason.append(why)
                live.append(entity.live)
        if at and only != "state":
            got = batch if len(at) == batch.num_rows else batch.take(pa.array(at))
            own = {"row_type": pa.array(["outcome"] * len(at)), "outcome": pa.array(outcome), "reason": pa.array(reason, pa.string()), "live": pa.array(live)}
            yield pa.RecordBatch.from_arrays([got.column(f.name).cast(f.type) if f.name in _CARRIED and f.name != "body" else own.get(f.name, pa.nulls(len(at), f.type)) for f in schema], schema=schema)
        if states:
            yield pa.RecordBatch.from_pylist(states, schema=schema)
            states.clear()
    close()
    if states:
        yield pa.RecordBatch.from_pylist(states, schema=schema)


def ordered_fold(rows: DataFrame, instants: bool = False, only: str | None = None) -> DataFrame:
    """FOLD_IN rows to FOLD_OUT rows: one ``outcome`` per event and one ``state`` per entity; ``only`` one of the two.

    Entities without writes give no rows. ``seq`` is the sequence less 2^63. ``instants``: what has one batch_id happens at once, so a
    node change neither stops nor deletes an edge that is written in its own batch; later batches see it.
    """
    order = [ORDER[0], F.when(F.col("rank") == 0, 0).when(F.col("rank") == 2, 1).otherwise(2), *ORDER[1:]] if instants else ORDER
    dealt = rows.select(*_IN).repartition(*KEY)
    # a hash first: keys are compared as numbers and not as names that all share
    dealt = dealt.sortWithinPartitions(F.xxhash64(*KEY), *KEY, *order)
    return dealt.mapInArrow(lambda it: _fold_batches(it, instants, only), FOLD_OUT)


def fold_input(projected: DataFrame) -> DataFrame:
    """Projected envelope rows (with adapter_id) as FOLD_IN rows. Rows with a build error are left out."""
    return projected.where(F.col("build_error").isNull()).select(
        "adapter_id",
        F.col("fold_kind").alias("kind"),
        "target",
        "entity_key",
        F.lit(2).alias("rank"),
        F.coalesce("batch_id", F.lit(0).cast("long")).alias("batch_id"),
        J.sequence_to_long(F.col("sequence")).alias("seq"),
        "position",
        "line_no",
        "event_id",
        "facet",
        "operation",
        "mode",
        "permanent",
        "body",
        "ends",
        F.lit(None).cast("string").alias("aux"),
        "event_type",
        "adapter_order",
        F.col("version").alias("source_version"),
        "projected_version",
    )


def _no_info() -> list:
    return [F.lit(None).cast(t).alias(n) for n, t in (("event_type", "string"), ("adapter_order", "int"), ("source_version", "int"), ("projected_version", "int"))]


def seeds(state: DataFrame) -> DataFrame:
    """Earlier state rows as FOLD_IN rows that come before every event."""
    null = F.lit(None).cast("string")
    return state.select(
        "adapter_id", "kind", "target", "entity_key", F.lit(0).alias("rank"), F.lit(-1).cast("long").alias("batch_id"), F.lit(-(1 << 63)).cast("long").alias("seq"),
        F.lit("").alias("position"), F.lit(0).cast("long").alias("line_no"), F.lit("").alias("event_id"), F.col("lanes").alias("facet"), F.lit("seed").alias("operation"), null.alias("mode"),
        F.lit(False).alias("permanent"), "body", "ends", F.col("reason").alias("aux"), *_no_info(),
    )


def states(folded: DataFrame) -> DataFrame:
    """``reason`` holds the dead ends of an edge, as JSON."""
    return folded.where("row_type = 'state'").select("adapter_id", "kind", "target", "entity_key", "live", "body", "lanes", "ends", "reason")


def guards(state: DataFrame) -> DataFrame:
    """One row per lane: target, key, facet, last sequence and event, deleted, permanent."""
    lanes = F.from_json("lanes", "map<string,array<string>>")
    return state.select("adapter_id", "target", "entity_key", F.explode(lanes).alias("facet", "lane")).select(
        "adapter_id", "target", "entity_key", "facet",
        J.long_to_sequence(F.col("lane")[0].cast("long")).alias("last_sequence"), F.col("lane")[1].alias("last_event_id"),
        F.col("lane")[2].cast("boolean").alias("deleted"), F.col("lane")[3].cast("boolean").alias("permanent"),
    )


def latest_fold(writes: DataFrame) -> DataFrame:
    """Closed form: the highest sequence per key counts, the earliest arrival among equals; live if it is an upsert.

    Valid where every upsert is ``replace``, no delete is permanent and there are no facets. Needs
    adapter_id, target, entity_key, seq, batch_id, position, line_no, event_id, operation, body.
    """
    # the highest sequence first, then the earliest arrival: one partial aggregation. Grouped by a hash first, rows are sorted by a
    # number and not by names that all share
    first = F.struct(F.bitwise_not("seq").alias("s"), "batch_id", "position", "line_no", "event_id", "operation", "body")
    top = writes.groupBy(F.xxhash64(*KEY), *KEY).agg(F.min(first).alias("w"), F.count("*").alias("n_events"))
    return top.select(*KEY, J.long_to_sequence(F.bitwise_not("w.s")).alias("last_sequence"), F.col("w.event_id").alias("last_event_id"), (F.col("w.operation") == "delete").alias("deleted"), F.when(F.col("w.operation") == "upsert", F.col("w.body")).alias("body"), "n_events")


def replace_fold(rows: DataFrame) -> DataFrame:
    """The ordered fold of targets of which ``closed_form`` says ``latest``, without seeds, by window functions.

    An event counts if its sequence is over all that came before it at the key; what it finds is the event that had the highest
    one, the earliest among equals. Gives the rows that ``ordered_fold`` gives.
    """
    w = Window.partitionBy(*KEY, "kind").orderBy(*ORDER)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    dealt = rows.select(*_IN).withColumn("at", F.row_number().over(w))
    mark = F.struct("seq", (-F.col("at")).alias("early"), (F.col("operation") == "delete").alias("dead"))
    seen = dealt.withColumn("top", F.max(mark).over(before)).withColumn("newer", F.col("top").isNull() | (F.col("seq") > F.col("top.seq")))
    delete, dead = F.col("operation") == "delete", F.coalesce(F.col("top.dead"), F.lit(True))
    first = F.col("top").isNull()
    # one level of constants: a filter on what can't come (failures) leaves no fold to run
    outcome = F.when(~F.col("newer"), "skipped").when(delete & (first | ~dead), "deleted").when(delete, "skipped").when(dead, "created").otherwise("updated")
    reason = F.when(~F.col("newer"), "stale_sequence").when(delete & ~first & dead, "already_deleted")
    null = {f.name: F.lit(None).cast(f.dataType) for f in DataType.fromDDL(FOLD_OUT).fields}
    shown = seen.withColumns({"row_type": F.lit("outcome"), "outcome": outcome, "reason": reason, "live": F.when(F.col("newer"), ~delete).otherwise(~dead)})
    events = shown.select(*[F.col(n) if n in ("row_type", "outcome", "reason", "live") or (n in _CARRIED and n != "body") else null[n].alias(n) for n in _OUT_NAMES])
    # a delete of what is deleted renews sequence and event, as the fold does
    last = seen.where("newer").groupBy(*KEY, "kind").agg(F.max_by(F.struct("seq", "event_id", "body", "ends", delete.alias("dead")), "at").alias("w"))
    lane = F.concat(F.lit('{"":['), F.col("w.seq").cast("string"), F.lit(","), F.expr("substr(to_json(array(w.event_id)), 2, length(to_json(array(w.event_id))) - 2)"), F.lit(","), F.col("w.dead").cast("string"), F.lit(",false]}"))
    have = {"row_type": F.lit("state"), "live": ~F.col("w.dead"), "body": F.when(~F.col("w.dead"), F.col("w.body")), "lanes": lane, "ends": F.col("w.ends")} | {k: F.col(k) for k in (*KEY, "kind")}
    return events.unionByName(last.select(*[have.get(n, null[n]).alias(n) for n in _OUT_NAMES]))


def first_fold(writes: DataFrame) -> DataFrame:
    """Closed form for ``ignore`` upserts without deletes: the earliest arrival per key stays."""
    arrival = F.struct("batch_id", "seq", "position", "line_no", "event_id")
    return writes.groupBy(*KEY).agg(F.min_by(F.struct("event_id", "seq", "body"), arrival).alias("w")).select(*KEY, J.long_to_sequence(F.col("w.seq")).alias("last_sequence"), F.col("w.event_id").alias("last_event_id"), F.lit(False).alias("deleted"), F.col("w.body").alias("body"))


def closed_form(mappings) -> str | None:
    """Which closed form fits a set of mappings of one target: ``latest``, ``first`` or none."""
    ms = list(mappings)
    if any(m.facet or m.permanent for m in ms):
        return None
    ups = [m for m in ms if m.operation == "upsert"]
    if all(m.on_existing == "replace" for m in ups):
        return "latest"
    if len(ups) == len(ms) and all(m.on_existing == "ignore" for m in ups):
        return "first"
    return None
