"""Structured Streaming: micro-batches onto the snapshot store, and a stateful fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from chronofold.functions import jsonpath as J
from chronofold.operators.decide import Entity
from chronofold.operators.fold import ORDER
from chronofold.plans.runner import FailingEvents, Projector
from chronofold.sinks.store import SnapshotStore
from chronofold.sources.envelope import split_envelopes
from chronofold.sources.files import numbered_stream

LIVE_IN = [*ORDER, "kind", "facet", "operation", "mode", "permanent", "body"]
LIVE_OUT = "adapter_id string, target string, entity_key string, event_id string, seq long, outcome string, reason string, live boolean, body string"


def run_stream(projector: Projector, path: str, store: SnapshotStore, checkpoint: str, once: bool = True, dlq: str | None = None, files_per_trigger: int = 100, sinks: dict | None = None, source_id: str = "stream", retries: int = 3) -> StreamingQuery:
    """Directory stream, in name order, into the store. The store skips a batch id that it has of this source, so a repeated micro-batch
    changes nothing. Without a DLQ a failing event or a malformed line stops the query before anything of its batch is written."""

    spark, failing = projector.spark, f"batch {{}} of {source_id} has failures and there is no dead-letter folder"

    def each(lines: DataFrame, batch_id: int) -> None:
        lines = lines.persist(StorageLevel.MEMORY_AND_DISK)
        batch: dict = {}
        try:
            events, rejects = split_envelopes(lines)
            bad = rejects.limit(1).count()
            if bad and not dlq:
                raise RuntimeError(failing.format(batch_id))
            if bad:
                rejects.write.mode("overwrite").json(f"{dlq}/rejects/{J.file_safe(source_id)}/{batch_id}")
            projector.commit(events, store, batch_id, sinks, dlq, source_id, retries, batch, ordered=True, strict=not dlq)
        except FailingEvents as e:
            raise RuntimeError(failing.format(batch_id)) from e
        finally:
            if "scratch" in batch:
                store.drop(batch["scratch"])
            lines.unpersist()

    lines = numbered_stream(projector.spark, path, files_per_trigger, source_id, 0 if once else files_per_trigger)
    out = lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="1 second")).start()


class FoldProcessor(StatefulProcessor):
    """One entity: its lanes and body in value state; no expiry, ordering is by sequence and not by time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("entity", "lanes string, body string, aux string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = [[] for _ in LIVE_IN]
        for part in rows:
            for have, name in zip(columns, LIVE_IN):
                have += part[name].tolist()
        events = sorted(zip(*columns), key=lambda r: r[: len(ORDER)])
        entity = Entity(events[0][len(ORDER)])
        if self.state.exists():
            entity.load(*self.state.get())
        out = []
        for _, seq, _, _, _, event_id, _, facet, operation, mode, permanent, body in events:
            outcome, reason = entity.step(operation, mode, facet or "", seq, event_id, bool(permanent), body)
            out.append((event_id, seq, outcome, reason, entity.live, entity.body))
        self.state.update((entity.lanes_json(), entity.body, entity.ends_json()))
        names = [x.split()[0] for x in LIVE_OUT.split(", ")]
        yield pd.DataFrame(dict(zip(names, key)) | dict(zip(names[3:], zip(*out))), columns=names)

    def close(self) -> None:
        pass


def stateful_fold(writes: DataFrame) -> DataFrame:
    """Streaming FOLD_IN rows (of ``numbered_stream`` envelopes) to one outcome row per event. Needs the RocksDB state store."""
    writes = writes.select("adapter_id", "target", "entity_key", *LIVE_IN)
    return writes.groupBy("adapter_id", "target", "entity_key").transformWithStateInPandas(FoldProcessor(), outputStructType=LIVE_OUT, outputMode="Append", timeMode="None")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
