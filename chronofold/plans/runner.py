"""Projector: applies event batches to a project and reports what happened."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import jsonpath as J
from chronofold.model import OUTCOMES, SKIP_REASONS
from chronofold.operators import fold, graph
from chronofold.operators.project import leaf_columns, node_or_edge, projection, with_parsed
from chronofold.operators.upcast import UpcasterRegistry
from chronofold.plans.config import Project, SourceConfig
from chronofold.plans.order import execution_order, explain
from chronofold.plans.validate import validate
from chronofold.sinks.registry import default_registry
from chronofold.sinks.store import FailedSink, SinkRegistry, SnapshotStore, dead_letters, write_dead_letters
from chronofold.sources.checkpoint import Checkpoint
from chronofold.sources.files import MAX_BATCH, StdinLines, directory_batch, from_rows, replay_events

OUTCOME = ["event_id", "event_type", "sequence", "batch_id", "position", "line_no", "adapter_id", "kind", "adapter_order", "target", "entity_key", "facet", "outcome", "reason", "error", "source_version", "projected_version"]
_EVENT = ["batch_id", "sequence", "position", "line_no", "event_id"]


class RetryExhausted(RuntimeError):
    """A sink kept failing; the batch is not committed."""


class FailingEvents(RuntimeError):
    """A batch has failing events and may have none; nothing of it is written."""


@dataclass
class Applied:
    """Lazy results of a batch: outcomes per event and adapter, touched states, unrouted events."""

    outcomes: DataFrame
    state: DataFrame
    unrouted: DataFrame

    @property
    def guards(self) -> DataFrame:
        return fold.guards(self.state)


def event_report(outcomes: DataFrame) -> DataFrame:
    """Per delivered event: failed if any adapter failed. An event that was delivered again has a row of its own."""
    place = ["batch_id", F.coalesce("position", F.lit("")).alias("position"), F.coalesce("line_no", F.lit(0).cast("long")).alias("line_no")]
    return outcomes.groupBy("event_id", "sequence", *place).agg(F.max(F.col("outcome") == "failed").alias("failed"), F.count("*").alias("n_adapters")).select("event_id", "sequence", "batch_id", "position", "line_no", "n_adapters", F.when(F.col("failed"), "failed").otherwise("succeeded").alias("status"))


def counters(outcomes: DataFrame, *by: str) -> DataFrame:
    """created, updated, deleted, skipped, failed and each skip reason, by the columns given."""
    return outcomes.groupBy(*by).agg(
        *[F.count_if(F.col("outcome") == x).alias(x) for x in ("created", "updated", "deleted", "skipped", "failed")],
        *[F.count_if(F.col("reason") == x).alias(x) for x in SKIP_REASONS],
    )


def route_column(routes: dict[str, list[tuple]], event_type: Column) -> Column:
    """Array of (adapter_id, kind, adapter_order) of an event type, as a literal map lookup."""
    if not routes:
        return F.lit(None).cast("array<struct<adapter_id:string,kind:string,adapter_order:int>>")
    parts: list[Column] = []
    for e, adapters in routes.items():
        rows = F.array(*[F.struct(F.lit(a).alias("adapter_id"), F.lit(k).alias("kind"), F.lit(i).alias("adapter_order")) for a, k, i in adapters])
        parts += [F.lit(e), rows.cast("array<struct<adapter_id:string,kind:string,adapter_order:int>>")]
    return F.element_at(F.create_map(*parts), event_type)


class Projector:
    """A validated project bound to a session. Mappings are values: it can run any number of times."""

    def __init__(self, spark: SparkSession, project: Project, upcasters: UpcasterRegistry | None = None, registry: SinkRegistry | None = None, check: bool = True):
        if check:
            validate(project.config, project.routes, project.mappings)
        self.spark, self.project, self.upcasters, self.registry = spark, project, upcasters or UpcasterRegistry(), registry or SinkRegistry()
        self.adapters = {a.id: a for a in project.config.adapters}
        opaque = lambda a: "opaque" if a.kind == "custom" and self.registry.known(a.type) else a.kind  # noqa: E731  registered without a kind: no mappings
        self.broken: dict[str, str] = {}
        self._columns: dict[str, Column] = {}
        self._leaves: dict[str, Column] = {}
        self.routes = {e: [(x, opaque(self.adapters[x]), i) for i, x in enumerate(execution_order(r, self.adapters))] for e, r in project.routes.items()}

    def explain(self, event_type: str) -> dict:
        return explain(event_type, self.project.routes, self.adapters)

    def _writes(self) -> dict[str, Column]:
        """Kind -> struct of the write that an event makes there. Built once: mappings are values, and a loop projects batch after batch."""
        if self._columns:
            return self._columns
        ignored = F.lit(self.project.config.migration_policy == "ignore_unmatched")
        kinds = sorted({k for r in self.routes.values() for _, k, _ in r} - {"opaque"})
        writes: dict[str, Column] = {}
        leaves: dict[tuple[int, str], set[str]] = {}
        for kind in kinds:
            own = self.project.mappings.of(kind) if kind != "custom" else {}
            cols = projection(own, self.upcasters, leaves)
            mapped = F.col("event_type").isin(list(own)) if own else F.lit(False)
            # adapters of kinds that nobody mapped, and custom ones without a kind, fail
            cols["build_error"] = F.when(~mapped, "no mapping for the event type" if kind != "custom" else "UnregisteredAdapterType").otherwise(cols["build_error"])
            cols["fold_kind"] = F.lit(kind)
            if kind == "graph":
                nodes, edges = node_or_edge(own)
                cols["fold_kind"] = F.when(F.col("event_type").isin(list(edges)) if edges else F.lit(False), "edge").otherwise(F.lit("node") if nodes or edges else F.lit("graph"))
            failed = cols["build_error"].isNotNull() & ~(F.coalesce(cols["unsupported"], F.lit(False)) & ignored)
            writes[kind] = F.struct(F.lit(kind).alias("adapter_kind"), *[c.alias(n) for n, c in cols.items()], failed.alias("failed"))
        if not writes:
            writes["custom"] = F.struct(F.lit("custom").alias("adapter_kind"), *[c.alias(n) for n, c in projection({}, None, {}).items()], F.lit("custom").alias("fold_kind"), F.lit(False).alias("failed"))
        self._columns, self._leaves = writes, leaf_columns(leaves)
        return writes

    def projected(self, events: DataFrame) -> DataFrame:
        """One row per event and routed adapter, with writes, build errors and pre-fold failures. One scan: all kinds are projected on one row."""
        events = events.withColumns({"position": F.coalesce("position", F.lit("")), "line_no": F.coalesce("line_no", F.lit(0).cast("long")), "batch_id": F.coalesce("batch_id", F.lit(0).cast("long"))})
        routed = with_parsed(events.withColumn("route", route_column(self.routes, F.col("event_type"))).where(F.size("route") > 0))
        writes = self._writes()
        has = lambda kind: F.col("event_type").isin([e for e, r in self.routes.items() if any(k == kind for _, k, _ in r)])
        out = routed.withColumns(self._leaves).withColumns({f"w_{k}": F.when(has(k), w) for k, w in writes.items()})
        out = out.select("*", F.explode("route").alias("r"))
        if self.project.config.failure_policy == "fail_fast" and any(len(r) > 1 for r in self.routes.values()):
            # after the explode: what a row's writes came to is read, not worked out again
            fails = lambda a, k: F.lit(True) if a in self.broken else F.col(f"w_{k}.failed") if k in writes else F.lit(False)
            stop = F.when(F.lit(False), 0)
            for e, r in self.routes.items():
                if r:
                    stop = stop.when(F.col("event_type") == e, F.coalesce(*[F.when(fails(a, k), i) for a, k, i in r]))
            out = out.where(stop.isNull() | (F.col("r.adapter_order") <= stop))
        chosen = F.coalesce(*[F.when(F.col("r.kind") == k, F.col(f"w_{k}")) for k in writes])
        out = out.select(*events.columns, F.col("r.adapter_id").alias("adapter_id"), F.col("r.adapter_order").alias("adapter_order"), chosen.alias("w")).where("w is not null").select("*", "w.*").drop("w", "payload", "metadata")
        for name, why in self.broken.items():
            here = F.col("adapter_id") == name
            out = out.withColumns({"build_error": F.when(here, why).otherwise(F.col("build_error")), "failed": here | F.col("failed"), "unsupported": ~here & F.col("unsupported")})
        return out

    def _closed(self) -> list[tuple[str, str]]:
        """(kind, target) of which the window form holds."""
        by: dict[tuple[str, str], list] = {}
        for kind in ("sql", "document", "keyvalue"):
            for m in self.project.mappings.of(kind).values():
                by.setdefault((kind, m.target), []).append(m)
        return [k for k, ms in by.items() if fold.closed_form(ms) == "latest"]

    def _may_fail_late(self) -> list[str]:
        """Adapters, in execution order, where a facet may meet a body that is no object: only the fold finds that out."""
        risky = set()
        for kind, name in (("document", "document"), ("keyvalue", "value"), ("graph", "properties")):
            own = self.project.mappings.of(kind)
            for target in {m.target for m in own.values() if m.facet}:
                if any(not isinstance(getattr(m, name, None) or {}, dict) for m in own.values() if m.target == target and m.operation == "upsert"):
                    risky.add(kind)
        order: dict[str, int] = {}
        for r in self.routes.values():
            for a, k, i in r:
                if k in risky:
                    order[a] = max(order.get(a, 0), i)
        return sorted(order, key=lambda a: (order[a], a))

    def apply(self, events: DataFrame, earlier: DataFrame | None = None, stop_early: bool = False, rows: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] | None = None, instants: bool = False) -> Applied:
        """Fold a batch onto earlier state. ``stop_early``: nothing after the first failing event in order. ``rows``: the projected events. ``keep`` stores the folded rows, which outcomes and states are then read from; without it each has a fold of its own, that gives no more than it needs. ``instants``: nodes and edges of one batch_id do not see each other."""
        rows = self.projected(events) if rows is None else rows
        fast = self.project.config.failure_policy == "fail_fast"
        order = F.struct("batch_id", "sequence", "position", "line_no")
        seeds = None if earlier is None else fold.seeds(earlier)
        if fast:
            # what fails in the fold stops later adapters, and a replay, as what fails before it does
            for name in self._may_fail_late():
                own = fold.fold_input(rows.where(F.col("adapter_id") == name))
                own = own if seeds is None else own.unionByName(seeds.where(F.col("adapter_id") == name))
                parts = self._folded(own, earlier, instants, "outcome")
                late = parts.where("row_type = 'outcome' and outcome = 'failed'").select("event_id", "batch_id", J.long_to_sequence(F.col("seq")).alias("sequence"), "position", "line_no", F.col("adapter_order").alias("stop_"))
                late = late.groupBy(*_EVENT).agg(F.min("stop_").alias("stop_"))
                if stop_early:
                    cut = late.agg(F.min(order).alias("cut"))
                    rows = rows.crossJoin(F.broadcast(cut)).where(F.col("cut").isNull() | (order <= F.col("cut"))).drop("cut")  # one row
                # it stops at its own place or later: rows up to there can't be cut and are not joined
                place = min(i for r in self.routes.values() for a, _, i in r if a == name)
                after = rows.where(F.col("adapter_order") > place).join(late, _EVENT, "left").where(F.col("stop_").isNull() | (F.col("adapter_order") <= F.col("stop_"))).drop("stop_")
                rows = rows.where(F.col("adapter_order") <= place).unionByName(after)
        if stop_early and fast:
            cut = rows.where("failed").agg(F.min(order).alias("cut"))
            rows = rows.crossJoin(F.broadcast(cut)).where(F.col("cut").isNull() | (order <= F.col("cut"))).drop("cut")  # one row
        writes = fold.fold_input(rows)
        writes = writes if seeds is None else writes.unionByName(seeds)
        events_of, states_of = [keep(self._folded(writes, earlier, instants))] * 2 if keep else [self._folded(writes, earlier, instants, x) for x in ("outcome", "state")]
        shown = F.when(F.col("kind").isin("node", "edge"), "graph").otherwise(F.col("kind"))
        late = events_of.where("row_type = 'outcome'").withColumns({"sequence": J.long_to_sequence(F.col("seq")), "kind": shown, "error": F.when(F.col("outcome") == "failed", "facet body or existing body is no object")})
        unsupported, ignored = F.coalesce("unsupported", F.lit(False)), F.lit(self.project.config.migration_policy == "ignore_unmatched")
        early = rows.where("build_error is not null").withColumns({
            "kind": F.col("adapter_kind"), "source_version": F.col("version"), "error": F.col("build_error"),
            "outcome": F.when(unsupported & ignored, "skipped").otherwise("failed"), "reason": F.when(unsupported, "unsupported_version").otherwise("write_failed"),
        })
        outcomes = early.select(*OUTCOME).unionByName(late.select(*OUTCOME))
        routed = F.coalesce(F.size(route_column(self.routes, F.col("event_type"))), F.lit(0))
        return Applied(outcomes, fold.states(states_of), events.where(routed <= 0))

    def _folded(self, writes: DataFrame, earlier: DataFrame | None, instants: bool = False, only: str | None = None) -> DataFrame:
        """FOLD_OUT rows of FOLD_IN rows, seeds included: closed forms by windows where there is no earlier state, the rest by the ordered fold."""
        present = {k for r in self.routes.values() for _, k, _ in r}
        plain = sorted(present & {"sql", "document", "keyvalue"})
        folded = []
        if plain:
            closed = [k for k in self._closed() if k[0] in plain] if earlier is None else []
            mine = writes.where(F.col("kind").isin(plain))
            all_closed = closed and set(closed) >= {(k, m.target) for k in plain for m in self.project.mappings.of(k).values()}
            if closed:
                here = F.concat_ws("\x1f", "kind", "target").isin([f"{k}\x1f{t}" for k, t in closed])
                folded.append(fold.replace_fold(mine if all_closed else mine.where(here)))
                mine = mine.where(~here)
            if not all_closed:
                folded.append(fold.ordered_fold(mine, only=only))
        if "graph" in present:
            folded += graph.fold_graph(writes.where("kind = 'node'"), writes.where("kind = 'edge'"), earlier, instants)
        if not folded:
            folded.append(fold.ordered_fold(writes.where(F.lit(False))))
        both = folded[0]
        for f in folded[1:]:
            both = both.unionByName(f)
        return both

    def replay(self, events: DataFrame | str, validate_routing: bool = False) -> Applied:
        """The whole input in sequence order, ties by arrival; with fail_fast it stops after the first failing event."""
        events = replay_events(self.spark, events) if isinstance(events, str) else events
        out = self.apply(events.withColumn("batch_id", F.lit(0).cast("long")), stop_early=True)
        if validate_routing:
            none = F.lit(None)
            lost = out.unrouted.select("event_id", "event_type", "sequence", "batch_id", "position", "line_no", F.lit("routing").alias("adapter_id"), F.lit("custom").alias("kind"), F.lit(0).alias("adapter_order"), *[none.cast("string").alias(n) for n in ("target", "entity_key", "facet")], F.lit("failed").alias("outcome"), F.lit("write_failed").alias("reason"), F.lit("event type is not routed").alias("error"), F.col("version").alias("source_version"), none.cast("int").alias("projected_version"))
            out.outcomes = out.outcomes.unionByName(lost)
        return out

    def run_once(self, event: dict | DataFrame, store: SnapshotStore) -> DataFrame:
        """One event onto the store; returns its outcomes."""
        events = event if isinstance(event, DataFrame) else from_rows(self.spark, [event])
        return self.commit(events, store, store.last_batch() + 1)

    def dry_run_once(self, event: dict | DataFrame, store: SnapshotStore | None = None) -> DataFrame:
        """The outcomes that run_once would give. Writes nothing."""
        events = event if isinstance(event, DataFrame) else from_rows(self.spark, [event])
        rows = self.projected(events)
        return self.apply(events, None if store is None else store.relevant(fold.fold_input(rows)), rows=rows).outcomes

    def commit(self, events: DataFrame, store: SnapshotStore, batch_id: int, sinks: dict[str, object] | None = None, dlq: str | None = None, source: str = "run", retries: int = 0, batch: dict | None = None, ordered: bool = False, strict: bool = False) -> DataFrame:
        """Fold a batch onto the store, hand the touched entities to the sinks and publish; a batch id of the source that is already
        there changes nothing and writes no sink.

        Only what raises in a sink is tried again, ``retries`` times, and ends in RetryExhausted; build failures are outcomes. ``ordered``:
        events keep their batch_id as their order of arrival. ``strict``: FailingEvents if an event fails before the fold. Projected and folded
        rows are written once to a scratch folder of the store (``batch["scratch"]``), so no later step parses or folds again.
        """
        batch = {} if batch is None else batch
        if not ordered:
            events = events.withColumn("batch_id", F.lit(batch_id).cast("long"))
        batch["scratch"] = scratch = store.scratch()
        held = []
        try:
            rows = self._kept(self.projected(events), f"{scratch}/rows")
            if strict and rows.where("failed").limit(1).count():
                raise FailingEvents(source)
            earlier = store.relevant(fold.fold_input(rows))
            out = self.apply(events, earlier, rows=rows, keep=lambda df: self._kept(df, f"{scratch}/folded"))
            outcomes = out.outcomes
            row = counters(outcomes).first()
            batch |= {k: row[k] for k in OUTCOMES}
            if batch_id <= store.last_batch(source):
                return outcomes
            state = out.state
            if sinks:
                held.append(state.persist(StorageLevel.MEMORY_AND_DISK))
            for name, sink in (sinks or {}).items():
                own = state.where(F.col("adapter_id") == name)
                for attempt in range(retries + 1):
                    try:
                        if own.limit(1).count():
                            sink.apply(own, batch_id)
                        break
                    except Exception as e:  # noqa: BLE001  sinks of others may raise anything
                        batch["retries"] = batch.get("retries", 0) + 1
                        if attempt == retries:
                            raise RetryExhausted(f"{name}: {e}") from e
            if dlq and batch["failed"]:
                write_dead_letters(dead_letters(events, outcomes), dlq, f"{J.file_safe(source)}/{batch_id}")
            store.apply(state, batch_id, source)
            return outcomes
        finally:
            for df in held:
                df.unpersist()

    def _kept(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def build_sinks(self, root: str | None = None) -> dict[str, object]:
        """A sink per adapter of the config that has one that works: those of ``default_registry`` and of the projector's own registry, which wins."""
        registry = default_registry(self.spark, self.project, root).update(self.registry)
        sinks = {a.id: registry.build(a) for a in self.project.config.adapters}
        # events fail at an adapter without a working sink
        self.broken = {name: s.why for name, s in sinks.items() if isinstance(s, FailedSink)}
        return {name: s for name, s in sinks.items() if name not in self.broken}

    def run_sources(self, store: SnapshotStore, state_dir: str, dlq: str | None = None, max_batch: int = MAX_BATCH, retries: int = 3, continuous: bool = False, interval: float = 1.0, stop: Callable[[], bool] = lambda: False, sinks: dict[str, object] | None = None, stdin: Iterable[str] | None = None) -> dict:
        """Round robin over the configured sources: poll, fold, publish, commit the last position.

        Without a DLQ a batch with a failing event or a malformed line halts the run, uncommitted and without a write: nothing is lost.
        With one they go there first. Sinks that raise are tried again; then the run halts.
        """
        report = {"batches": [], "stopped": "caught_up", "halt_position": None}
        polls = {s.id: self._poll(s, stdin) for s in self.project.config.sources if s.type in ("directory", "stdin")}
        while True:
            idle = True
            for s in self.project.config.sources:
                if s.id not in polls:
                    continue
                if stop():
                    return report | {"stopped": "shutdown"}
                mark = Checkpoint(s.state_dir or state_dir, s.id)
                events, rejects, end = polls[s.id](mark.position(), max_batch)
                if end is None:
                    continue
                idle = False
                batch = {"source_id": s.id, "position": end, "retries": 0, "committed": False, "dlq": 0}
                report["batches"].append(batch)
                n_rejects = rejects.count()
                if not dlq and n_rejects:
                    return report | {"stopped": "retry_exhausted", "halt_position": end}
                if n_rejects:
                    rejects.write.mode("overwrite").json(f"{dlq}/rejects/{J.file_safe(s.id)}/{J.file_safe(end)}")
                try:
                    outcomes = self.commit(events, store, store.last_batch(s.id) + 1, sinks, dlq, s.id, retries, batch, strict=not dlq)
                except FailingEvents:
                    store.drop(batch.pop("scratch"))
                    return report | {"stopped": "retry_exhausted", "halt_position": end}
                except RetryExhausted as e:
                    batch["error"] = str(e)
                    store.drop(batch.pop("scratch"))
                    return report | {"stopped": "retry_exhausted", "halt_position": end}
                batch["dlq"] = (event_report(outcomes).where("status = 'failed'").count() if dlq and batch["failed"] else 0) + n_rejects
                batch["committed"] = mark.commit(end)
                store.drop(batch.pop("scratch"))
            if idle and not continuous:
                return report
            if idle:
                time.sleep(interval)

    def _poll(self, s: SourceConfig, stdin: Iterable[str] | None) -> Callable[[str | None, int], tuple]:
        if s.type == "directory":
            return lambda at, n: directory_batch(self.spark, s.path, at, n, s.id)
        lines = StdinLines(stdin)
        return lambda at, n: lines.batch(self.spark, at, n, s.id)

    def list_sources(self, state_dir: str) -> list[tuple[str, str | None]]:
        return [(s.id, Checkpoint(s.state_dir or state_dir, s.id).position()) for s in self.project.config.sources]
