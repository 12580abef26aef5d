"""Command line: run, replay, dry-run, sources, explain."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession

from chronofold.plans.config import SourceConfig, load_project
from chronofold.plans.runner import Projector, counters, event_report
from chronofold.sinks.store import SnapshotStore
from chronofold.sources.files import load_event


def _show(x: dict, form: str) -> None:
    print(json.dumps(x, default=str) if form == "json" else "\n".join(f"{k}: {v}" for k, v in x.items()))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="chronofold", description=__doc__)
    p.add_argument("verb", choices=("run", "replay", "dry-run", "sources", "explain"))
    p.add_argument("--config", required=True)
    p.add_argument("--mappings", required=True)
    p.add_argument("--routing")
    p.add_argument("--store")
    p.add_argument("--state-dir", default=".")
    p.add_argument("--event", help="a JSON file with one event")
    p.add_argument("--path", help="events to replay")
    p.add_argument("--event-type")
    p.add_argument("--dlq")
    p.add_argument("--once", action="store_true")
    p.add_argument("--stdin", action="store_true")
    p.add_argument("--max-batch", type=int, default=256)
    p.add_argument("--output", choices=("text", "json"), default="text")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("chronofold").getOrCreate()
    projector = Projector(spark, load_project(a.config, a.mappings, a.routing))
    if a.verb == "explain":
        _show(projector.explain(a.event_type), a.output)
        return 0
    if a.verb == "sources":
        _show(dict(projector.list_sources(a.state_dir)), a.output)
        return 0
    if a.verb == "replay":
        row = counters(projector.replay(a.path).outcomes).first().asDict()
        _show(row, a.output)
        return int(row["failed"] > 0)
    if a.verb == "dry-run":
        rows = projector.dry_run_once(load_event(spark, a.event), SnapshotStore(spark, a.store) if a.store else None).collect()
        _show({r.adapter_id: r.reason or r.outcome for r in rows}, a.output)
        return int(any(r.outcome == "failed" for r in rows))
    store = SnapshotStore(spark, a.store)
    Path(f"{a.store}/sinks").mkdir(parents=True, exist_ok=True)
    sinks = projector.build_sinks(f"{a.store}/sinks")
    if a.stdin:
        projector.project = replace(projector.project, config=replace(projector.project.config, sources=(SourceConfig("stdin", "stdin"),)))
    if a.event:
        outcomes = projector.commit(load_event(spark, a.event), store, store.last_batch() + 1, sinks, a.dlq)
        failed = event_report(outcomes).where("status = 'failed'").count()
        _show(counters(outcomes).first().asDict(), a.output)
        return int(failed > 0)
    report = projector.run_sources(store, a.state_dir, a.dlq, a.max_batch, continuous=not a.once and not a.stdin, sinks=sinks)
    _show(report, a.output)
    parked = sum(b["dlq"] for b in report["batches"])
    return int(report["stopped"] == "retry_exhausted" or sum(b.get("failed", 0) for b in report["batches"]) > parked)


if __name__ == "__main__":
    sys.exit(main())
