"""The command line and the stateful streaming fold, each against the batch path."""

import json
import random

import pytest

from chronofold import cli
from chronofold.operators.fold import fold_input
from chronofold.plans.runner import Projector
from chronofold.sinks.store import SnapshotStore, rows_of
from chronofold.sources.envelope import split_envelopes
from chronofold.sources.files import from_rows, numbered_stream
from chronofold.streaming.live import stateful_fold, use_rocksdb
from tests.test_core import LIFE, ev, project_of


def envelope(t, seq, id, **p):
    return json.dumps({"event_id": f"{t}{seq}{id}", "event_type": t, "payload": json.dumps({"id": id} | p), "metadata": {}, "sequence": seq})


@pytest.fixture
def folder(tmp_path):
    """A project on disk with two event files; Set has no name in the second."""
    for kind in ("sql", "document", "in"):
        (tmp_path / kind).mkdir()
    (tmp_path / "sql/reg.yaml").write_text("event: Reg\ntable: users\nprimary_key: id\ncolumns: {id: payload.id, name: payload.name}\n")
    (tmp_path / "sql/set.yaml").write_text("event: Set\ntable: users\nprimary_key: id\non_existing: replace\ncolumns: {id: payload.id, name: payload.name}\n")
    (tmp_path / "config.yaml").write_text(f"version: 1\nadapters:\n- {{id: a, type: sqlite, capabilities: [write, idempotent, upsert]}}\nrouting: {{file: routing.json}}\nsources:\n- {{id: s, type: directory, path: {tmp_path / 'in'}}}\n")
    (tmp_path / "routing.json").write_text(json.dumps({"Reg": ["a"], "Set": ["a"]}))
    (tmp_path / "in/1.ndjson").write_text(envelope("Reg", 1, "u", name="x") + "\n" + envelope("Set", 2, "u", name="y") + "\n")
    (tmp_path / "in/2.ndjson").write_text(envelope("Set", 3, "u") + "\n" + envelope("Reg", 1, "v", name="z") + "\n")
    return tmp_path


def test_command_line(spark, folder, capsys):
    def call(verb, *more):
        code = cli.main([verb, "--config", f"{folder}/config.yaml", "--mappings", str(folder), "--state-dir", str(folder), "--output", "json", *more], spark)
        return code, json.loads(capsys.readouterr().out)

    store, dlq = ["--store", f"{folder}/store"], ["--dlq", f"{folder}/dlq"]
    (folder / "one.json").write_text(envelope("Set", 9, "w", name="n"))
    assert call("explain", "--event-type", "Reg")[1]["order"] == ["a"]
    assert call("sources") == (0, {"s": None})
    code, report = call("run", "--once", "--max-batch", "1", *store, *dlq)
    assert code == 0 and report["stopped"] == "caught_up" and [b["dlq"] for b in report["batches"]] == [0, 1]
    assert call("sources") == (0, {"s": "2.ndjson"})
    live = lambda: {tuple(r) for r in rows_of(SnapshotStore(spark, f"{folder}/store").state(), "users", ["id", "name"]).collect()}
    assert live() == {("u", "y"), ("v", "z")}
    assert call("dry-run", "--event", f"{folder}/one.json", *store) == (0, {"a": "created"}) and len(live()) == 2
    code, row = call("run", "--event", f"{folder}/one.json", *store)
    assert code == 0 and row["created"] == 1 and ("w", "n") in live()
    assert call("dry-run", "--event", f"{folder}/one.json", *store) == (0, {"a": "stale_sequence"})
    code, row = call("replay", "--path", f"{folder}/in/1.ndjson")
    assert code == 0 and (row["created"], row["updated"]) == (1, 1)
    assert call("replay", "--path", f"{folder}/in/2.ndjson")[0] == 1


def test_stateful_stream_equals_batch(spark, tmp_path):
    rng = random.Random(11)
    box = tmp_path / "in"
    box.mkdir()
    rows = []
    for i in range(3):
        part = [dict(ev(rng.choice(["Reg", "Set", "Del"]), 10 * i + j, f"u{rng.randint(0, 4)}", name=f"{i}{j}"), event_id=f"e{i}-{j}") for j in range(12)]
        rng.shuffle(part)
        rows += [dict(e, batch_id=i) for e in part]
        (box / f"{i}.ndjson").write_text("".join(json.dumps(e | {"payload": json.dumps(e["payload"]), "metadata": {}}) + "\n" for e in part))
    want = {(r.event_id, r.reason or r.outcome) for r in Projector(spark, project_of(LIFE)).apply(from_rows(spark, rows)).outcomes.collect()}
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    use_rocksdb(spark)
    try:
        events = split_envelopes(numbered_stream(spark, str(box), 1))[0]
        out = stateful_fold(fold_input(Projector(spark, project_of(LIFE)).projected(events)))
        q = out.writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    finally:
        spark.conf.set(key, before)
    assert {(r.event_id, r.reason or r.outcome) for r in spark.table("folded").collect()} == want


def test_lines_of_one_file_reach_several_tasks(spark, tmp_path):
    """One task reads a file; what follows is done by all."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("".join(envelope("Reg", i, f"u{i}") + "\n" for i in range(200)))
    got = []
    lines = numbered_stream(spark, str(tmp_path / "in"), 1).selectExpr("line_no", "spark_partition_id() p")
    q = lines.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.line_no for r in got) == list(range(200)) and len({r.p for r in got}) > 1
