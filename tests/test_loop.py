"""The source loop, the store and the sinks: nothing lost, nothing twice, order by name."""

import json
import os
import random
import sqlite3
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from chronofold import queries, queries_io
from chronofold.operators import fold
from chronofold.operators.fold import fold_input, ordered_fold, replace_fold
from chronofold.plans.config import Adapter, SourceConfig
from chronofold.plans.mapping import parse_mapping
from chronofold.plans.runner import Projector, counters, event_report
from chronofold.sinks.registry import default_registry, jdbc_url, tables_of
from chronofold.sinks.store import GUARD_TABLE, JdbcSink, JsonTreeSink, SinkError, SinkRegistry, SnapshotStore, dead_letters, render_command, rows_of, type_errors, write_dead_letters
from chronofold.sources import files
from chronofold.sources.envelope import split_envelopes
from chronofold.sources.files import from_rows, numbered_stream
from chronofold.streaming.live import run_stream, stateful_fold, use_rocksdb
from tests.test_core import ALL, GRAPH, LIFE, ev, project_of, run


def line(t, seq, id="u1", **p):
    return json.dumps({"event_id": f"{t}{seq}{id}", "event_type": t, "payload": json.dumps({"id": id} | p), "metadata": {}, "sequence": seq}) + "\n"


def same_time(folder):
    for f in folder.iterdir():
        os.utime(f, (1_000_000, 1_000_000))


def sourced(box, **kw):
    return project_of(LIFE, sources=(SourceConfig("s", "directory", str(box)),), **kw)


def live(store):
    return {(r.id, r.name) for r in rows_of(store.state(), "users", ["id", "name"]).collect()}


def test_rejects_and_failures_halt_without_a_dlq(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "1.ndjson").write_text(line("Set", 1, name="x"))
    (box / "2.ndjson").write_text(line("Set", 2, name="y") + "{torn\n")
    store, p = SnapshotStore(spark, str(tmp_path / "st")), Projector(spark, sourced(box))
    report = p.run_sources(store, str(tmp_path), max_batch=1)
    assert report["stopped"] == "retry_exhausted" and report["halt_position"] == "2.ndjson" and p.list_sources(str(tmp_path)) == [("s", "1.ndjson")] and live(store) == {("u1", "x")}
    dlq = str(tmp_path / "dlq")
    report = p.run_sources(store, str(tmp_path), dlq, max_batch=1)
    assert report["stopped"] == "caught_up" and report["batches"][0]["dlq"] == 1 and live(store) == {("u1", "y")}
    assert [r.raw for r in spark.read.json(f"{dlq}/rejects/s/2_ndjson").collect()] == ["{torn"]


class Flaky:
    """Fails a few times, then keeps what it is given."""

    def __init__(self, fails):
        self.fails, self.got, self.calls = fails, [], 0

    def apply(self, state, batch_id):
        self.calls += 1
        if self.fails:
            self.fails -= 1
            raise sqlite3.OperationalError("locked")
        self.got.append(sorted(r.entity_key for r in state.collect()))


def test_sink_errors_are_retried(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "1.ndjson").write_text(line("Set", 1, "a", name="x") + line("Set", 1, "b", name="x"))
    (box / "2.ndjson").write_text(line("Set", 2, "b", name="y"))
    store, p, sink = SnapshotStore(spark, str(tmp_path / "st")), Projector(spark, sourced(box)), Flaky(2)
    report = p.run_sources(store, str(tmp_path), max_batch=1, sinks={"a": sink})
    assert report["stopped"] == "caught_up" and [b["retries"] for b in report["batches"]] == [2, 0]
    assert sink.got == [['["a"]', '["b"]'], ['["b"]']]  # the second batch gives the touched entity alone
    other, store2 = Flaky(9), SnapshotStore(spark, str(tmp_path / "st2"))
    report = p.run_sources(store2, str(tmp_path / "x"), retries=1, sinks={"a": other})
    assert report["stopped"] == "retry_exhausted" and other.calls == 2 and store2.state().count() == 0 and "locked" in report["batches"][0]["error"]
    other.fails = 0
    assert p.run_sources(store2, str(tmp_path / "x"), sinks={"a": other})["stopped"] == "caught_up" and live(store2) == {("a", "x"), ("b", "y")}


def test_streams_and_single_runs_share_a_store(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    for name, seq in (("c", 3), ("a", 1), ("b", 2)):
        (box / f"{name}.ndjson").write_text(line("Reg", seq, "v", name=name))
    same_time(box)
    p, store = Projector(spark, project_of(LIFE)), SnapshotStore(spark, str(tmp_path / "s"))
    for i in range(3):
        p.run_once(ev("Set", i, "u1", name=str(i)), store)
    for _ in range(2):  # nothing is new the second time
        q = run_stream(p, str(box), store, str(tmp_path / "c"), files_per_trigger=1)
        q.awaitTermination(120)
        assert q.exception() is None and live(store) == {("u1", "2"), ("v", "a")}  # the first by name is kept
    (box / "d.ndjson").write_text(line("Set", 9, "v", name="d"))
    q = run_stream(p, str(box), store, str(tmp_path / "c"), files_per_trigger=1)
    q.awaitTermination(120)
    assert live(store) == {("u1", "2"), ("v", "d")} and store.last_batch("stream") >= 1 and store.last_batch() == 2
    (box / "e.ndjson").write_text("{torn\n")
    q = run_stream(p, str(box), store, str(tmp_path / "c"))
    with pytest.raises(Exception, match="no dead-letter folder"):
        q.awaitTermination(120)


def test_stateful_stream_restarts(spark, tmp_path):
    """Two runs from one checkpoint, files of one time, edges among them, against the batch fold."""
    rng, box, rows = random.Random(4), tmp_path / "in", []
    box.mkdir()
    graph = [("graph", m) for _, m in GRAPH if type(m).__name__ == "EdgeMapping"]
    project = project_of(LIFE + graph, {m.event: ["a"] for _, m in LIFE} | {m.event: ["g"] for _, m in graph}, [Adapter("a", "sqlite", capabilities=ALL), Adapter("g", "graph", capabilities=ALL)], failure_policy="continue_on_error")
    p = Projector(spark, project)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    use_rocksdb(spark)
    got = set()
    try:
        for step in range(2):
            for i in range(2 * step, 2 * step + 2):
                part = [dict(ev(rng.choice(["Reg", "Set", "Del"]), 5 * i + rng.randint(0, 9), f"u{rng.randint(0, 3)}", name=f"{i}{j}"), event_id=f"e{i}-{j}") for j in range(10)]
                part += [{"event_id": f"g{i}-{j}", "event_type": graph[0][1].event, "payload": {"a": "x", "b": f"y{j % 2}", "ts": j}, "sequence": rng.randint(0, 9)} for j in range(4)]
                rows += [dict(e, batch_id=i) for e in part]
                (box / f"{i}.ndjson").write_text("".join(json.dumps(e | {"payload": json.dumps(e["payload"]), "metadata": {}}) + "\n" for e in part))
            same_time(box)
            out = stateful_fold(fold_input(p.projected(split_envelopes(numbered_stream(spark, str(box), 1))[0])))
            q = out.writeStream.foreachBatch(lambda df, _: got.update((r.event_id, r.reason or r.outcome) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination(180)
            assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = {(r.event_id, r.reason or r.outcome) for r in p.apply(from_rows(spark, rows)).outcomes.collect()}
    assert got == want and len(want) == 56


def test_store_versions(spark, tmp_path):
    root = tmp_path / "s"
    p, store = Projector(spark, project_of(LIFE)), SnapshotStore(spark, str(root), buckets=4)
    for i in range(5):
        p.run_once(ev("Set", i, f"u{i % 3}", name=str(i)), store)
        (root / "versions" / f"{99:012d}.json.tmp").write_text("torn")  # what a crash may leave
    assert live(SnapshotStore(spark, str(root))) == {("u0", "3"), ("u1", "4"), ("u2", "2")} and store.batch_id == 4
    assert len([f for f in (root / "versions").iterdir() if f.suffix == ".json"]) <= 3
    first = p.dry_run_once(ev("Set", 9, "u0", name="n"), store).first()
    assert first.outcome == "updated" and live(store) == {("u0", "3"), ("u1", "4"), ("u2", "2")}


def test_dead_letters_of_null_positions(spark, tmp_path):
    out, _ = run(spark, project_of(LIFE), [ev("Reg", 1, "u1"), ev("Reg", 2, "u2", name="x")])
    events = from_rows(spark, [ev("Reg", 1, "u1"), ev("Reg", 2, "u2", name="x")]).withColumns({"position": F.lit(None).cast("string"), "line_no": F.lit(None).cast("long")})
    outcomes = Projector(spark, project_of(LIFE)).apply(events).outcomes
    letters = dead_letters(events, outcomes)
    assert [r.event_id for r in letters.collect()] == ["Reg1"]
    for _ in range(2):
        write_dead_letters(letters, str(tmp_path / "d"), "s/7")
    assert spark.read.json(str(tmp_path / "d/events/s/7")).count() == 1
    twice = event_report(Projector(spark, project_of(LIFE)).apply(from_rows(spark, [dict(ev("Set", 1, name="x"), event_id="e")] * 2)).outcomes)
    assert [r.n_adapters for r in twice.collect()] == [1, 1]


def test_failures_of_the_fold_stop_later_adapters(spark):
    """A facet on a body that is no object fails in the fold: later adapters and, in a replay, later events are not run."""
    kv = lambda e, **k: ("keyvalue", parse_mapping("keyvalue", {"event": e, "namespace": "n", "key": "payload.id", "value": "payload.v", "on_existing": "replace"} | k))
    doc = lambda e: ("document", parse_mapping("document", {"event": e, "collection": "c", "id": "payload.id", "document": {"v": "payload.id"}, "on_existing": "replace"}))
    maps = [kv("Base"), kv("Part", facet="f"), doc("Part"), doc("Base")]
    ads = [Adapter("k", "keyvalue", 1, capabilities=ALL), Adapter("d", "file", 2, capabilities=ALL)]
    events = [ev("Base", 1, "a", v={"x": 1}), ev("Part", 2, "a", v={"y": 2}), ev("Base", 1, "b", v=7), ev("Part", 3, "b", v={"y": 1}), ev("Part", 4, "a", v={"z": 1})]
    p = Projector(spark, project_of(maps, {"Base": ["k", "d"], "Part": ["k", "d"]}, ads), check=False)
    rows = {(r.sequence, r.entity_key, r.adapter_id): r.reason or r.outcome for r in p.apply(from_rows(spark, events)).outcomes.collect()}
    assert rows[3, "b", "k"] == "write_failed" and (3, "b", "d") not in rows and rows[4, "a", "d"] == "updated" and len(rows) == 9
    stopped = p.replay(from_rows(spark, events)).outcomes.collect()
    assert max(r.sequence for r in stopped) == 3 and len(stopped) == 7


def test_window_fold_equals_ordered_fold(spark):
    rng = random.Random(12)
    maps = [LIFE[1], LIFE[2]]
    events = from_rows(spark, [dict(ev(rng.choice(["Set", "Set", "Del"]), rng.randint(0, 9), f"u{rng.randint(0, 12)}", name=f'"{i}\\'), event_id=f'e"{i}', batch_id=rng.randint(0, 3)) for i in range(200)])
    p = Projector(spark, project_of(maps))
    writes = fold_input(p.projected(events))
    rows = lambda df: sorted((repr({k: json.loads(v) if k == "lanes" and v else v for k, v in r.asDict().items() if k != "ends"}) for r in df.collect()))
    assert p._closed() == [("sql", "users")] and rows(replace_fold(writes)) == rows(ordered_fold(writes)) and len(rows(replace_fold(writes))) > 200
    assert "MapInArrow" not in p.apply(events).outcomes._jdf.queryExecution().executedPlan().toString()


def test_one_scan_for_all_kinds(spark, tmp_path):
    doc = ("document", parse_mapping("document", {"event": "Set", "collection": "c", "id": "payload.id", "document": {"x": "payload.name"}, "on_existing": "replace"}))
    ads = [Adapter("a", "sqlite", 1, capabilities=ALL), Adapter("d", "file", 2, capabilities=ALL)]
    from_rows(spark, [ev("Set", 1, name="x")]).write.parquet(str(tmp_path / "e"))
    rows = Projector(spark, project_of([LIFE[1], doc], {"Set": ["a", "d"]}, ads)).projected(spark.read.parquet(str(tmp_path / "e")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 2 and plan.count("FileScan") == 1 and "Exchange" not in plan


def test_jdbc_deletes_guards_and_types(spark):
    """The statements of one dialect run in SQLite, which has the same upsert; staging by plain inserts."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE users (id TEXT PRIMARY KEY, name TEXT)")

    class Local(JdbcSink):
        def apply(self, state, batch_id):
            for name, rows in self.staged(state).items():
                db.execute(f"CREATE TABLE {name} ({', '.join(rows.columns)})")
                db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows.columns))})", [[str(x) if x is not None else None for x in r] for r in rows.collect()])
            self.execute(self.statements())

    sink = Local("", "postgres", {"users": (["id"], ["id", "name"])}, lambda xs: [db.execute(x) for x in xs])
    for events in ([ev("Set", 1, "u1", name="x"), ev("Set", 1, "u2", name="y")], [ev("Set", 1, "u1", name="x"), ev("Set", 2, "u1", name="z"), ev("Set", 1, "u2", name="y"), ev("Del", 2, "u2")]):
        sink.apply(Projector(spark, project_of(LIFE)).apply(from_rows(spark, events)).state, 0)
    assert db.execute("SELECT * FROM users").fetchall() == [("u1", "z")]
    assert sorted(db.execute(f"SELECT entity_key, last_sequence, deleted FROM {GUARD_TABLE}").fetchall()) == [('["u1"]', 2, "False"), ('["u2"]', 2, "True")]
    state = Projector(spark, project_of(LIFE)).apply(from_rows(spark, [ev("Set", 1, "u1", name="abc"), ev("Set", 1, "u2", name="12"), ev("Set", 1, "u3", name=None)])).state
    assert [(r.entity_key, r.error) for r in type_errors(state, "users", {"name": "bigint"}).collect()] == [('["u1"]', "name: no bigint: abc")]
    with pytest.raises(SinkError, match="no bigint"):
        JdbcSink("", "postgres", {"users": (["id"], ["id", "name"])}, print, types={"users": {"name": "bigint"}}).staged(state)
    mysql = JdbcSink("", "mysql", {"users": (["id"], ["id", "name"])}, print).statements()
    assert mysql[1].startswith("DELETE FROM users WHERE EXISTS") and mysql[2].endswith("ON DUPLICATE KEY UPDATE name = VALUES(name)")


def test_json_tree_keeps_what_lives(spark, tmp_path):
    sink, p, store = JsonTreeSink(spark, str(tmp_path / "t"), 4), Projector(spark, project_of(LIFE)), SnapshotStore(spark, str(tmp_path / "s"))
    for i, e in enumerate([ev("Set", 1, "a", name="x"), ev("Set", 1, "b", name="y"), ev("Set", 2, "a", name="z"), ev("Del", 2, "b")]):
        p.commit(from_rows(spark, [e]), store, i, {"a": sink})
    assert {(r.target, r.entity_key, json.loads(r.body)["name"]) for r in spark.read.json(str(tmp_path / "t/data")).collect()} == {("users", '["a"]', "z")}
    assert {(r.entity_key, int(r.last_sequence), r.deleted) for r in spark.read.json(str(tmp_path / "t/guards")).collect()} == {('["a"]', 2, False), ('["b"]', 2, True)}


def test_sinks_of_the_config(spark, tmp_path):
    ads = [Adapter("a", "sqlite", capabilities=ALL), Adapter("r", "redis", config={"url": "redis://h"}, capabilities=ALL), Adapter("x", "mine")]
    kv = ("keyvalue", parse_mapping("keyvalue", {"event": "Set", "namespace": "n", "key": "payload.id", "value": {"v": "payload.name"}, "on_existing": "replace"}))
    project = project_of([*LIFE, kv], {m.event: ["a"] for _, m in LIFE} | {"Set": ["a", "r", "x"]}, ads, failure_policy="continue_on_error")
    p = Projector(spark, project)
    sinks = p.build_sinks(str(tmp_path))
    assert set(sinks) == {"a"} and "client library" in p.broken["r"] and "UnregisteredAdapterType" in p.broken["x"]
    out = p.commit(from_rows(spark, [ev("Set", 1, "u", name="n")]), SnapshotStore(spark, str(tmp_path / "s")), 0, sinks)
    rows = {r.adapter_id: (r.reason or r.outcome, r.error) for r in out.collect()}
    assert rows["a"] == ("created", None) and rows["r"][0] == rows["x"][0] == "write_failed" and "client library" in rows["r"][1]
    assert sqlite3.connect(tmp_path / "a.db").execute("SELECT * FROM users").fetchall() == [("u", "n")]
    assert tables_of(project, ads[0]) == {"users": (["id"], ["id", "name"])}
    assert jdbc_url(Adapter("p", "postgres", config={"url": "postgres://u:pw@h:5432/db"})) == ("jdbc:postgresql://h:5432/db", {"user": "u", "password": "pw", "driver": "org.postgresql.Driver"})
    got = []
    mine = Projector(spark, replace(project, config=replace(project.config, adapters=(ads[0], ads[1])), routes=project.routes | {"Set": ["a", "r"]}), registry=SinkRegistry().register("redis", lambda c: got.append(c) or Flaky(0)), check=False)
    assert set(mine.build_sinks(str(tmp_path))) == {"a", "r"} and got == [{"url": "redis://h"}]
    assert default_registry(spark, project).known("neo4j")


def test_commands(spark):
    out, _ = run(spark, project_of(LIFE), [ev("Set", 1, "u1", name='q"'), ev("Set", 1, "u2", name="y"), ev("Del", 2, "u2")])
    text = lambda kind, df: sorted(r.c for r in df.select(render_command(kind).alias("c")).collect())
    redis, mongo = text("redis", out.state), text("mongodb", out.state)
    assert redis[0].startswith('DEL "users:[\\"u2\\"]"; HSET chronofold:guard') and redis[1].startswith('SET "users:[\\"u1\\"]"')
    assert {json.loads(x)["updates"][0]["u"]["$set"]["live"] for x in mongo} == {True, False} and json.loads(mongo[0])["update"] == "users"
    e = {"event_id": "E", "event_type": "E", "payload": {"a": "a", "b": "b", "ts": 1}, "sequence": 2}
    g = Projector(spark, project_of(GRAPH, adapters=[Adapter("a", "graph", capabilities=ALL)])).apply(from_rows(spark, [ev("N", 1, "a", name="a"), ev("N", 1, "b", name="b"), e]))
    cypher = text("neo4j", g.state)
    assert cypher[0].startswith("MATCH (a {_key: ") and "MERGE (a)-[r:`FOLLOWS`" in cypher[0] and cypher[1].startswith("MERGE (n:`")


def test_stdin_in_the_loop(spark, tmp_path):
    lines = [line("Set", i, f"u{i % 2}", name=str(i)) for i in range(5)] + ["\n", line("Set", 9, "z", name="z")]
    p, store = Projector(spark, project_of(LIFE, sources=(SourceConfig("in", "stdin"),))), SnapshotStore(spark, str(tmp_path / "s"))
    report = p.run_sources(store, str(tmp_path), max_batch=2, stdin=iter(lines))
    assert [b["position"] for b in report["batches"]] == ["000000000001", "000000000003", "000000000006"] and live(store) == {("u0", "4"), ("u1", "3"), ("z", "z")}
    again = p.run_sources(store, str(tmp_path), max_batch=2, stdin=iter([*lines, line("Set", 10, "z", name="new")]))
    assert [b["position"] for b in again["batches"]] == ["000000000007"] and ("z", "new") in live(store)
    assert fold.guards(store.state()).count() == 3


def test_a_batch_is_parsed_and_folded_once(spark, tmp_path):
    """Outcomes and states are read from the rows that one fold wrote; scratch folders of a loop's batches go with them."""
    p, store = queries.projector(spark, queries.MIX), SnapshotStore(spark, str(tmp_path / "s"), 2)
    e = queries.envelopes(spark, "/root/testdata/sf0.001").where("line_no < 200")
    batch = {}
    out = p.commit(e, store, 0, batch=batch)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "parse_json" not in plan
    assert {k: batch[k] for k in ("created", "updated", "deleted", "skipped", "failed")} == {k: counters(out).first()[k] for k in ("created", "updated", "deleted", "skipped", "failed")}
    again = p.commit(e, store, 1)
    assert out.count() == again.count()  # outcomes of the batch before stay readable
    store.drop(batch["scratch"])
    assert not os.path.exists(batch["scratch"])


def test_event_files_are_sorted_in_parts(spark, monkeypatch):
    """A file of any size is sorted by many tasks and joined: lines in sequence order over the file names."""
    monkeypatch.setattr(queries_io, "SORTED", 100)
    spark.sparkContext.setJobGroup("written", "")
    try:
        folder = queries_io.written(spark, "/root/testdata/sf0.001", 2)
        track = spark.sparkContext.statusTracker()
        tasks = [track.getStageInfo(i).numTasks for j in track.getJobIdsForGroup("written") for i in track.getJobInfo(j).stageIds if track.getStageInfo(i)]
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    names = [n for n in sorted(os.listdir(folder)) if not n.startswith(".")]
    seqs = [json.loads(x)["sequence"] for n in names for x in open(f"{folder}/{n}")]
    assert len(names) == 2 and seqs == sorted(seqs) and len(seqs) == queries.table(spark, "/root/testdata/sf0.001", "events").count()
    assert max(tasks) >= len(seqs) // 100


def test_a_stream_projects_a_batch_once(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.ndjson").write_text(line("Set", 1, name="x"))
    p, calls = Projector(spark, project_of(LIFE)), []
    whole = p.projected
    monkeypatch.setattr(p, "projected", lambda e: calls.append(1) or whole(e))
    store = SnapshotStore(spark, str(tmp_path / "st"), 2)
    run_stream(p, str(tmp_path / "in"), store, str(tmp_path / "c")).awaitTermination()
    assert live(store) == {("u1", "x")} and len(calls) == 1


def test_a_poll_counts_only_the_files_it_needs(spark, tmp_path, monkeypatch):
    for i in range(1, 7):
        (tmp_path / f"{i}.ndjson").write_text(line("Set", i, name="x"))
    seen, whole = [], files.read_lines
    monkeypatch.setattr(files, "read_lines", lambda s, path, *a: seen.append(len(path)) or whole(s, path, *a))
    assert files.directory_batch(spark, str(tmp_path), None, 1)[2] == "1.ndjson" and seen == [1, 1]
    events, _, end = files.directory_batch(spark, str(tmp_path), "1.ndjson", 4)
    assert end == "5.ndjson" and events.count() == 4
