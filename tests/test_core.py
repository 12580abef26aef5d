import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from chronofold.operators.decide import Entity, decide
from chronofold.operators.fold import closed_form, fold_input, guards, latest_fold
from chronofold.operators.project import preview
from chronofold.operators.upcast import Downcast, MissingLink, UpcasterRegistry
from chronofold.plans.config import Adapter, Config, ConfigError, Project, SourceConfig, expand_env, parse_config
from chronofold.plans.mapping import MappingError, Mappings, load_dir, parse_mapping
from chronofold.plans.order import OrderError, execution_order, explain, grouped_layers, layers
from chronofold.plans.runner import Projector, counters, event_report
from chronofold.plans.validate import ValidationFailed, issues, validate_event
from chronofold.sinks.store import GUARD_TABLE, FailedSink, SinkRegistry, SnapshotStore, SqliteSink, dead_letters, render_delete, render_write, rows_of
from chronofold.sources.checkpoint import Checkpoint
from chronofold.sources.envelope import decode_wire, split_envelopes
from chronofold.sources.files import directory_batch, from_rows, load_event, replay_events, stdin_lines

ALL = ("write", "idempotent", "upsert", "transactions", "delete")
LIVE, DEAD, FOREVER = [5, "e", False, False], [5, "e", True, False], [5, "e", True, True]
TABLE = [
    (FOREVER, "upsert", "replace", 9, "SkipTombstoned"), (FOREVER, "delete", "ignore", 9, "SkipTombstoned"),
    (None, "delete", "ignore", 1, "Delete"), (LIVE, "delete", "ignore", 6, "Delete"), (LIVE, "delete", "ignore", 5, "SkipStale"),
    (DEAD, "delete", "ignore", 6, "SkipAlreadyDeleted"), (DEAD, "delete", "ignore", 5, "SkipStale"),
    (None, "upsert", "ignore", 1, "Insert"), (None, "upsert", "replace", 1, "Insert"),
    (DEAD, "upsert", "ignore", 6, "Insert"), (DEAD, "upsert", "replace", 5, "SkipStale"),
    (LIVE, "upsert", "ignore", 9, "SkipIdempotent"), (LIVE, "upsert", "ignore", 1, "SkipIdempotent"),
    (LIVE, "upsert", "replace", 6, "Update"), (LIVE, "upsert", "replace", 5, "SkipStale"),
]


@pytest.mark.parametrize("lane,op,mode,seq,want", TABLE)
def test_decision_table(lane, op, mode, seq, want):
    assert decide(op, mode, lane, seq) == want


def sql(event, columns, **kw):
    return parse_mapping("sql", {"event": event, "table": "users", "primary_key": "id", "columns": columns} | kw)


def project_of(mappings, routes=None, adapters=None, **kw):
    adapters = adapters or (Adapter("a", "sqlite", capabilities=ALL),)
    by_kind = {"sql": {}, "document": {}, "keyvalue": {}, "graph": {}}
    for kind, m in mappings:
        by_kind[kind][m.event] = m
    routes = routes or {m.event: ["a"] for _, m in mappings}
    return Project(Config(tuple(adapters), **kw), Mappings(**by_kind), routes)


LIFE = [
    ("sql", sql("Reg", {"id": "payload.id", "name": "payload.name"})),
    ("sql", sql("Set", {"id": "payload.id", "name": "payload.name"}, on_existing="replace")),
    ("sql", sql("Del", {"id": "payload.id"}, operation="delete")),
    ("sql", sql("End", {"id": "payload.id"}, operation="delete", permanent=True)),
]


def ev(t, seq, id="u1", **p):
    return {"event_id": f"{t}{seq}", "event_type": t, "payload": {"id": id} | p, "sequence": seq}


def run(spark, project, events, **kw):
    out = Projector(spark, project, **kw).apply(from_rows(spark, events))
    rows = {(r.event_id, r.adapter_id, r.line_no): r.reason or r.outcome for r in out.outcomes.collect()}
    return out, rows


def test_quickstart(spark):
    p = project_of([("sql", sql("Reg", {"id": "payload.id", "name": "payload.name", "email": "payload.email"})), ("sql", sql("Mail", {"id": "payload.id", "name": "payload.name", "email": "payload.email"}, on_existing="replace"))])
    out, _ = run(spark, p, [ev("Reg", 1, "u1", name="Ada", email="a@x"), ev("Reg", 1, "u2", name="Grace", email="g@x"), ev("Mail", 2, "u1", name="Ada", email="ada@x")])
    assert sorted(map(tuple, rows_of(out.state, "users", ["id", "name", "email"]).collect())) == [("u1", "Ada", "ada@x"), ("u2", "Grace", "g@x")]


def test_lifecycle_and_permutations(spark):
    events = [ev("Set", 1, name="a"), ev("Set", 2, name="b"), ev("Del", 3)]
    batches = []
    for n, perm in enumerate(itertools.permutations(events)):
        batches += [dict(e, payload={"id": f"p{n}", "name": e["payload"].get("name", "")}) | {"batch_id": k} for k, e in enumerate(perm)]
    out, _ = run(spark, project_of(LIFE), batches)
    g = out.guards.collect()
    assert len(g) == 6 and all(r.last_sequence == 3 and r.deleted for r in g)


def test_against_direct_machine(spark):
    rng = random.Random(5)
    events = []
    for k in range(40):
        for i in range(rng.randint(1, 7)):
            t = rng.choice(["Reg", "Set", "Del", "End"] if k % 3 == 0 else ["Reg", "Set", "Del"])
            events.append(dict(ev(t, rng.randint(0, 5), f"u{k}", name=f"n{i}"), event_id=f"{k}-{i}", batch_id=i))
    out, rows = run(spark, project_of(LIFE), events)
    want, machines = {}, {}
    for n, e in sorted(enumerate(events), key=lambda x: x[1]["batch_id"]):
        m = machines.setdefault(e["payload"]["id"], Entity("sql"))
        t = e["event_type"]
        x, why = m.step("delete" if t in ("Del", "End") else "upsert", "replace" if t == "Set" else "ignore", "", e["sequence"], e["event_id"], t == "End", "{}")
        want[e["event_id"], "a", n] = why or x
    assert rows == want
    assert {r.entity_key: r.live for r in out.state.collect()} == {json.dumps([k]): m.live for k, m in machines.items()}


def test_incremental_equals_whole(spark, tmp_path):
    rng = random.Random(7)
    events = [dict(ev(rng.choice(["Reg", "Set", "Del"]), rng.randint(1, 9), f"u{rng.randint(0, 5)}", name=str(i)), event_id=f"e{i}", batch_id=i // 10) for i in range(30)]
    whole, _ = run(spark, project_of(LIFE), events)
    store, p = SnapshotStore(spark, str(tmp_path / "s")), Projector(spark, project_of(LIFE))
    for b in range(3):
        part = [e for e in events if e["batch_id"] == b]
        p.commit(from_rows(spark, part), store, b)
        p.commit(from_rows(spark, part), store, b)  # a repeated batch changes nothing
    key = lambda s: sorted((r.entity_key, r.live, r.body, [x[0] for x in json.loads(r.lanes).values()]) for r in s.collect())
    assert key(store.state()) == key(whole.state)


FACETS = [
    ("sql", sql("New", {"id": "payload.id", "name": "payload.name"})),
    ("sql", sql("Mail", {"id": "payload.id", "email": "payload.email"}, facet="contact")),
    ("sql", sql("Login", {"id": "payload.id", "seen": "payload.seen"}, facet="login")),
    ("sql", sql("Del", {"id": "payload.id"}, operation="delete")),
]


def test_facets(spark):
    _, rows = run(spark, project_of(FACETS), [dict(e, batch_id=i) for i, e in enumerate([
        ev("Mail", 1, email="x"), ev("New", 2, name="A"), ev("Mail", 6, email="m"), ev("Mail", 5, email="old"), ev("Login", 3, seen="t"), ev("Del", 4), ev("Mail", 9, email="z"),
        ev("New", 5, name="B"), ev("Mail", 4, email="q"), ev("Mail", 5, email="q")])])
    assert [v for _, v in sorted(rows.items(), key=lambda x: x[0][2])] == ["entity_absent", "created", "created", "stale_sequence", "created", "deleted", "entity_absent", "created", "stale_sequence", "updated"]


def test_facet_interleave_body(spark):
    out, _ = run(spark, project_of(FACETS), [ev("New", 1, name="Ada"), ev("Login", 6, seen="t"), ev("Mail", 5, email="m")])
    assert json.loads(out.state.first().body) == {"id": "u1", "name": "Ada", "seen": "t", "email": "m"}
    assert {r.facet for r in guards(out.state).collect()} == {"", "login", "contact"}


GRAPH = [
    ("graph", parse_mapping("graph", {"event": "N", "label": "User", "key": "payload.id", "properties": {"name": "payload.name"}})),
    ("graph", parse_mapping("graph", {"event": "D", "label": "User", "key": "payload.id", "operation": "delete"})),
    ("graph", parse_mapping("graph", {"event": "E", "edge_type": "FOLLOWS", "from": "payload.a", "to": "payload.b", "properties": {"ts": "payload.ts"}, "on_existing": "replace"})),
]


def test_detach_delete(spark):
    p = project_of(GRAPH, adapters=[Adapter("a", "graph", capabilities=ALL)])
    e = lambda a, b, s: {"event_id": f"E{s}", "event_type": "E", "payload": {"a": a, "b": b, "ts": s}, "sequence": s}
    events = [ev("N", 1, x, name=x) for x in "abcd"] + [e("a", "b", 2), e("b", "c", 3), e("c", "d", 4), ev("D", 5, "b"), e("b", "d", 7), e("a", "a", 8)]
    out, rows = run(spark, p, [dict(x, batch_id=i) for i, x in enumerate(events)])
    assert rows["E7", "a", 8] == "entity_absent" and rows["E8", "a", 9] == "created"
    live = {(r.kind, r.entity_key) for r in out.state.where("live").collect()}
    assert live == {("node", x) for x in "acd"} | {("edge", '["FOLLOWS","c","d"]'), ("edge", '["FOLLOWS","a","a"]')}
    g = {r.entity_key: (int(r.last_sequence), r.deleted) for r in out.guards.collect() if r.target == "FOLLOWS"}
    assert g['["FOLLOWS","a","b"]'] == (5, True)


def test_graph_over_batches(spark, tmp_path):
    p = Projector(spark, project_of(GRAPH, adapters=[Adapter("a", "graph", capabilities=ALL)]))
    store = SnapshotStore(spark, str(tmp_path / "g"))
    e = {"event_id": "E", "event_type": "E", "payload": {"a": "a", "b": "b", "ts": 1}, "sequence": 2}
    for i, x in enumerate([ev("N", 1, "a", name="a"), e, ev("D", 3, "a"), dict(e, sequence=4), ev("N", 5, "a", name="a"), dict(e, sequence=6)]):
        got = p.run_once(x, store).first()
        assert (got.reason or got.outcome) == ["created", "created", "deleted", "entity_absent", "created", "created"][i]


def test_kinds_agree_and_keys(spark):
    maps = [("sql", sql("X", {"id": "payload.id", "n": "payload.n", "m": "metadata.m"}, on_existing="replace")),
            ("document", parse_mapping("document", {"event": "X", "collection": "c", "id": "payload.id", "document": {"n": "payload.n", "k": 1, "l": ["payload.n", True]}, "on_existing": "replace"})),
            ("keyvalue", parse_mapping("keyvalue", {"event": "X", "namespace": "ns", "key": "payload.id", "value": {"n": "payload.n", "deep": {"a.b": "payload.a.b"}}, "on_existing": "replace"}))]
    ads = [Adapter("a", "sqlite", capabilities=ALL), Adapter("d", "file", capabilities=ALL), Adapter("k", "redis", config={"url": "redis://h"}, capabilities=ALL)]
    p = project_of(maps, {"X": ["a", "d", "k"]}, ads, failure_policy="continue_on_error")
    out, rows = run(spark, p, [{"event_id": "e", "event_type": "X", "payload": {"id": 7, "n": None, "a.b": [1]}, "metadata": {"m": "v"}, "sequence": 1}])
    got = {r.adapter_id: (r.entity_key, json.loads(r.body)) for r in out.state.collect()}
    assert got["a"] == ("[7]", {"id": 7, "n": None, "m": "v"})
    assert got["d"] == ("7", {"n": None, "k": 1, "l": [None, True]})
    assert got["k"] == ("7", {"n": None, "deep": {"a.b": [1]}})
    assert rows_of(out.state, "users", ["n"]).first().n is None and rows_of(out.state, "users", ["n"], null_text=True).first().n == ""


def test_failures(spark):
    ads = [Adapter("a", "sqlite", priority=1, capabilities=ALL), Adapter("d", "file", depends_on=("a",), capabilities=ALL)]
    maps = [*LIFE[:1], ("document", parse_mapping("document", {"event": "Reg", "collection": "c", "id": "payload.id", "document": {"x": "payload.id"}}))]
    events = [ev("Reg", 1, "u1", name="x"), ev("Reg", 2, "u2"), ev("Reg", 3, "u3", name="y"), ev("Other", 4), {"event_id": "bad", "event_type": "Reg", "payload": "[1]", "sequence": 5}]
    fast = project_of(maps, {"Reg": ["d", "a"]}, ads)
    out, rows = run(spark, fast, events)
    assert sorted(k[:2] for k in rows) == [("Reg1", "a"), ("Reg1", "d"), ("Reg2", "a"), ("Reg3", "a"), ("Reg3", "d"), ("bad", "a")]
    assert [r.event_id for r in out.unrouted.collect()] == ["Other4"]
    every = Projector(spark, project_of(maps, {"Reg": ["d", "a"]}, ads, failure_policy="continue_on_error")).apply(from_rows(spark, events)).outcomes
    assert counters(every).first().asDict()["failed"] == 3 and every.count() == 8
    assert {r.event_id: r.status for r in event_report(every).collect()}["Reg2"] == "failed"
    stopped = Projector(spark, fast).replay(from_rows(spark, events)).outcomes
    assert {r.event_id for r in stopped.collect()} == {"Reg1", "Reg2"}
    letters = dead_letters(from_rows(spark, events), every).collect()
    assert {x.event_id for x in letters} == {"Reg2", "bad"} and all(x.file_name.endswith(".json") for x in letters)


def test_upcasting(spark):
    reg = UpcasterRegistry()
    add = lambda field: lambda v: F.expr("1") if False else F.call_function("to_variant_object", F.map_concat(v.cast("map<string,variant>"), F.create_map(F.lit(field), F.parse_json(F.lit('"?"')))))
    reg.register("V", 1, add("email")).register("V", 2, add("tier"))
    m = sql("V", {"id": "payload.id", "email": "payload.email", "tier": "payload.tier"}, version=3)
    events = [{"event_id": f"v{v}", "event_type": "V", "payload": {"id": f"u{v}"} | ({"email": "e"} if v > 1 else {}) | ({"tier": "t"} if v > 2 else {}), "version": v, "sequence": 1} for v in (1, 2, 3, 4)]
    out, rows = run(spark, project_of([("sql", m)]), events, upcasters=reg)
    assert [v for _, v in sorted(rows.items())] == ["created"] * 3 + ["unsupported_version"]
    assert {(r.id, r.email, r.tier) for r in rows_of(out.state, "users", ["id", "email", "tier"]).collect()} == {("u1", "?", "?"), ("u2", "e", "?"), ("u3", "e", "t")}
    kept = Projector(spark, project_of([("sql", m)], migration_policy="ignore_unmatched")).apply(from_rows(spark, events)).outcomes
    assert sorted(r.outcome for r in kept.collect()) == ["created", "skipped", "skipped", "skipped"]
    with pytest.raises(MissingLink):
        UpcasterRegistry().chain("V", 1, 2)
    with pytest.raises(Downcast):
        reg.chain("V", 3, 1)


def test_strict_envelopes(spark):
    ok = {"event_id": "a", "event_type": "T", "payload": "{}", "metadata": {"k": "v"}, "sequence": 18446744073709551615}
    lines = [ok, ok | {"version": 2, "extra": 1}, ok | {"payload": {}}, ok | {"sequence": 1.0}, ok | {"sequence": -1}, {k: v for k, v in ok.items() if k != "metadata"}, ok | {"metadata": {"k": 1}}, ok | {"version": "1"}, ok | {"version": None}]
    df = stdin_lines(spark, [json.dumps(x) for x in lines] + ["", "{oops", "[]"])
    good, bad = split_envelopes(df)
    assert [(int(r.sequence), r.version, r.position) for r in good.orderBy("position").collect()] == [(18446744073709551615, 1, "000000000000"), (18446744073709551615, 2, "000000000001")]
    assert bad.count() == 9
    wire = spark.createDataFrame([("", "p", "T", 0, 1), ("", "", "T", 2, 5)], "event_id string, position string, event_type string, version int, sequence int")
    assert [(r.event_id, r.version) for r in decode_wire(wire).orderBy("version").collect()] == [("p", 1), ("T-5", 2)]


def test_files_and_resume(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    line = lambda s, **p: json.dumps({"event_id": f"e{s}", "event_type": "Reg", "payload": json.dumps(p), "metadata": {}, "sequence": s})
    (box / "1.ndjson").write_text(line(1, id="a", name="x") + "\n\n" + line(2, id="b") + "\n")
    (box / "2.json").write_text(line(3, id="c", name="y"))
    (box / "3.txt").write_text("no")
    events, rejects, end = directory_batch(spark, str(box), None, 1)
    assert events.count() == 2 and end == "1.ndjson"
    assert directory_batch(spark, str(box), "2.json")[2] is None
    assert replay_events(spark, str(box)).count() == 1 and replay_events(spark, str(box / "1.ndjson")).count() == 2 and load_event(spark, str(box / "2.json")).count() == 1
    p = Projector(spark, project_of(LIFE[:1], sources=(SourceConfig("s", "directory", str(box)),)))
    store = SnapshotStore(spark, str(tmp_path / "st"))
    report = p.run_sources(store, str(tmp_path), dlq=str(tmp_path / "dlq"), max_batch=1)
    assert report["stopped"] == "caught_up" and [b["position"] for b in report["batches"]] == ["1.ndjson", "2.json"] and report["batches"][0]["dlq"] == 1
    assert store.state().where("live").count() == 2 and p.list_sources(str(tmp_path)) == [("s", "2.json")]
    assert p.run_sources(store, str(tmp_path), dlq=str(tmp_path / "dlq"))["batches"] == []
    halt = Projector(spark, project_of(LIFE[:1], sources=(SourceConfig("t", "directory", str(box)),))).run_sources(SnapshotStore(spark, str(tmp_path / "s2")), str(tmp_path), retries=0)
    assert halt["stopped"] == "retry_exhausted" and halt["halt_position"] == "2.json"
    mark = Checkpoint(tmp_path, "m")
    assert mark.commit("2") and not mark.commit("1") and mark.position() == "2"


def test_stream_equals_batch(spark, tmp_path):
    from chronofold.streaming.live import run_stream

    box = tmp_path / "in"
    box.mkdir()
    for i in range(3):
        (box / f"{i}.ndjson").write_text("".join(json.dumps({"event_id": f"e{i}{j}", "event_type": "Set", "payload": json.dumps({"id": f"u{j}", "name": str(i)}), "metadata": {}, "sequence": i}) + "\n" for j in range(3)))
    p, store = Projector(spark, project_of(LIFE)), SnapshotStore(spark, str(tmp_path / "s"))
    q = run_stream(p, str(box), store, str(tmp_path / "c"), files_per_trigger=1)
    q.awaitTermination(120)
    assert {(r.id, r.name) for r in rows_of(store.state(), "users", ["id", "name"]).collect()} == {(f"u{j}", "2") for j in range(3)}


def test_closed_form_equals_fold(spark):
    rng = random.Random(3)
    maps = [LIFE[1], LIFE[2]]
    assert closed_form(m for _, m in maps) == "latest" and closed_form(m for _, m in LIFE) is None and closed_form([LIFE[0][1]]) == "first"
    events = from_rows(spark, [dict(ev(rng.choice(["Set", "Del"]), rng.randint(0, 6), f"u{rng.randint(0, 9)}", name=str(i)), batch_id=rng.randint(0, 3)) for i in range(80)])
    p = Projector(spark, project_of(maps))
    slow = p.apply(events)
    fast = latest_fold(fold_input(p.projected(events)))
    got = {r.entity_key: (r.last_sequence, r.deleted, r.body) for r in fast.collect()}
    bodies = {r.entity_key: r.body for r in slow.state.collect()}
    # a tie of upserts goes to the earliest arrival within the highest sequence
    assert {r.entity_key: (r.last_sequence, r.deleted, bodies[r.entity_key]) for r in slow.guards.collect()} == got


def test_order_and_explain():
    ads = {a.id: a for a in (Adapter("a", "sqlite", 5), Adapter("b", "file", 1, depends_on=("a",)), Adapter("c", "redis", 0, depends_on=("b",)), Adapter("z", "graph", 1))}
    assert execution_order(["c", "b", "z", "a"], ads) == ["z", "a", "b", "c"] and layers(["a", "b", "c"], ads) == {"a": 0, "b": 1, "c": 2}
    assert grouped_layers(["a", "b", "z"], ads) == [["z", "a"], ["b"]]
    assert explain("T", {"T": ["a", "b"]}, ads)["warning"] is None and explain("U", {}, ads)["order"] == []
    with pytest.raises(OrderError):
        execution_order(["p", "q"], {"p": Adapter("p", "x", depends_on=("q",)), "q": Adapter("q", "x", depends_on=("p",))})


def test_config_and_mapping_files(tmp_path):
    assert expand_env("${A} ${B}", {"A": "1"}) == "1 ${B}"
    ok = "version: 1\nadapters:\n- {id: a, type: sqlite}\n"
    assert parse_config(ok).adapters[0].kind == "sql"
    for text, code in ((ok.replace("1", "2"), "UnsupportedVersion"), ("version: 1", "NoAdaptersDefined"), (ok + "- {id: a, type: file}", "DuplicateAdapterId"), ("version: 1\nadapters:\n- {id: a, type: sqlite, depends_on: [a]}", "SelfDependency"), ("version: 1\nadapters:\n- {id: a, type: sqlite, depends_on: [b]}", "UnknownDependency"), (ok + "sources:\n- {id: s, type: stdin}\n- {id: s, type: stdin}", "DuplicateSourceId")):
        with pytest.raises(ConfigError) as e:
            parse_config(text)
        assert e.value.code == code
    (tmp_path / "a.yaml").write_text("event: X\ntable: t\nprimary_key: id\ncolumns: {id: payload.id}\n")
    assert load_dir("sql", tmp_path)["X"].primary_key == ("id",)
    (tmp_path / "b.yaml").write_text("event: X\ntable: t\n")
    with pytest.raises(MappingError):
        load_dir("sql", tmp_path)


def codes(p):
    return {i.code for i in issues(p.config, p.routes, p.mappings)}


def test_validation():
    assert codes(project_of(LIFE)) == set()
    doc = lambda **k: ("document", parse_mapping("document", {"event": "D", "collection": "c", "id": "payload.id", "document": {"a": "payload.a"}} | k))
    assert codes(project_of([("sql", sql("X", {"name": "payload.n"}))])) == {"InvalidSqlMapping"}
    assert codes(project_of([doc(operation="delete")], adapters=[Adapter("a", "file", capabilities=ALL)])) == {"InvalidDocumentMapping"}
    assert codes(project_of(LIFE, adapters=[Adapter("a", "sqlite")])) == {"CapabilityMismatch"}
    assert codes(project_of(LIFE[:1], {"Reg": ["a", "a", "x"]})) == {"DuplicateRoutingTarget", "UnknownAdapter"}
    assert codes(project_of([doc()], {"D": ["a"], "Y": ["a"]})) == {"MissingSqlMapping", "DocumentMappingNoFileTarget"}
    assert codes(project_of(LIFE[:1], {"Q": []})) == {"UnroutedSqlMapping"}
    assert codes(project_of(LIFE[:1], {"Reg": ["a"]}, [Adapter("a", "sqlite", depends_on=("b",)), Adapter("b", "sqlite")])) == {"DependencyNotOnRoute"}
    assert codes(project_of(LIFE[:1], adapters=[Adapter("a", "mysql", config={"url": "nope"}, capabilities=ALL)])) == {"InvalidMySqlConfig"}
    bad = [FACETS[0], ("sql", sql("R", {"id": "payload.id", "name": "payload.x"}, facet="f")), ("sql", sql("S", {"id": "payload.id"}, facet="g", on_existing="replace"))]
    assert codes(project_of(bad)) == {"FacetFieldOverlap", "FacetReplaceConflict", "FacetHasNoFields"}
    with pytest.raises(ValidationFailed):
        validate_event(project_of(LIFE[:1], {"Reg": ["x"]}).config, {"Reg": ["x"]}, project_of(LIFE).mappings, "Reg")


def test_sinks(spark, tmp_path):
    import sqlite3

    out, _ = run(spark, project_of(LIFE), [ev("Set", 1, "u1", name="x"), ev("Set", 1, "u2", name="y"), ev("Del", 2, "u2")])
    sink = SqliteSink(str(tmp_path / "db"), {"users": (["id"], ["id", "name"])})
    sink.apply(out.state, 0)
    sink.apply(out.state, 1)
    db = sqlite3.connect(tmp_path / "db")
    assert db.execute("select * from users").fetchall() == [("u1", "x")] and db.execute(f"select count(*), sum(deleted) from {GUARD_TABLE}").fetchone() == (2, 1)
    assert render_write("mysql", "t", ["a"], ["a", "b"], ["b"]).endswith("VALUES (?, ?) ON DUPLICATE KEY UPDATE b = VALUES(b)") and render_delete("postgres", "t", ["a", "b"]).endswith("a = $1 AND b = $2")
    reg = SinkRegistry().register("mine", lambda c: SqliteSink(c["path"], {}))
    assert isinstance(reg.build(Adapter("m", "mine", config={"path": "p"})), SqliteSink) and isinstance(reg.build(Adapter("m", "mine")), FailedSink) and isinstance(reg.build(Adapter("m", "other")), FailedSink)
    assert preview(from_rows(spark, [ev("Set", 1, name="x")]), "sql", {m.event: m for _, m in LIFE}).first().entity_key == '["u1"]'
