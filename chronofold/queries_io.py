"""Registered queries of sources, sinks, the store, streams and the rarer rules, each with the SQL that gives the same rows."""

from __future__ import annotations

import sqlite3
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import jsonpath as J
from chronofold.operators import fold
from chronofold.operators.project import preview
from chronofold.plans.config import Adapter, Config, Project, SourceConfig
from chronofold.plans.mapping import parse_mapping
from chronofold.plans.runner import Projector, counters
from chronofold.queries import ALL, ARRIVAL, MIX, REPLACE, _maps, envelopes, projector, query, steps_sql, table, user_row, users_of
from chronofold.sinks.store import GUARD_TABLE, JdbcSink, JsonTreeSink, SnapshotStore, SqliteSink, dead_letters, render_command, type_errors, write_dead_letters
from chronofold.sources.envelope import decode_wire, split_envelopes
from chronofold.sources.files import directory_batch, numbered_stream, replay_events
from chronofold.sources.stream import event_files
from chronofold.streaming.live import run_stream, stateful_fold, use_rocksdb

IN_ORDER = steps_sql().replace(ARRIVAL, "event_id")
SORTED = 1 << 18  # rows that one task sorts for a file
LATEST = "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id"


@lru_cache(1)
def _local() -> str:
    return tempfile.mkdtemp(prefix="chronofold-queries-")


def work(spark: SparkSession) -> str:
    """A new folder name that all machines share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or (_local() if spark.sparkContext.master.startswith("local") else None)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{root.rstrip('/')}/chronofold-{uuid.uuid4().hex}"


def written(spark, d, files: int = 1, scrambled: bool = False) -> str:
    """The events as envelope files of JSON lines, in the order of their ids by file name."""
    out = work(spark)
    e = envelopes(spark, d, scrambled).select("event_id", "event_type", "payload", "metadata", "version", F.col("sequence").cast("bigint").alias("sequence"))
    parts = work(spark)
    n = max(files, e.count() // SORTED + 1)  # a task sorts a part, whatever the number of files
    e.repartitionByRange(n, "sequence").sortWithinPartitions("sequence").write.json(parts)
    joined(spark, parts, out, files)
    return out


def joined(spark, parts: str, out: str, files: int) -> None:
    """The files of a folder, in name order, joined to ``files`` files: bytes are copied in a stream, whatever the size."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(path(parts)) if f.getPath().getName().startswith("part-"))
    for i in range(files):
        to = fs.create(path(f"{out}/part-{i:05d}.json"), False)
        try:
            for name in names[i * len(names) // files : (i + 1) * len(names) // files]:
                source = fs.open(path(f"{parts}/{name}"))
                try:
                    jvm.org.apache.commons.io.IOUtils.copyLarge(source, to)
                finally:
                    source.close()
        finally:
            to.close()
    fs.delete(path(parts), True)


def long_id(df: DataFrame, *rest) -> DataFrame:
    return df.select(F.col("event_id").cast("long").alias("event_id"), *rest)



def outcome():
    return F.coalesce("reason", "outcome").alias("outcome")


@query(IN_ORDER + "SELECT event_id, outcome FROM f")
def replay_file(spark, d):
    """A file of events, one JSON object a line, replayed in sequence order."""
    folder = written(spark, d)
    name = event_files(folder)[0]
    return long_id(projector(spark, MIX).replay(replay_events(spark, f"{folder}/{name}")).outcomes, outcome())


@query("SELECT event_id, event_type, user_id FROM events")
def directory_poll(spark, d):
    """All files after the first one, as the directory source polls them in name order."""
    folder = written(spark, d, 4)
    first, _, end = directory_batch(spark, folder, None, 1)
    rest, rejects, _ = directory_batch(spark, folder, end, 1 << 40)
    whole = first.unionByName(rest).join(rejects.select("position"), "position", "left_anti")
    return long_id(whole, "event_type", F.get_json_object("payload", "$.user_id").cast("long").alias("user_id"))


def _looped(spark, source: SourceConfig, ms=REPLACE, **kw) -> SnapshotStore:
    out = work(spark)
    project = Project(Config((Adapter("main", "sqlite", capabilities=ALL),), sources=(source,)), _maps(ms), {m.event: ["main"] for _, m in ms})
    store = SnapshotStore(spark, f"{out}/store", 8)
    Projector(spark, project).run_sources(store, f"{_local()}/{uuid.uuid4().hex}", f"{out}/dlq", **kw)
    return store


@query(LATEST)
def directory_loop(spark, d):
    """The source loop: polls, folds onto the store and commits, batch by batch."""
    store = _looped(spark, SourceConfig("s", "directory", written(spark, d, 3)), max_batch=1)
    return users_of(store.state(), "user_id", "value")


@query(LATEST)
def stdin_loop(spark, d):
    lines = envelopes(spark, d).select(F.to_json(F.struct("event_id", "event_type", "payload", "metadata", "version", F.col("sequence").cast("bigint").alias("sequence"))).alias("x")).orderBy(F.get_json_object("x", "$.sequence").cast("long"))
    store = _looped(spark, SourceConfig("in", "stdin"), max_batch=1 << 16, stdin=(r.x for r in lines.toLocalIterator()))
    return users_of(store.state(), "user_id", "value")


@query("SELECT event_id AS n, CASE event_id % 3 WHEN 0 THEN 'id' || event_id WHEN 1 THEN 'p' || event_id ELSE event_type || '-' || event_id END AS event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE event_id % 5 + 1 END::INT AS version FROM events")
def wire_decode(spark, d):
    e = table(spark, d, "events").selectExpr("event_id n", "if(event_id % 3 = 0, concat('id', event_id), '') event_id", "if(event_id % 3 = 1, concat('p', event_id), '') position", "event_type", "event_id sequence", "cast(if(event_id % 2 = 0, 0, event_id % 5 + 1) as int) version")
    return decode_wire(e).select("n", "event_id", F.col("version").cast("int").alias("version"))


@query("SELECT user_id::VARCHAR AS user_id, value FROM (SELECT user_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS t FROM events GROUP BY user_id) WHERE t != 'error'")
def sqlite_rows(spark, d):
    """A SQLite read model after two batches, read back."""
    ms = [*REPLACE[:4], user_row("error", operation="delete")]
    p, path = projector(spark, ms), f"{_local()}/{uuid.uuid4().hex}.db"
    store, sink = SnapshotStore(spark, work(spark), 8), SqliteSink(path, {"users": (["user_id"], ["user_id", "value"])})
    e = envelopes(spark, d)
    for i, part in enumerate((e.where("line_no % 2 = 0"), e.where("line_no % 2 = 1"))):
        p.commit(part, store, i, {"main": sink}).unpersist()
    rows = sqlite3.connect(path).execute("SELECT user_id, value FROM users").fetchall()  # one row a user
    return spark.createDataFrame([(a, float(b)) for a, b in rows], "user_id string, value double")


@query(steps_sql() + "SELECT user_id, last AS last_sequence, dead AS deleted FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1")
def json_tree_guards(spark, d):
    """Guard rows beside the documents of a JSON tree, after two batches."""
    p, root = projector(spark, MIX), work(spark)
    store, sink = SnapshotStore(spark, f"{root}/s", 8), JsonTreeSink(spark, f"{root}/t", 8)
    e = envelopes(spark, d, scrambled=True)
    for i, part in enumerate((e.where("batch_id < 500000"), e.where("batch_id >= 500000"))):
        p.commit(part, store, i, {"main": sink}, ordered=True).unpersist()
    g = spark.read.schema("target string, entity_key string, facet string, last_sequence decimal(20,0), last_event_id string, deleted boolean, permanent boolean").json(f"{root}/t/guards")
    return g.select(F.get_json_object("entity_key", "$[0]").cast("long").alias("user_id"), F.col("last_sequence").cast("long").alias("last_sequence"), "deleted")


@query(steps_sql() + "SELECT user_id FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1 AND dead")
def jdbc_deletes(spark, d):
    """Keys that the JDBC sink stages for its delete."""
    sink = JdbcSink("", "postgres", {"users": (["user_id"], ["user_id", "value"])}, print, types={"users": {"user_id": "bigint", "value": "double"}})
    return sink.staged(projector(spark, MIX).apply(envelopes(spark, d, scrambled=True)).state)["users_gone"]


@query(steps_sql() + "SELECT 'users' AS target_table, '[' || user_id || ']' AS entity_key, last AS last_sequence, dead AS deleted FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1")
def jdbc_guards(spark, d):
    sink = JdbcSink("", "mysql", {"users": (["user_id"], ["user_id", "value"])}, print)
    g = sink.staged(projector(spark, MIX).apply(envelopes(spark, d, scrambled=True)).state)[f"{GUARD_TABLE}_stage"]
    return g.select("target_table", "entity_key", F.col("last_sequence").cast("long").alias("last_sequence"), "deleted")


@query(steps_sql() + """SELECT CASE WHEN dead THEN 'DEL' ELSE 'SET' END || ' "users:[' || user_id || ']"' AS command FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1""")
def keyvalue_commands(spark, d):
    """The commands for a key-value server, up to the body."""
    s = projector(spark, MIX).apply(envelopes(spark, d, scrambled=True)).state
    return s.select(F.regexp_extract(render_command("redis"), r'^(\w+ "[^"]*")', 1).alias("command"))


@query("SELECT event_id, '[' || user_id || ']' AS entity_key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS operation FROM events WHERE event_type IN ('signup', 'purchase', 'error')")
def preview_writes(spark, d):
    rows = preview(envelopes(spark, d), "sql", {m.event: m for _, m in MIX})
    return long_id(rows, "entity_key", "operation")


@query(steps_sql() + "SELECT a AS adapter_id, outcome, count(*) AS n FROM f, (VALUES ('one'), ('two')) t(a) GROUP BY ALL")
def two_adapters_of_a_kind(spark, d):
    ads = (Adapter("one", "sqlite", 1, capabilities=ALL), Adapter("two", "sqlite", 2, capabilities=ALL))
    p = projector(spark, MIX, {m.event: ["two", "one"] for _, m in MIX}, ads)
    return p.apply(envelopes(spark, d, scrambled=True)).outcomes.groupBy("adapter_id", outcome()).agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'write_failed' ELSE 'ok' END AS outcome FROM events WHERE event_type IN ('view', 'purchase')")
def missing_mapping(spark, d):
    project = Project(Config((Adapter("main", "sqlite", capabilities=ALL),)), _maps([user_row("purchase", on_existing="replace")]), {"view": ["main"], "purchase": ["main"]})
    o = Projector(spark, project, check=False).apply(envelopes(spark, d)).outcomes
    return long_id(o, F.when(F.col("outcome") == "failed", F.col("reason")).otherwise("ok").alias("outcome"))


def _documents(kind: str) -> list:
    key = {"document": {"collection": "users", "id": "payload.user_id"}, "keyvalue": {"namespace": "users", "key": "payload.user_id"}}[kind]
    body = {"document" if kind == "document" else "value": {"value": "payload.value"}}
    return [(kind, parse_mapping(kind, {"event": m.event, "operation": m.operation, "on_existing": m.on_existing} | key | (body if m.operation == "upsert" else {}))) for _, m in MIX]


@query(steps_sql() + "SELECT event_id, outcome FROM f")
def document_lifecycle(spark, d):
    """Inserts, updates, deletes and resurrections of documents."""
    p = projector(spark, _documents("document"), adapters=(Adapter("main", "file", capabilities=ALL),))
    return long_id(p.apply(envelopes(spark, d, scrambled=True)).outcomes, outcome())


@query(steps_sql() + "SELECT user_id, dead AS deleted, last_event AS last_event_id FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1")
def keyvalue_lifecycle(spark, d):
    p = projector(spark, _documents("keyvalue"), adapters=(Adapter("main", "keyvalue", capabilities=ALL),))
    g = p.apply(envelopes(spark, d, scrambled=True)).guards
    return g.select(F.col("entity_key").cast("long").alias("user_id"), "deleted", F.col("last_event_id").cast("long").alias("last_event_id"))


@query(f"""SELECT user_id, arg_min(event_id, {ARRIVAL}) AS event_id, seq FROM (SELECT *, event_id // 50 AS seq, max(event_id // 50) OVER (PARTITION BY user_id) AS top FROM events) WHERE seq = top GROUP BY user_id, seq""")
def sequence_ties(spark, d):
    """Events that share a sequence: the first to arrive counts."""
    e = envelopes(spark, d, scrambled=True).withColumn("sequence", F.floor((F.col("sequence") - 1) / 50).cast("decimal(20,0)"))
    g = projector(spark, REPLACE).apply(e).guards
    return g.select(F.get_json_object("entity_key", "$[0]").cast("long").alias("user_id"), F.col("last_event_id").cast("long").alias("event_id"), F.col("last_sequence").cast("long").alias("seq"))


@query("SELECT user_id, 'value: no bigint: ' || t AS error FROM (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY user_id) WHERE t != 'view'")
def typed_errors(spark, d):
    """Rows whose value is not of its column's type are refused, not set to NULL."""
    e = envelopes(spark, d, payload="named_struct('user_id', user_id, 'value', if(event_type = 'view', '7', event_type))")
    found = type_errors(projector(spark, REPLACE).apply(e).state, "users", {"value": "bigint", "user_id": "bigint"})
    return found.select(F.get_json_object("entity_key", "$[0]").cast("long").alias("user_id"), "error")


@query(LATEST)
def stream_to_store(spark, d):
    """A directory stream in micro-batches onto the store, until caught up."""
    out = work(spark)
    store = SnapshotStore(spark, f"{out}/store", 8)
    q = run_stream(projector(spark, REPLACE), written(spark, d, 3), store, f"{out}/c", files_per_trigger=1)
    q.awaitTermination()
    return users_of(store.state(), "user_id", "value")


@query(IN_ORDER + "SELECT event_id, outcome FROM f")
def stateful_stream(spark, d):
    """The keyed stateful fold of a stream; its outcomes, as its sink kept them."""
    out, key = work(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    use_rocksdb(spark)
    try:
        events = split_envelopes(numbered_stream(spark, written(spark, d, 3), 1))[0]
        rows = stateful_fold(fold.fold_input(projector(spark, MIX).projected(events)))
        q = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return long_id(spark.read.parquet(f"{out}/rows"), outcome())


@query(steps_sql() + "SELECT user_id, last AS last_sequence, dead AS deleted FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1")
def store_batches(spark, d):
    """Three batches onto the bucketed store, one of them given twice."""
    p, store = projector(spark, MIX), SnapshotStore(spark, work(spark), 8)
    e = envelopes(spark, d, scrambled=True)
    for i, (lo, hi) in enumerate(((0, 300000), (300000, 700000), (700000, 1 << 40))):
        for _ in range(1 + (i == 1)):
            p.commit(e.where(f"batch_id >= {lo} and batch_id < {hi}"), store, i, ordered=True).unpersist()
    g = fold.guards(store.state())
    return g.select(F.get_json_object("entity_key", "$[0]").cast("long").alias("user_id"), F.col("last_sequence").cast("long").alias("last_sequence"), "deleted")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'signup') AND value < 20")
def dlq_files(spark, d):
    """Dead letters of events without a position, written twice, read back."""
    ms = [("sql", parse_mapping("sql", {"event": t, "table": "users", "primary_key": "user_id", "columns": {"user_id": "payload.user_id", "value": "payload.good"}, "on_existing": "replace"})) for t in ("click", "signup")]
    e = envelopes(spark, d).withColumns({"payload": F.when(F.get_json_object("payload", "$.value").cast("double") < 20, F.to_json(F.struct(F.get_json_object("payload", "$.user_id").alias("user_id")))).otherwise(F.to_json(F.struct(F.get_json_object("payload", "$.user_id").alias("user_id"), F.lit(1).alias("good")))), "position": F.lit(None).cast("string")})
    out, p = work(spark), projector(spark, ms, failure_policy="continue_on_error")
    for _ in range(2):
        write_dead_letters(dead_letters(e, p.apply(e).outcomes), out, "s/0")
    return long_id(spark.read.json(f"{out}/events/s/0"), "event_type")


@query("""SELECT event_type, '[\"' || event_type || '\"]' AS quoted, lower(hex(event_type)) AS hex_key, regexp_replace(props, '[^A-Za-z0-9_-]', '_', 'g') AS file_name, count(*) AS n FROM events GROUP BY ALL""")
def scalar_functions(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", J.json_key([F.col("event_type")]).alias("quoted"), J.hex_key(F.col("event_type")).alias("hex_key"), J.safe_file_name(F.col("props")).alias("file_name")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN event_type = 'signup' AND event_id % 2 = 1 THEN 'k' ELSE 'd' END AS last_adapter FROM events WHERE event_type IN ('purchase', 'signup')""")
def fold_failure_stops(spark, d):
    """A facet that meets a body that is no object fails in the fold: adapters after it are not run for that event."""
    kv = lambda e, **k: ("keyvalue", parse_mapping("keyvalue", {"event": e, "namespace": "n", "key": "payload.event", "value": "payload.v", "on_existing": "replace"} | k))
    doc = lambda e: ("document", parse_mapping("document", {"event": e, "collection": "c", "id": "payload.event", "document": {"v": "payload.event"}, "on_existing": "replace"}))
    ms = [kv("base"), kv("signup", facet="f"), kv("purchase"), doc("signup"), doc("purchase")]
    routes = {"base": ["k"], "signup": ["k", "d"], "purchase": ["k", "d"]}
    project = Project(Config((Adapter("k", "keyvalue", 1, capabilities=ALL), Adapter("d", "file", 2, capabilities=ALL))), _maps(ms), routes)
    e = envelopes(spark, d, payload="named_struct('event', event_id, 'v', named_struct('x', value))")
    # every signup has a base event before it, whose body is an object for even ids and a number for odd ones
    n = F.col("event_id").cast("long")
    base = e.where("event_type = 'signup'").withColumns({"payload": F.when(n % 2 == 0, F.concat(F.lit('{"event":'), n, F.lit(',"v":{"y":1}}'))).otherwise(F.concat(F.lit('{"event":'), n, F.lit(',"v":7}'))), "event_type": F.lit("base"), "sequence": F.lit(0).cast("decimal(20,0)")})
    o = Projector(spark, project, check=False).apply(e.where("event_type in ('signup', 'purchase')").unionByName(base)).outcomes
    return long_id(o.where("event_type != 'base'").groupBy("event_id").agg(F.max_by("adapter_id", "adapter_order").alias("last_adapter")), "last_adapter")


@query("SELECT source, sum(n)::BIGINT AS n FROM (SELECT 'a' AS source, count(*) AS n FROM events WHERE event_type IN ('signup', 'purchase', 'error') UNION ALL SELECT 'b', count(*) FROM events WHERE event_type IN ('signup', 'purchase', 'error')) GROUP BY source")
def batch_ids_by_source(spark, d):
    """Two sources with the same batch ids on one store: none hides the other."""
    p, store = projector(spark, MIX), SnapshotStore(spark, work(spark), 8)
    rows = []
    for name in ("a", "b", "a"):
        if store.last_batch(name) < 0:
            out = p.commit(envelopes(spark, d), store, 0, source=name)
            row = counters(out).first()
            out.unpersist()
            rows.append((name, sum(row[c] for c in ("created", "updated", "deleted", "skipped", "failed"))))
    return spark.createDataFrame(rows, "source string, n long")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 3 THEN 'ok' ELSE 'not JSON' END AS verdict FROM events""")
def trailing_text(spark, d):
    """A record is one JSON value: what follows it makes it a reject, blanks apart."""
    e = table(spark, d, "events")
    ok = F.concat(F.lit('{"event_id":"'), F.col("event_id"), F.lit('","event_type":"T","payload":"{}","metadata":{},"sequence":'), F.col("event_id"), F.lit("}"))
    value = F.concat(ok, F.when(F.col("event_id") % 4 == 1, "}").when(F.col("event_id") % 4 == 2, ' {"more":1}').when(F.col("event_id") % 4 == 3, "  ").otherwise(""))
    good, bad = split_envelopes(e.select(value.alias("value"), F.lit("s").alias("source_id"), F.lit("").alias("position"), F.col("event_id").alias("line_no"), F.lit(0).cast("long").alias("batch_id")))
    return good.select(F.col("line_no").alias("event_id"), F.lit("ok").alias("verdict")).unionByName(bad.select(F.col("line_no").alias("event_id"), F.col("reason").alias("verdict")))
