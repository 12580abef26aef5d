"""Sinks: a versioned snapshot store, SQL stores, JSON trees, custom factories and the dead-letter queue."""

from __future__ import annotations

import json
import sqlite3
import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import jsonpath as J
from chronofold.operators.fold import guards

GUARD_TABLE = "chronofold_projection_state"
KEPT = 16  # batches whose outcomes can be read again
STATE = "adapter_id string, kind string, target string, entity_key string, live boolean, body string, lanes string, ends string, reason string"


class Sink(Protocol):
    def apply(self, state: DataFrame, batch_id: int) -> None:
        """Write the touched entities of one batch; a repeated batch changes nothing."""


class SnapshotStore:
    """State as Parquet in buckets by key hash, behind numbered version files: guard and body change together or not at all.

    A batch reads and rewrites only the buckets of the keys that it touches. A version file is written beside, then renamed to
    a name that did not exist: a crash leaves the version before. It holds the data version of each bucket and the last
    batch id of each source, so batch ids of a stream and of single runs do not mix. One writer at a time.
    ``buckets`` counts for a new store; choose it so that one bucket fits a task.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self._new = spark, root.rstrip("/"), buckets
        self._scratch: list[str] = []
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def scratch(self) -> str:
        """A new folder for the steps of one batch. Those of the last KEPT batches stay readable, unless ``drop`` is called before."""
        self._scratch.append(f"{self.root}/work/{uuid.uuid4().hex}")
        for old in self._scratch[:-KEPT]:
            self.drop(old)
        return self._scratch[-1]

    def drop(self, scratch: str) -> None:
        self._fs.delete(self._path(scratch), True)
        self._scratch = [x for x in self._scratch if x != scratch]

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _pointer(self) -> dict:
        versions = self._versions()
        if not versions:
            return {"version": 0, "sources": {}, "n": self._new, "buckets": {}, "before": {}}
        stream = self._fs.open(self._path(f"{self.root}/versions/{versions[-1]:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last_batch(self, source: str = "run") -> int:
        return self._pointer()["sources"].get(source, -1)

    @property
    def batch_id(self) -> int:
        return self.last_batch()

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64("adapter_id", "target", "entity_key"), F.lit(n)).cast("int")

    def _read(self, now: dict, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/data/v{v}/bucket={b}" for b, v in now["buckets"].items() if v and (buckets is None or int(b) in buckets)]
        if paths:
            return self.spark.read.schema(STATE).parquet(*paths)
        return self.spark.range(0).selectExpr(*["cast(null as {1}) {0}".format(*c.split()) for c in STATE.split(", ")])  # rows of Python start a worker a task

    def state(self) -> DataFrame:
        return self._read(self._pointer())

    def relevant(self, writes: DataFrame) -> DataFrame | None:
        """Earlier rows that the writes (FOLD_IN rows) can change or depend on; None if there are none.

        Their own entities; for nodes the edges at them, for edges the nodes at their ends.
        """
        now = self._pointer()
        if not any(now["buckets"].values()):
            return None
        n = now["n"]
        key = ["adapter_id", "target", "entity_key"]
        keys = writes.select(*key).distinct()
        ends = writes.where("kind = 'edge'").select("adapter_id", F.explode(F.from_json("ends", "array<string>")).alias("node")).distinct()
        nodes = writes.where("kind = 'node'").select("adapter_id", F.col("entity_key").alias("node")).distinct()
        places = writes.select("kind", self._bucket(n).alias("b")).distinct().collect()  # a few kinds, n numbers at most
        graph = {r.kind for r in places} & {"node", "edge"}
        touched = self._read(now, sorted({r.b for r in places}))
        own = touched.join(keys, key, "left_semi")
        if not graph:
            return own
        # edges are found by a scan of key and ends alone, nodes by id under any label
        rows = self._read(now)
        edges = rows.where("kind = 'edge'").select(*key, F.explode(F.from_json("ends", "array<string>")).alias("node"))
        at = edges.join(nodes, ["adapter_id", "node"], "left_semi").select(*key).distinct()
        found = rows.where("kind = 'edge'").join(at, key, "left_semi")
        known = found.select("adapter_id", F.explode(F.from_json("ends", "array<string>")).alias("node")).unionByName(ends).distinct()
        near = rows.where("kind = 'node'").join(known, (rows["adapter_id"] == known["adapter_id"]) & (rows["entity_key"] == known["node"]), "left_semi")
        return own.unionByName(found).unionByName(near).dropDuplicates(key)

    def apply(self, state: DataFrame, batch_id: int, source: str = "run") -> None:
        """Publish changed entities as the next version; a batch id of the source that is already there changes nothing."""
        now = self._pointer()
        if batch_id <= now["sources"].get(source, -1):
            return
        n, version = now["n"], now["version"] + 1
        changed = state.select(*[c.split()[0] for c in STATE.split(", ")])
        touched = [r.b for r in changed.select(self._bucket(n).alias("b")).distinct().collect()]  # n numbers at most
        if touched:
            rest = self._read(now, touched).join(changed, ["adapter_id", "target", "entity_key"], "left_anti")
            rest.unionByName(changed).withColumn("bucket", self._bucket(n)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/v{version}")
        buckets, names = now["buckets"] | {str(b): version for b in touched}, [str(b) for b in touched]
        before = now["before"] | {b: now["buckets"].get(b, 0) for b in names}
        self._publish({"version": version, "sources": now["sources"] | {source: batch_id}, "n": n, "buckets": buckets, "before": before})
        # what neither this version nor the one before needs goes; a reader of the one before may still be at work
        for b in names:
            if now["before"].get(b):
                self._fs.delete(self._path(f"{self.root}/data/v{now['before'][b]}/bucket={b}"), True)
        for v in self._versions()[:-2]:
            self._fs.delete(self._path(f"{self.root}/versions/{v:012d}.json"), False)

    def _publish(self, pointer: dict) -> None:
        name = f"{self.root}/versions/{pointer['version']:012d}.json"
        part = self._path(f"{name}.tmp")
        out = self._fs.create(part, True)
        out.write(json.dumps(pointer).encode())
        out.close()
        if not self._fs.rename(part, self._path(name)):
            raise OSError(f"cannot publish {name}")


def rows_of(state: DataFrame, target: str, columns: list[str], types: dict[str, str] | None = None, null_text: bool = False) -> DataFrame:
    """Live rows of one SQL target with typed columns. ``null_text``: JSON null as '' (text stores).

    A value that is not of its column's type is NULL here; ``type_errors`` finds such rows, and writing sinks refuse them.
    """
    types = types or {}
    out = [_text_of(c, null_text).try_cast(types.get(c, "string")).alias(c) for c in columns]
    return state.where((F.col("target") == target) & F.col("live")).select(*out)


def _text_of(column: str, null_text: bool = False) -> Column:
    x = F.variant_get(F.try_parse_json("body"), J.quoted_key(column), "variant")
    return J.text(x) if null_text else F.when(F.schema_of_variant(x) != "VOID", J.text(x))


def type_errors(state: DataFrame, target: str, types: dict[str, str]) -> DataFrame:
    """(entity_key, error) of live rows of a target with a value that cannot be read as its column's type."""
    errors = F.array_compact(F.array(*[F.when(_text_of(c).isNotNull() & _text_of(c).try_cast(t).isNull(), F.concat(F.lit(f"{c}: no {t}: "), _text_of(c))) for c, t in types.items()])) if types else F.array().cast("array<string>")
    return state.where((F.col("target") == target) & F.col("live")).select("entity_key", F.concat_ws("; ", errors).alias("error")).where("error != ''")


def documents_of(state: DataFrame) -> DataFrame:
    return state.where("live").select("target", "entity_key", "body")


def render_write(dialect: str, table: str, key: list[str], columns: list[str], replace: list[str] | None) -> str:
    """Insert for a dialect; ``replace``: columns that an existing row takes over."""
    marks = {"sqlite": lambda i: f"?{i}", "postgres": lambda i: f"${i}", "mysql": lambda i: "?"}[dialect]
    sql = f"INSERT INTO {table} ({', '.join(columns)}) VALUES ({', '.join(marks(i + 1) for i in range(len(columns)))})"
    if replace:
        if dialect == "mysql":
            return sql + " ON DUPLICATE KEY UPDATE " + ", ".join(f"{c} = VALUES({c})" for c in replace)
        return sql + f" ON CONFLICT ({', '.join(key)}) DO UPDATE SET " + ", ".join(f"{c} = excluded.{c}" for c in replace)
    return sql


def render_delete(dialect: str, table: str, key: list[str]) -> str:
    marks = {"sqlite": lambda i: f"?{i}", "postgres": lambda i: f"${i}", "mysql": lambda i: "?"}[dialect]
    return f"DELETE FROM {table} WHERE " + " AND ".join(f"{k} = {marks(i + 1)}" for i, k in enumerate(key))


class SinkError(RuntimeError):
    """A sink could not write; the batch is tried again."""


class SqliteSink:
    """One SQLite file, written by the driver in one transaction: changed rows stream in, they are not collected.

    For read models that fit one SQLite file. Values bind as text, JSON null as ''.
    """

    def __init__(self, path: str, tables: dict[str, tuple[list[str], list[str]]]):
        """tables: target -> (key columns, columns)."""
        self.path, self.tables = path, tables

    def apply(self, state: DataFrame, batch_id: int) -> None:
        db = sqlite3.connect(self.path)
        try:
            with db:
                db.execute(f"CREATE TABLE IF NOT EXISTS {GUARD_TABLE} (target_table TEXT, entity_key TEXT, facet TEXT, last_sequence TEXT, last_event_id TEXT, deleted INTEGER, permanent INTEGER, PRIMARY KEY (target_table, entity_key, facet))")
                for target, (key, columns) in self.tables.items():
                    db.execute(f"CREATE TABLE IF NOT EXISTS {target} ({', '.join(f'{c} TEXT' for c in columns)}, PRIMARY KEY ({', '.join(key)}))")
                    own = state.where(F.col("target") == target)
                    remove, write = render_delete("sqlite", target, key), render_write("sqlite", target, key, columns, [c for c in columns if c not in key] or key)
                    for r in own.where("not live").select("entity_key").toLocalIterator():
                        db.execute(remove, [_text(x) for x in json.loads(r.entity_key)])
                    for r in rows_of(state, target, columns, null_text=True).toLocalIterator():
                        db.execute(write, list(r))
                for r in guards(state.where(F.col("target").isin(list(self.tables)))).toLocalIterator():
                    db.execute(f"INSERT OR REPLACE INTO {GUARD_TABLE} VALUES (?,?,?,?,?,?,?)", (r.target, r.entity_key, r.facet, str(r.last_sequence), r.last_event_id, int(r.deleted), int(r.permanent)))
        except sqlite3.Error as e:
            raise SinkError(f"{self.path}: {e}") from e
        finally:
            db.close()


def _text(x) -> str:
    return x if isinstance(x, str) else json.dumps(x)


class JdbcSink:
    """Staging tables by Spark's JDBC writer, then per target one delete and one upsert, and the guard rows, in one transaction.

    ``types``: target -> column -> type of the target table; a value of another type fails the batch before anything is
    written. ``execute`` runs a list of statements in one transaction.
    """

    def __init__(self, url: str, dialect: str, tables: dict[str, tuple[list[str], list[str]]], execute: Callable[[list[str]], None], properties: dict | None = None, types: dict[str, dict[str, str]] | None = None):
        self.url, self.dialect, self.tables, self.execute, self.properties, self.types = url, dialect, tables, execute, properties or {}, types or {}

    def staged(self, state: DataFrame) -> dict[str, DataFrame]:
        """Staging table name -> rows: live rows, keys that are no more, and guard rows."""
        out = {}
        for target, (key, columns) in self.tables.items():
            bad = type_errors(state, target, self.types.get(target, {})).first()
            if bad is not None:
                raise SinkError(f"{target} {bad.entity_key}: {bad.error}")
            types = self.types.get(target, {})
            out[f"{target}_stage"] = rows_of(state, target, columns, types)
            gone = state.where((F.col("target") == target) & ~F.col("live"))
            v = F.try_parse_json("entity_key")
            out[f"{target}_gone"] = gone.select(*[J.text(F.variant_get(v, f"$[{i}]", "variant")).cast(types.get(k, "string")).alias(k) for i, k in enumerate(key)])
        lanes = guards(state.where(F.col("target").isin(list(self.tables))))
        out[f"{GUARD_TABLE}_stage"] = lanes.select(F.col("target").alias("target_table"), *[c for c in GUARD_COLUMNS if c != "target_table"])
        return out

    def apply(self, state: DataFrame, batch_id: int) -> None:
        try:
            for name, rows in self.staged(state).items():
                rows.write.jdbc(self.url, name, mode="overwrite", properties=self.properties)
            self.execute(self.statements())
        except SinkError:
            raise
        except Exception as e:  # noqa: BLE001  drivers raise types of their own
            raise SinkError(f"{self.url}: {e}") from e

    def _upsert(self, table: str, stage: str, key: list[str], columns: list[str]) -> str:
        rest, names = [c for c in columns if c not in key] or key, ", ".join(columns)
        if self.dialect == "mysql":
            tail = "ON DUPLICATE KEY UPDATE " + ", ".join(f"{c} = VALUES({c})" for c in rest)
        else:
            tail = f"ON CONFLICT ({', '.join(key)}) DO UPDATE SET " + ", ".join(f"{c} = excluded.{c}" for c in rest)
        return f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage} WHERE true {tail}"

    def statements(self) -> list[str]:
        text = "VARCHAR(512)" if self.dialect == "mysql" else "TEXT"
        guard = f"CREATE TABLE IF NOT EXISTS {GUARD_TABLE} (target_table {text}, entity_key {text}, facet {text}, last_sequence DECIMAL(20,0), last_event_id {text}, deleted BOOLEAN, permanent BOOLEAN, PRIMARY KEY (target_table, entity_key, facet))"
        out = [guard]
        for target, (key, columns) in self.tables.items():
            same = " AND ".join(f"{target}_gone.{k} = {target}.{k}" for k in key)
            out += [f"DELETE FROM {target} WHERE EXISTS (SELECT 1 FROM {target}_gone WHERE {same})", self._upsert(target, f"{target}_stage", key, columns)]
        out.append(self._upsert(GUARD_TABLE, f"{GUARD_TABLE}_stage", list(GUARD_COLUMNS[:3]), list(GUARD_COLUMNS)))
        return out + [f"DROP TABLE {t}" for target in self.tables for t in (f"{target}_stage", f"{target}_gone")] + [f"DROP TABLE {GUARD_TABLE}_stage"]


GUARD_COLUMNS = ("target_table", "entity_key", "facet", "last_sequence", "last_event_id", "deleted", "permanent")


class JsonTreeSink:
    """Live documents, values, nodes or edges as JSON files, one folder per target and key bucket, and their guard rows beside.

    A batch rewrites the folders of the buckets of its own keys: live entities stay, deleted ones go.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.store = SnapshotStore(spark, f"{root.rstrip('/')}/.state", buckets)
        self.spark, self.root = spark, root.rstrip("/")

    def apply(self, state: DataFrame, batch_id: int) -> None:
        self.store.apply(state, self.store.batch_id + 1)
        n = self.store._pointer()["n"]
        at = lambda df: df.withColumn("bucket", self.store._bucket(n))
        keys = at(state).select("target", "bucket").distinct()
        whole = at(self.store.state()).join(keys, ["target", "bucket"], "left_semi")
        self._write(whole.where("live").select("target", "bucket", "entity_key", "body"), keys, "data")
        lanes = guards(whole).withColumn("bucket", self.store._bucket(n))
        self._write(lanes.drop("adapter_id"), keys, "guards")

    def _write(self, rows: DataFrame, keys: DataFrame, name: str) -> None:
        jvm, root = self.spark._jvm, f"{self.root}/{name}"
        fs_path = jvm.org.apache.hadoop.fs.Path
        fs = fs_path(root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        have = {(r.target, r.bucket) for r in rows.select("target", "bucket").distinct().collect()}  # targets x buckets
        rows.repartition("target", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("target", "bucket").json(root)
        for r in keys.collect():
            if (r.target, r.bucket) not in have:  # nothing live is left
                fs.delete(fs_path(f"{root}/target={jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(r.target)}/bucket={r.bucket}"), True)


class CommandSink:
    """Renders each changed entity as one command of a document, key-value or graph server and hands batches of them to ``send``.

    ``send`` runs on the executors, per batch of rows, so it must open its own connection there. Commands are idempotent: a guard with
    a sequence that is not older decides on the server, as the rendered text says.
    """

    def __init__(self, kind: str, send: Callable[[list[str]], None]):
        self.kind, self.send = kind, send

    def commands(self, state: DataFrame) -> DataFrame:
        return state.select(render_command(self.kind).alias("command")).where("command is not null")

    def apply(self, state: DataFrame, batch_id: int) -> None:
        send = self.send

        def each(rows) -> None:
            part: list[str] = []
            for r in rows:
                part.append(r.command)
                if len(part) == 500:
                    send(part)
                    part = []
            if part:
                send(part)

        try:
            self.commands(state).foreachPartition(each)
        except Exception as e:  # noqa: BLE001  a client may fail in any way
            raise SinkError(str(e)) from e


def render_command(kind: str) -> Column:
    """The command that brings an entity's changed state to a server, as text, by the state's columns.

    ``redis``: SET or DEL with a guard hash; ``mongodb``: an update with upsert, or a delete; ``neo4j``: MERGE or DELETE of a node or edge.
    """
    q = lambda c: F.substring(F.to_json(F.array(c)), 2, 1 << 30)  # noqa: E731  JSON text with a closing bracket
    text = lambda c: F.substring(q(c), F.lit(1), F.length(q(c)) - 1)
    name, body, lanes = F.concat_ws(":", "target", "entity_key"), F.coalesce("body", F.lit("null")), F.coalesce("lanes", F.lit("{}"))
    if kind == "redis":
        guard = F.concat(F.lit("HSET chronofold:guard "), text(name), F.lit(" "), text(lanes))
        return F.concat(F.when(F.col("live"), F.concat(F.lit("SET "), text(name), F.lit(" "), text(body))).otherwise(F.concat(F.lit("DEL "), text(name))), F.lit("; "), guard)
    if kind == "mongodb":
        return F.concat(F.lit('{"update":'), text(F.col("target")), F.lit(',"updates":[{"q":{"_id":'), text(F.col("entity_key")), F.lit('},"u":{"$set":{"body":'), F.when(F.col("live"), body).otherwise(F.lit("null")), F.lit(',"live":'), F.col("live").cast("string"), F.lit(',"guard":'), lanes, F.lit('}},"upsert":true}]}'))
    if kind == "neo4j":
        label = F.concat(F.lit("`"), F.replace("target", F.lit("`"), F.lit("``")), F.lit("`"))
        ends = F.from_json("ends", "array<string>")
        node = F.concat(F.lit("MERGE (n:"), label, F.lit(" {_key: "), text(F.col("entity_key")), F.lit("}) SET n._body = "), text(body), F.lit(", n._guard = "), text(lanes))
        dead = F.concat(F.lit("MATCH (n:"), label, F.lit(" {_key: "), text(F.col("entity_key")), F.lit("}) DETACH DELETE n"))
        pair = F.concat(F.lit("MATCH (a {_key: "), text(ends[0]), F.lit("}), (b {_key: "), text(ends[1]), F.lit("}) "))
        edge = F.concat(pair, F.lit("MERGE (a)-[r:"), label, F.lit(" {_key: "), text(F.col("entity_key")), F.lit("}]->(b) SET r._body = "), text(body), F.lit(", r._guard = "), text(lanes))
        cut = F.concat(F.lit("MATCH ()-[r:"), label, F.lit(" {_key: "), text(F.col("entity_key")), F.lit("}]->() DELETE r"))
        return F.when(F.col("kind") == "edge", F.when(F.col("live"), edge).otherwise(cut)).otherwise(F.when(F.col("live"), node).otherwise(dead))
    raise ValueError(f"no commands for {kind}")


class FailedSink:
    """Stands for an adapter whose type nobody registered or whose factory failed: each event fails there."""

    def __init__(self, adapter_id: str, why: str):
        self.adapter_id, self.why = adapter_id, why

    def apply(self, state: DataFrame, batch_id: int) -> None:
        raise SinkError(f"{self.adapter_id}: {self.why}")


class SinkRegistry:
    """``type`` -> factory of the adapter's config. Unknown types and failing factories give a FailedSink."""

    def __init__(self) -> None:
        self._factories: dict[str, Callable[[dict], Sink]] = {}
        self._whole: dict[str, Callable] = {}

    def register(self, kind: str, factory: Callable[[dict], Sink]) -> SinkRegistry:
        self._factories[kind] = factory
        return self

    def register_adapter(self, kind: str, factory: Callable) -> SinkRegistry:
        """A factory of the whole adapter entry."""
        self._whole[kind] = factory
        return self

    def update(self, other: SinkRegistry) -> SinkRegistry:
        """The other's factories come before own ones of the same type."""
        for kind in {**other._factories, **other._whole}:
            self._factories.pop(kind, None)
            self._whole.pop(kind, None)
        self._factories |= other._factories
        self._whole |= other._whole
        return self

    def known(self, kind: str) -> bool:
        return kind in self._factories or kind in self._whole

    def build(self, adapter) -> Sink:
        if not self.known(adapter.type):
            return FailedSink(adapter.id, f"UnregisteredAdapterType: {adapter.type}")
        try:
            return self._whole[adapter.type](adapter) if adapter.type in self._whole else self._factories[adapter.type](adapter.config)
        except Exception as e:  # noqa: BLE001  a custom factory may fail in any way
            return FailedSink(adapter.id, f"FactoryConfigInvalid: {e}")


def dead_letters(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Failed events with their reports and the file-safe name each would be stored under. Null positions and line numbers match themselves."""
    place = {"position": F.coalesce("position", F.lit("")), "line_no": F.coalesce("line_no", F.lit(0).cast("long"))}
    failed = outcomes.where("outcome = 'failed'").withColumns(place).groupBy("event_id", "position", "line_no").agg(F.array_sort(F.collect_list(F.struct("adapter_id", "outcome", "reason", "error"))).alias("report"))
    name = F.concat(J.safe_file_name(F.col("event_id")), F.lit("."), F.coalesce(J.safe_file_name(F.col("position")), F.lit("")), F.lit(".json"))
    return events.withColumns(place).join(failed, ["event_id", "position", "line_no"]).withColumn("file_name", name)


def write_dead_letters(letters: DataFrame, root: str, batch: str) -> None:
    """Letters of one batch in a folder of its own: a repeated batch replaces its letters. No folder if there are none."""
    letters = letters.persist(StorageLevel.MEMORY_AND_DISK)  # the question whether there are any takes most of the work
    try:
        if letters.limit(1).count():
            letters.write.mode("overwrite").json(f"{root}/events/{batch}")
    finally:
        letters.unpersist()
