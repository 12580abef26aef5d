"""Sinks from the config: a factory per adapter type, bound to the project's mappings."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import SparkSession

from chronofold.plans.config import Adapter, Project
from chronofold.sinks.store import JdbcSink, JsonTreeSink, SinkRegistry, SqliteSink

#: JDBC type names -> types that values are read as.
COLUMN_TYPES = {
    "int2": "smallint", "smallint": "smallint", "int4": "int", "int": "int", "integer": "int", "int8": "bigint", "bigint": "bigint", "serial": "int", "bigserial": "bigint",
    "float4": "float", "real": "float", "float": "float", "float8": "double", "double": "double", "double precision": "double", "bool": "boolean", "boolean": "boolean", "bit": "boolean",
    "date": "date", "timestamp": "timestamp", "timestamptz": "timestamp", "datetime": "timestamp", "numeric": "decimal(38,10)", "decimal": "decimal(38,10)",
}


def tables_of(project: Project, adapter: Adapter) -> dict[str, tuple[list[str], list[str]]]:
    """target -> (key columns, columns) of the SQL mappings whose events are routed to the adapter."""
    out: dict[str, tuple[list[str], list[str]]] = {}
    for event, m in sorted(project.mappings.sql.items()):
        if adapter.id in project.routes.get(event, []):
            key, columns = out.get(m.table, (list(m.primary_key), []))
            out[m.table] = (key, sorted({*columns, *m.columns}))
    return out


def jdbc_url(adapter: Adapter) -> tuple[str, dict]:
    """JDBC address and properties of a server address such as scheme://user:password@host:port/db."""
    url = urlparse(str(adapter.config.get("url") or adapter.config.get("connection") or adapter.config.get("uri") or ""))
    if not url.hostname:
        raise ValueError(f"{adapter.id} has no server address")
    scheme = {"postgres": "postgresql", "mysql": "mysql"}[adapter.type]
    properties = {k: v for k, v in (("user", url.username), ("password", url.password), ("driver", {"postgres": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver"}[adapter.type])) if v}
    return f"jdbc:{scheme}://{url.hostname}{f':{url.port}' if url.port else ''}{url.path}", properties


class JdbcServer:
    """One server: runs statements in a transaction and tells the column types of tables, through the driver of the session's JVM."""

    def __init__(self, spark: SparkSession, url: str, properties: dict):
        self.jvm, self.url, self.properties = spark._jvm, url, properties

    def _connect(self):
        if "driver" in self.properties:
            self.jvm.java.lang.Class.forName(self.properties["driver"], True, self.jvm.java.lang.Thread.currentThread().getContextClassLoader())
        given = self.jvm.java.util.Properties()
        for k, v in self.properties.items():
            given.setProperty(k, v)
        return self.jvm.java.sql.DriverManager.getConnection(self.url, given)

    def execute(self, statements: list[str]) -> None:
        db = self._connect()
        try:
            db.setAutoCommit(False)
            try:
                s = db.createStatement()
                for x in statements:
                    s.executeUpdate(x)
                db.commit()
            except Exception:
                db.rollback()
                raise
        finally:
            db.close()

    def types(self, table: str) -> dict[str, str]:
        """Column -> type that its values are read as; text and unknown types are not listed."""
        db = self._connect()
        try:
            rows, out = db.getMetaData().getColumns(None, None, table, None), {}
            while rows.next():
                if t := COLUMN_TYPES.get(rows.getString("TYPE_NAME").lower()):
                    out[rows.getString("COLUMN_NAME")] = t
            return out
        finally:
            db.close()


def default_registry(spark: SparkSession, project: Project, root: str | None = None) -> SinkRegistry:
    """Factories of the built-in types. ``root``: where file sinks without a path of their own go.

    Types whose client library is not part of this repository (redis, mongodb, neo4j) have a factory that says so; register one that
    returns a CommandSink with a ``send`` to have them.
    """

    def place(a: Adapter, suffix: str = "") -> str:
        path = a.config.get("path") or a.config.get("database") or a.config.get("root")
        if not path and not root:
            raise ValueError(f"{a.id} has no path")
        return str(path or f"{root.rstrip('/')}/{a.id}{suffix}")

    def sqlite(a: Adapter) -> SqliteSink:
        return SqliteSink(place(a, ".db"), tables_of(project, a))

    def tree(a: Adapter) -> JsonTreeSink:
        return JsonTreeSink(spark, place(a))

    def server(a: Adapter) -> JdbcSink:
        url, properties = jdbc_url(a)
        db, tables = JdbcServer(spark, url, properties), tables_of(project, a)
        return JdbcSink(url, a.type, tables, db.execute, properties, {t: db.types(t) for t in tables})

    def absent(a: Adapter):
        raise RuntimeError(f"no client library for {a.type}: register a factory")

    out = SinkRegistry()
    for kind, f in {"sqlite": sqlite, "file": tree, "keyvalue": tree, "graph": tree, "postgres": server, "mysql": server, "redis": absent, "mongodb": absent, "neo4j": absent}.items():
        out.register_adapter(kind, f)
    return out
