"""Startup checks. All issues are collected before any job starts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from chronofold.plans.config import Adapter, Config
from chronofold.plans.mapping import DocumentMapping, EdgeMapping, KeyValueMapping, Mapping, Mappings, NodeMapping, SqlMapping
from chronofold.plans.order import OrderError, execution_order

# Issue names by mapping kind.
INVALID = {"sql": "InvalidSqlMapping", "document": "InvalidDocumentMapping", "keyvalue": "InvalidKvMapping", "graph": "InvalidGraphMapping"}
MISSING = {"sql": "MissingSqlMapping", "document": "MissingDocumentMapping", "keyvalue": "MissingKvMapping", "graph": "MissingGraphMapping"}
UNROUTED = {"sql": "UnroutedSqlMapping", "document": "UnroutedDocumentMapping", "keyvalue": "UnroutedKvMapping", "graph": "UnroutedGraphMapping"}
NO_TARGET = {"sql": "SqlMappingNoSqlTarget", "document": "DocumentMappingNoFileTarget", "keyvalue": "KvMappingNoKeyValueTarget", "graph": "GraphMappingNoGraphTarget"}
CONNECTION = {"redis": ("InvalidRedisConfig", "url", ("redis", "rediss")), "mongodb": ("InvalidMongoDbConfig", "uri", ("mongodb", "mongodb+srv")), "neo4j": ("InvalidNeo4jConfig", "uri", ("bolt", "bolt+s", "neo4j", "neo4j+s")), "mysql": ("InvalidMySqlConfig", "url", ("mysql",))}


@dataclass(frozen=True)
class Issue:
    code: str
    subject: str
    detail: str = ""


class ValidationFailed(ValueError):
    def __init__(self, issues: list[Issue]):
        super().__init__("; ".join(f"{i.code}({i.subject}{': ' + i.detail if i.detail else ''})" for i in issues))
        self.issues = issues


def _is_path(x) -> bool:
    return isinstance(x, str) and any(x.startswith(p) and len(x) > len(p) for p in ("payload.", "metadata."))


def _rules(m: Mapping) -> Iterator[tuple[bool, str]]:
    """(holds, reason) in order; the first that fails is reported."""
    yield bool(m.event.strip()), "event is empty"
    if isinstance(m, SqlMapping):
        yield bool(m.table.strip()), "table is empty"
        yield bool(m.primary_key) and all(k.strip() for k in m.primary_key), "primary_key is empty"
        yield bool(m.columns), "columns are empty"
        yield set(m.primary_key) <= set(m.columns), "primary_key is not among the columns"
        yield m.operation != "delete" or set(m.columns) == set(m.primary_key), "a delete maps its key columns only"
    elif isinstance(m, EdgeMapping):
        yield bool(m.edge_type.strip()), "edge_type is empty"
        yield _is_path(m.from_) and _is_path(m.to), "from and to are paths"
        yield m.discriminator is None or _is_path(m.discriminator), "discriminator is a path"
        yield m.facet is None, "an edge has no facets"
        yield m.operation != "delete" or not m.properties, "a delete has no body"
    else:
        target, key, body, names = {
            DocumentMapping: lambda: (m.collection, m.id, m.document, ("collection", "id", "document")),
            KeyValueMapping: lambda: (m.namespace, m.key, m.value, ("namespace", "key", "value")),
            NodeMapping: lambda: (m.label, m.key, m.properties, ("label", "key", "properties")),
        }[type(m)]()
        yield bool(target.strip()), f"{names[0]} is empty"
        yield bool(key.strip()), f"{names[1]} is empty"
        yield _is_path(key), f"{names[1]} is no payload. or metadata. path"
        if m.operation == "delete":
            yield not body, "a delete has no body"
        elif not isinstance(m, NodeMapping):
            yield bool(body), f"{names[2]} is empty"
    yield m.version >= 1, "version is below 1"


def _fields(m: Mapping) -> list[str]:
    if isinstance(m, SqlMapping):
        return [c for c in m.columns if c not in m.primary_key]
    body = getattr(m, "document", None) or getattr(m, "value", None) or getattr(m, "properties", None) or {}
    return list(body) if isinstance(body, dict) else []


def _identity(m: Mapping) -> tuple[str, ...]:
    return m.primary_key if isinstance(m, SqlMapping) else (getattr(m, "id", None) or getattr(m, "key", ""),)


def _facets(kind: str, mappings: dict[str, Mapping]) -> Iterator[Issue]:
    by_target: dict[str, list[Mapping]] = {}
    for _, m in sorted(mappings.items()):
        if not isinstance(m, EdgeMapping):
            by_target.setdefault(m.target, []).append(m)
    for target, group in sorted(by_target.items()):
        if not any(m.facet for m in group):
            continue
        if any(m.on_existing == "replace" for m in group):
            yield Issue("FacetReplaceConflict", target, kind)
        base = _identity(next((m for m in group if not m.facet), group[0]))
        owners: dict[str, str | None] = {}
        for m in group:
            if _identity(m) != base:
                yield Issue("FacetKeyMismatch", m.event, kind)
            if m.facet and m.operation == "delete":
                yield Issue("FacetDeleteNotDefault", m.event, kind)
            if m.facet and not _fields(m):
                yield Issue("FacetHasNoFields", m.event, kind)
            for f in _fields(m):
                if owners.setdefault(f, m.facet) != m.facet:
                    yield Issue("FacetFieldOverlap", target, f"{kind} {f}")


def required_capabilities(m: Mapping) -> list[str]:
    need = list(m.requires_capabilities)
    need += ["upsert"] * (m.on_existing == "replace" and "upsert" not in need)
    return need + ["delete"] * (m.operation == "delete" and "delete" not in need)


def _route(event_type: str, routed: list[str], adapters: dict[str, Adapter], mappings: Mappings) -> Iterator[Issue]:
    for x in dict.fromkeys(routed):
        if routed.count(x) > 1:
            yield Issue("DuplicateRoutingTarget", event_type, x)
        if x not in adapters:
            yield Issue("UnknownAdapter", event_type, x)
            continue
        kind = adapters[x].kind
        if kind == "custom":
            continue
        m = mappings.of(kind).get(event_type)
        if m is None:
            yield Issue(MISSING[kind], event_type, x)
        elif lacking := [c for c in required_capabilities(m) if c not in (adapters[x].granted or ("write",))]:
            yield Issue("CapabilityMismatch", event_type, f"{x} lacks {', '.join(lacking)}")
    if all(x in adapters for x in routed):
        for x in sorted(set(routed)):
            for d in adapters[x].depends_on:
                if d not in routed:
                    yield Issue("DependencyNotOnRoute", event_type, f"{x} -> {d}")
        try:
            execution_order(routed, adapters)
        except OrderError as e:
            yield Issue("DependencyCycle", event_type, str(e))


def _connections(config: Config) -> Iterator[Issue]:
    for a in config.adapters:
        if a.type in CONNECTION:
            code, name, schemes = CONNECTION[a.type]
            url = a.config.get(name) or a.config.get("url") or a.config.get("uri") or ""
            if urlparse(str(url)).scheme not in schemes or not urlparse(str(url)).netloc:
                yield Issue(code, a.id, f"{name} is no {schemes[0]} address")


def issues(config: Config, routes: dict[str, list[str]], mappings: Mappings, event_types: set[str] | None = None) -> list[Issue]:
    """Every issue, or those of some event types."""
    adapters, out = {a.id: a for a in config.adapters}, []
    ids = [a.id for a in config.adapters]
    if event_types is None:
        out += [Issue("DuplicateAdapterId", x) for x in dict.fromkeys(ids) if ids.count(x) > 1]
        out += _connections(config)
    chosen = lambda e: event_types is None or e in event_types
    for event_type, routed in sorted(routes.items()):
        if chosen(event_type):
            out += _route(event_type, routed, adapters, mappings)
    for kind, code in INVALID.items():
        own = mappings.of(kind)
        for key, m in sorted(own.items()):
            if not chosen(key):
                continue
            if key != m.event:
                out.append(Issue("MappingKeyMismatch", key, f"{kind} {m.event}"))
            out += [Issue(code, m.event, why) for ok, why in _rules(m) if not ok][:1]
            if key not in routes:
                out.append(Issue(UNROUTED[kind], key))
            elif not any(adapters[x].kind == kind for x in routes[key] if x in adapters):
                out.append(Issue(NO_TARGET[kind], key))
        if event_types is None:
            out += _facets(kind, own)
    return out


def validate(config: Config, routes: dict[str, list[str]], mappings: Mappings) -> None:
    if found := issues(config, routes, mappings):
        raise ValidationFailed(found)


def validate_ids(config: Config) -> list[Issue]:
    ids = [a.id for a in config.adapters]
    return [Issue("DuplicateAdapterId", x) for x in dict.fromkeys(ids) if ids.count(x) > 1]


def validate_event(config: Config, routes: dict[str, list[str]], mappings: Mappings, event_type: str) -> list[str]:
    """Execution order of one event type, or its issues."""
    if found := issues(config, routes, mappings, {event_type}):
        raise ValidationFailed(found)
    return execution_order(routes.get(event_type, []), {a.id: a for a in config.adapters})
