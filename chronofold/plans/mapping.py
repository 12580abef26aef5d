"""The four mapping kinds and their YAML loader. Mappings are immutable values."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from chronofold.model import ON_EXISTING, OPERATIONS


class MappingError(ValueError):
    pass


@dataclass(frozen=True)
class Mapping:
    """What all kinds share. ``identity`` lists the key paths, ``body`` what is written."""

    event: str
    version: int = 1
    operation: str = "upsert"
    on_existing: str = "ignore"
    permanent: bool = False
    facet: str | None = None
    requires_capabilities: tuple[str, ...] = ()

    @property
    def target(self) -> str:
        raise NotImplementedError

    @property
    def mode(self) -> str:
        """A facet is always ``replace`` on its own lane."""
        return "replace" if self.facet else self.on_existing


@dataclass(frozen=True)
class SqlMapping(Mapping):
    table: str = ""
    primary_key: tuple[str, ...] = ()
    columns: dict[str, str] = field(default_factory=dict)

    @property
    def target(self) -> str:
        return self.table


@dataclass(frozen=True)
class DocumentMapping(Mapping):
    collection: str = ""
    id: str = ""
    document: Any = field(default_factory=dict)

    @property
    def target(self) -> str:
        return self.collection


@dataclass(frozen=True)
class KeyValueMapping(Mapping):
    namespace: str = ""
    key: str = ""
    value: Any = field(default_factory=dict)

    @property
    def target(self) -> str:
        return self.namespace


@dataclass(frozen=True)
class NodeMapping(Mapping):
    label: str = ""
    key: str = ""
    properties: Any = field(default_factory=dict)

    @property
    def target(self) -> str:
        return self.label


@dataclass(frozen=True)
class EdgeMapping(Mapping):
    edge_type: str = ""
    from_: str = ""
    to: str = ""
    discriminator: str | None = None
    properties: Any = field(default_factory=dict)

    @property
    def target(self) -> str:
        return self.edge_type


@dataclass(frozen=True)
class Mappings:
    """Per kind: event type -> mapping."""

    sql: dict[str, SqlMapping] = field(default_factory=dict)
    document: dict[str, DocumentMapping] = field(default_factory=dict)
    keyvalue: dict[str, KeyValueMapping] = field(default_factory=dict)
    graph: dict[str, NodeMapping | EdgeMapping] = field(default_factory=dict)

    def of(self, kind: str) -> dict[str, Mapping]:
        return getattr(self, kind, {})


def parse_mapping(kind: str, raw: dict) -> Mapping:
    """One mapping of a kind from its YAML object."""
    d = dict(raw)
    if not isinstance(d.get("event"), str):
        raise MappingError("a mapping names its event")
    for name, allowed in (("operation", OPERATIONS), ("on_existing", ON_EXISTING)):
        if d.get(name, allowed[0]) not in allowed:
            raise MappingError(f"{name} of {d['event']} is one of {', '.join(allowed)}")
    shared = {k: d[k] for k in ("event", "operation", "on_existing", "permanent", "facet") if k in d}
    shared |= {"version": int(d.get("version", 1)), "requires_capabilities": tuple(d.get("requires_capabilities", ()))}
    if kind == "sql":
        pk = d.get("primary_key", ())
        return SqlMapping(**shared, table=d.get("table", ""), primary_key=(pk,) if isinstance(pk, str) else tuple(pk), columns=dict(d.get("columns") or {}))
    if kind == "document":
        return DocumentMapping(**shared, collection=d.get("collection", ""), id=d.get("id", ""), document=d.get("document") or {})
    if kind == "keyvalue":
        return KeyValueMapping(**shared, namespace=d.get("namespace", ""), key=d.get("key", ""), value=d.get("value") or {})
    if kind == "graph":
        if "edge_type" in d:
            return EdgeMapping(**shared, edge_type=d["edge_type"], from_=d.get("from", ""), to=d.get("to", ""), discriminator=d.get("discriminator"), properties=d.get("properties") or {})
        return NodeMapping(**shared, label=d.get("label", ""), key=d.get("key", ""), properties=d.get("properties") or {})
    raise MappingError(f"no mapping kind {kind}")


def load_dir(kind: str, folder: str | Path) -> dict[str, Mapping]:
    """All ``.yaml`` mappings of a folder; two for one event are an error."""
    out: dict[str, Mapping] = {}
    for p in sorted(Path(folder).glob("*.yaml")):
        try:
            m = parse_mapping(kind, yaml.safe_load(p.read_text()) or {})
        except (yaml.YAMLError, TypeError, ValueError) as e:
            raise MappingError(f"{p.name}: {e}") from e
        if m.event in out:
            raise MappingError(f"{p.name}: a second {kind} mapping for {m.event}")
        out[m.event] = m
    return out


def load_mappings(root: str | Path) -> Mappings:
    """``sql/`` and ``document/`` must exist, ``keyvalue/`` and ``graph/`` may."""
    root = Path(root)
    for name in ("sql", "document"):
        if not (root / name).is_dir():
            raise MappingError(f"{root / name} is missing")
    return Mappings(**{k: load_dir(k, root / k) if (root / k).is_dir() else {} for k in ("sql", "document", "keyvalue", "graph")})
