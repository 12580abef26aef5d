"""Project configuration: adapters, sources, routing, policies."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from chronofold.model import ADAPTER_KINDS, FAILURE_POLICIES, MIGRATION_POLICIES
from chronofold.plans.mapping import Mappings, load_mappings


class ConfigError(ValueError):
    """``code`` is one of the closed set of configuration errors."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Adapter:
    id: str
    type: str
    priority: int = 0
    config: dict = field(default_factory=dict)
    capabilities: tuple[str, ...] | None = None
    depends_on: tuple[str, ...] = ()
    kind_hint: str | None = None

    @property
    def kind(self) -> str:
        """A custom adapter may declare its kind, so its mappings are found."""
        return ADAPTER_KINDS.get(self.type) or self.kind_hint or "custom"

    @property
    def granted(self) -> tuple[str, ...]:
        return ("write",) if self.capabilities is None else self.capabilities


@dataclass(frozen=True)
class SourceConfig:
    id: str
    type: str
    path: str | None = None
    state_dir: str | None = None


@dataclass(frozen=True)
class Config:
    adapters: tuple[Adapter, ...]
    routing_file: str | None = None
    failure_policy: str = "fail_fast"
    migration_policy: str = "strict"
    sources: tuple[SourceConfig, ...] = ()
    version: int = 1

    def adapter(self, adapter_id: str) -> Adapter | None:
        return next((a for a in self.adapters if a.id == adapter_id), None)


@dataclass(frozen=True)
class Project:
    config: Config
    mappings: Mappings
    routes: dict[str, list[str]]


def expand_env(text: str, env: dict[str, str] | None = None) -> str:
    """``${NAME}`` from the environment; an unset name stays as it is."""
    env = os.environ if env is None else env
    return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], m[0]), text)


def parse_config(text: str, env: dict[str, str] | None = None) -> Config:
    raw = yaml.safe_load(expand_env(text, env)) or {}
    config = Config(
        version=raw.get("version", 0),
        routing_file=(raw.get("routing") or {}).get("file"),
        adapters=tuple(
            Adapter(a["id"], a["type"], int(a.get("priority", 0)), dict(a.get("config") or {}), tuple(a["capabilities"]) if a.get("capabilities") is not None else None, tuple(a.get("depends_on") or ()), a.get("kind"))
            for a in raw.get("adapters") or ()
        ),
        failure_policy=raw.get("failure_policy", "fail_fast"),
        migration_policy=raw.get("migration_policy", "strict"),
        sources=tuple(SourceConfig(s["id"], s["type"], s.get("path"), s.get("state_dir")) for s in raw.get("sources") or ()),
    )
    check_structure(config)
    return config


def check_structure(config: Config) -> None:
    if config.version != 1:
        raise ConfigError("UnsupportedVersion", str(config.version))
    if not config.adapters:
        raise ConfigError("NoAdaptersDefined")
    for name, allowed in ((config.failure_policy, FAILURE_POLICIES), (config.migration_policy, MIGRATION_POLICIES)):
        if name not in allowed:
            raise ValueError(f"{name} is none of {', '.join(allowed)}")
    ids = [a.id for a in config.adapters]
    for x in ids:
        if ids.count(x) > 1:
            raise ConfigError("DuplicateAdapterId", x)
    for a in config.adapters:
        for d in a.depends_on:
            if d == a.id:
                raise ConfigError("SelfDependency", a.id)
            if d not in ids:
                raise ConfigError("UnknownDependency", f"{a.id} -> {d}")
    names = [s.id for s in config.sources]
    for x in names:
        if names.count(x) > 1:
            raise ConfigError("DuplicateSourceId", x)


def load_routes(path: str | Path) -> dict[str, list[str]]:
    routes = json.loads(Path(path).read_text())
    if not isinstance(routes, dict):
        raise ValueError("routing is a JSON object")
    return {str(k): [str(x) for x in v] for k, v in routes.items()}


def load_project(config_path: str | Path, mappings_dir: str | Path, routing_path: str | Path | None = None) -> Project:
    """Config, mappings and routes. A relative routing file is looked up beside the config."""
    config = parse_config(Path(config_path).read_text())
    routing = Path(routing_path or config.routing_file or "routing.json")
    if not routing.is_absolute() and not routing_path:
        routing = Path(config_path).parent / routing
    return Project(config, load_mappings(mappings_dir), load_routes(routing))
