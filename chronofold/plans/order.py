"""Adapter order on a route: dependencies first, then lower priority, then id."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Mapping

from chronofold.plans.config import Adapter

DEEP = 2


class OrderError(ValueError):
    pass


def _needs(routed: Iterable[str], adapters: Mapping[str, Adapter]) -> dict[str, set[str]]:
    """Dependencies of each routed adapter that are on the route themselves."""
    here = list(dict.fromkeys(routed))
    if unknown := [x for x in here if x not in adapters]:
        raise OrderError(f"unknown adapter {unknown[0]}")
    return {x: {d for d in adapters[x].depends_on if d in here} for x in here}


def execution_order(routed: Iterable[str], adapters: Mapping[str, Adapter]) -> list[str]:
    waiting = _needs(routed, adapters)
    ready = [(adapters[x].priority, x) for x, needs in waiting.items() if not needs]
    heapq.heapify(ready)
    done: list[str] = []
    while ready:
        _, now = heapq.heappop(ready)
        done.append(now)
        for x, needs in waiting.items():
            if now in needs:
                needs.discard(now)
                if not needs:
                    heapq.heappush(ready, (adapters[x].priority, x))
    if len(done) < len(waiting):
        raise OrderError("dependency cycle: " + ", ".join(sorted(set(waiting) - set(done))))
    return done


def layers(routed: Iterable[str], adapters: Mapping[str, Adapter]) -> dict[str, int]:
    """Longest dependency path to each routed adapter, in execution order."""
    needs, depth = _needs(routed, adapters), {}
    for x in execution_order(list(needs), adapters):
        depth[x] = max((depth[d] + 1 for d in needs[x]), default=0)
    return depth


def grouped_layers(routed: Iterable[str], adapters: Mapping[str, Adapter]) -> list[list[str]]:
    """Execution order cut where the layer changes."""
    out: list[list[str]] = []
    last = None
    for x, d in layers(routed, adapters).items():
        if d != last:
            out.append([])
        out[-1].append(x)
        last = d
    return out


def explain(event_type: str, routes: Mapping[str, list[str]], adapters: Mapping[str, Adapter]) -> dict:
    """Route, order, layers and a warning when the chain is deep."""
    routed = routes.get(event_type, [])
    depth = layers(routed, adapters)
    deepest = max(depth.values(), default=0)
    return {
        "event_type": event_type,
        "routed": list(routed),
        "order": list(depth),
        "layers": grouped_layers(routed, adapters),
        "max_layer": deepest,
        "warning": f"dependency chain is {deepest} layers deep; {DEEP} or fewer are advised" if deepest > DEEP else None,
    }
