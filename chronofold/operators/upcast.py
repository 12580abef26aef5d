"""Payload schema evolution: steps are VARIANT column functions, chains are resolved on the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[Column], Column]


class MissingLink(LookupError):
    pass


class Downcast(ValueError):
    pass


class UpcasterRegistry:
    """Steps ``v -> v+1`` by (event type, v); the last registration counts."""

    def __init__(self) -> None:
        self._steps: dict[tuple[str, int], Step] = {}

    def register(self, event_type: str, from_version: int, step: Step) -> UpcasterRegistry:
        self._steps[event_type, from_version] = step
        return self

    def chain(self, event_type: str, source: int, target: int) -> list[Step]:
        if source > target:
            raise Downcast(f"{event_type}: {source} to {target}")
        for v in range(source, target):
            if (event_type, v) not in self._steps:
                raise MissingLink(f"{event_type}: no step from {v}")
        return [self._steps[event_type, v] for v in range(source, target)]

    def sources(self, event_type: str, target: int) -> dict[int, list[Step]]:
        """Every source version below the target from which a whole chain leads there."""
        out: dict[int, list[Step]] = {}
        for v in range(target - 1, 0, -1):
            if (event_type, v) not in self._steps:
                break
            out[v] = self.chain(event_type, v, target)
        return out

    def apply(self, event_type: str, version: Column, target: int, payload: Column) -> tuple[Column, Column, Column]:
        """(payload at the target version, unsupported, error).

        Equal versions bypass the registry. A version without a chain is unsupported; a step that
        gives NULL has failed and takes the same path.
        """
        out, known, failed = F.when(version == target, payload), version == target, F.lit(False)
        for v, steps in self.sources(event_type, target).items():
            x = payload
            for step in steps:
                x = step(x)
            out, known, failed = out.when(version == v, x), known | (version == v), failed | ((version == v) & payload.isNotNull() & x.isNull())
        why = F.when(~known & (version > target), F.lit("downcast")).when(~known, F.lit("missing link")).when(failed, F.lit("upcast failed"))
        return out, ~known | failed, why
