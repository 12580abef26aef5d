"""Committed source positions: one small JSON file per source, replaced atomically, never moved back."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path


class Checkpoint:
    def __init__(self, state_dir: str | Path, source_id: str):
        self.path = Path(state_dir) / f"{source_id}.checkpoint.json"

    def position(self) -> str | None:
        return json.loads(self.path.read_text())["position"] if self.path.exists() else None

    def commit(self, position: str) -> bool:
        """False if the position is not beyond the committed one."""
        now = self.position()
        if now is not None and position <= now:
            return False
        self.path.parent.mkdir(parents=True, exist_ok=True)
        part = self.path.with_suffix(".tmp")
        part.write_text(json.dumps({"position": position, "committed_at": int(time.time() * 1000)}))
        os.replace(part, self.path)
        return True
