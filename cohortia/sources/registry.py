"""Versions of tables and cached results, in a JSON file on the driver."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone


class VersionRegistry:
    def __init__(self, path: str) -> None:
        self.path = path

    def entries(self) -> list[dict]:
        if not os.path.exists(self.path):
            return []
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    def latest(self, name: str) -> dict | None:
        return next((e for e in reversed(self.entries()) if e["name"] == name), None)

    def register(self, name: str, content: str, **facts: object) -> bool:
        """Append a version; False, and nothing written, if the latest has the same content."""
        last = self.latest(name)
        if last and last["content"] == content:
            return False
        new = {"name": name, "version": (last or {"version": 0})["version"] + 1, "content": content, "at": datetime.now(timezone.utc).isoformat(timespec="seconds"), **facts}
        whole = [*self.entries(), new]
        with open(self.path + ".tmp", "w", encoding="utf-8") as f:
            json.dump(whole, f, ensure_ascii=False, indent=1)
        os.replace(self.path + ".tmp", self.path)
        return True

    def require(self, name: str, content: str) -> None:
        """The version gate: refuse an input that isn't the registered one."""
        last = self.latest(name)
        if last is None or last["content"] != content:
            raise ValueError(f"{name} is not the registered version")

    def valid(self, name: str, **facts: object) -> bool:
        """Whether a cached result was made from these inputs and parameters."""
        last = self.latest(name)
        return last is not None and all(last.get(k) == v for k, v in facts.items())
