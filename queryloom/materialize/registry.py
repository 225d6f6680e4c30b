"""Registry of generations and log of runs: one small JSON document, replaced atomically."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from queryloom.sources.files import Conflict, Document

GENERATION = ("id", "schema_name", "logical_table", "physical_table", "generation", "schema_hash", "query_hash", "row_count", "status", "is_current", "published_at", "created_at", "meta")
RUN = ("id", "manifest_id", "schema_name", "logical_table", "physical_table", "generation", "mode", "status", "message", "row_count", "started_at", "finished_at", "meta")


class Registry:
    """Kept on a file system all writers share; the rename is the commit. With a session any Hadoop path will do."""

    def __init__(self, path: str | Path, now: Callable[[], int], spark: SparkSession | None = None) -> None:
        self.file, self.now, self._lock = Document(path, spark), now, threading.Lock()

    def _load(self) -> dict[str, Any]:
        return self._state(self.file.read())

    @staticmethod
    def _state(text: str | None) -> dict[str, Any]:
        return json.loads(text) if text else {"generations": [], "runs": [], "next": 1}

    def _change(self, f: Callable[[dict[str, Any]], Any]) -> Any:
        with self._lock:
            while True:
                version, text = self.file.load()
                state = self._state(text)
                out = f(state)
                try:
                    self.file.commit(json.dumps(state), version)
                    return out
                except Conflict:  # another writer was first: do it again on top of that
                    continue

    @staticmethod
    def _id(state: dict[str, Any]) -> int:
        state["next"] += 1
        return state["next"] - 1

    # Generations.

    def publish(self, row: dict[str, Any]) -> None:
        """Makes a generation the current one; the change of the pointer and its row are one write."""

        def go(state: dict[str, Any]) -> None:
            for g in state["generations"]:
                if g["schema_name"] == row["schema_name"] and g["logical_table"] == row["logical_table"]:
                    g["is_current"] = False
            at = self.now()
            state["generations"].append({"status": "published", "row_count": None, "meta": None, "created_at": at, "published_at": at, **row, "is_current": True, "id": self._id(state)})

        self._change(go)

    def generations(self, logical: str | None = None, schema: str = "") -> list[dict[str, Any]]:
        """Newest first; an empty schema means any."""
        rows = [g for g in self._load()["generations"] if (logical is None or g["logical_table"] == logical) and (not schema or g["schema_name"] == schema)]
        return sorted(rows, key=lambda g: (g["published_at"] or 0, g["id"]), reverse=True)

    def current(self, logical: str, schema: str = "") -> dict[str, Any] | None:
        return next((g for g in self.generations(logical, schema) if g["is_current"]), None)

    # Runs.

    def start(self, row: dict[str, Any]) -> int:
        def go(state: dict[str, Any]) -> int:
            for r in state["runs"]:
                if r["manifest_id"] == row["manifest_id"] and r["status"] == "running":
                    r.update(status="failed", message="Superseded by a newer run.", finished_at=self.now())
            run = {**dict.fromkeys(RUN), "status": "running", "started_at": self.now(), **row, "id": self._id(state)}
            state["runs"].append(run)
            return run["id"]

        return self._change(go)

    def finish(self, run: int, ok: bool, message: str | None = None, row_count: int | None = None) -> None:
        def go(state: dict[str, Any]) -> None:
            for r in state["runs"]:
                if r["id"] == run:
                    r.update(status="success" if ok else "failed", message=message, row_count=row_count, finished_at=self.now())

        self._change(go)

    def runs(self, manifest: str | None = None) -> list[dict[str, Any]]:
        return sorted((r for r in self._load()["runs"] if manifest is None or r["manifest_id"] == manifest), key=lambda r: r["id"], reverse=True)

    # Clean-up.

    def clean(self, exists: Callable[[str], bool], keep_runs: int = 100) -> dict[str, int]:
        """Drops rows of generations that are gone, and but the newest ended runs of each manifest."""

        def go(state: dict[str, Any]) -> dict[str, int]:
            n, m = len(state["generations"]), len(state["runs"])
            state["generations"] = [g for g in state["generations"] if g["is_current"] or exists(g["physical_table"])]
            seen: dict[str, int] = {}
            kept = []
            for r in sorted(state["runs"], key=lambda r: r["id"], reverse=True):
                if r["status"] != "running":
                    seen[r["manifest_id"]] = seen.get(r["manifest_id"], 0) + 1
                if r["status"] == "running" or seen[r["manifest_id"]] <= keep_runs:
                    kept.append(r)
            state["runs"] = kept[::-1]
            return {"generations": n - len(state["generations"]), "runs": m - len(state["runs"])}

        return self._change(go)


class Resolver:
    """Logical names to their current generations, as a source for scans."""

    def __init__(self, registry: Registry, store: Any, prefix: str = "mat_") -> None:
        self.registry, self.store, self.prefix = registry, store, prefix

    def physical(self, name: str, schema: str = "", mode: str = "logical") -> str:
        """Names that are physical, or that nothing is published for, stay as they are."""
        if mode == "physical" or name.startswith(self.prefix):
            return name
        g = self.registry.current(name, schema)
        return g["physical_table"] if g else name

    def find(self, name: str) -> Any:
        for mark in (":", "."):
            if mark in name:
                schema, rest = name.split(mark, 1)
                if (found := self.registry.current(rest, schema)) is not None:
                    return self.store.find(found["physical_table"])
        return self.store.find(self.physical(name))
