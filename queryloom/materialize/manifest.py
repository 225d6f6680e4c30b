"""Manifests: what a materialized table is, and which of several variants applies."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from queryloom.sources.catalog import FieldMeta, TableMeta, table_from

PREFIX = "mat_"


@dataclass(frozen=True)
class Manifest:
    id: str
    logical_table: str
    query: dict[str, Any]
    columns: tuple[dict[str, Any], ...]
    enabled: bool = True
    priority: int = 100
    source_schema: str = ""
    target_schema: str = ""
    physical_prefix: str = ""
    indexes: Any = ()
    refresh: dict[str, Any] = field(default_factory=dict)
    depends_on: tuple[str, ...] = ()
    dependency_refresh: str = "missing"
    options: dict[str, Any] = field(default_factory=dict)
    spec: dict[str, Any] = field(default_factory=dict)

    @property
    def schedule(self) -> dict[str, Any]:
        return self.refresh.get("schedule") or self.spec.get("schedule") or {}

    @property
    def keep(self) -> int:
        """Generations kept: the first of the options, refresh and target settings; 2 by default."""
        for part in (self.options, self.refresh, self.spec.get("target") or {}):
            for key in ("keepGenerations", "keep_generations"):
                if part.get(key) is not None:
                    return max(1, int(part[key]))
        return 2

    def table(self) -> TableMeta:
        """The logical table a catalogue shows for it."""
        t = table_from({**{k: self.spec[k] for k in ("label", "description", "category", "joins", "sensitive", "position") if k in self.spec}, "name": self.logical_table, "fields": [{k: v for k, v in c.items() if k in ("name", "label", "description", "primaryKey", "foreignKey", "nullable", "required", "tags", "alias", "sensitive")} | {"type": c.get("type", "string")} for c in self.columns]}, foreign_key=True)
        return replace(t, domain=self.target_schema, tags=tuple(dict.fromkeys((*self.spec.get("tags", ()), "materialized"))), meta={"manifest": self.id})


def from_dict(spec: dict[str, Any]) -> Manifest:
    target = spec.get("target") or {}
    return Manifest(
        id=str(spec.get("id", "")),
        logical_table=str(spec.get("logicalTable") or target.get("logicalTable") or ""),
        query=spec.get("query") or {},
        columns=tuple(spec.get("columns") or ()),
        enabled=bool(spec.get("enabled", True)),
        priority=int(spec.get("priority", 100)),
        source_schema=str(spec.get("sourceSchema", "")),
        target_schema=str(spec.get("targetSchema", "")),
        physical_prefix=str(spec.get("physicalPrefix") or target.get("physicalPrefix") or ""),
        indexes=spec.get("indexes") or (),
        refresh=spec.get("refresh") or {},
        depends_on=tuple(spec.get("dependsOn") or ()),
        dependency_refresh=str(spec.get("dependencyRefresh") or (spec.get("refresh") or {}).get("dependencyRefresh") or "missing"),
        options=spec.get("options") or {},
        spec=spec,
    )


def check(m: Manifest) -> None:
    for ok, what in ((m.id, "id"), (m.logical_table, "logicalTable"), (m.query, "query"), (m.columns, "columns")):
        if not ok:
            raise ValueError(f"Manifest '{m.id}' must define '{what}'.")


def safe(text: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "_", text.lower())).strip("_")


def physical_base(m: Manifest) -> str:
    """Start of the names of a manifest's generations; building and clean-up share it."""
    base = safe(m.physical_prefix or m.logical_table)
    return base if base.startswith(PREFIX) else PREFIX + base


def physical_name(m: Manifest, generation: str, tail: str) -> str:
    name = f"{physical_base(m)}_{generation}_{tail}"
    if not re.fullmatch(r"[a-z][a-z0-9_]*_\d{14}_[0-9a-f]{4}", name):
        raise ValueError(f"'{name}' is no safe table name.")
    return name


def generation_pattern(m: Manifest) -> re.Pattern[str]:
    """Exactly this manifest's generations: a longer prefix belongs to another one."""
    return re.compile(re.escape(physical_base(m)) + r"_\d{14}_[0-9a-f]{4}")


class Manifests:
    """Manifests of a folder or list; ``exists`` tells which tables there are, for conditions."""

    def __init__(self, source: str | Path | Iterable[dict[str, Any]], exists: Callable[[str], bool] = lambda name: False) -> None:
        self.source, self.exists = source, exists
        self._all: dict[str, Manifest] | None = None
        self._seen: dict[str, bool] = {}

    def _there(self, table: str) -> bool:
        if table not in self._seen:
            self._seen[table] = bool(self.exists(table))
        return self._seen[table]

    def _holds(self, conditions: dict[str, Any] | None) -> bool:
        c = conditions or {}
        return all(map(self._there, c.get("requiresTables") or ())) and not any(map(self._there, c.get("missingTables") or ()))

    def _specs(self) -> Iterable[dict[str, Any]]:
        if isinstance(self.source, (str, Path)):
            folder = Path(self.source)
            for path in sorted(folder.glob("*.json")) if folder.is_dir() else ():
                try:
                    spec = json.loads(path.read_text(encoding="utf-8"))
                except ValueError as e:
                    raise RuntimeError(f"Cannot read manifest {path}: {e}") from e
                yield spec
        else:
            yield from self.source

    def _with_conditional_where(self, spec: dict[str, Any]) -> dict[str, Any]:
        extra, depends = [], list(spec.get("dependsOn") or ())
        for part in spec.get("conditionalWhere") or ():
            if self._holds(part.get("conditions") or {k: part[k] for k in ("requiresTables", "missingTables") if k in part}):
                if part.get("where"):
                    extra.append(part["where"])
                depends += [d for d in part.get("dependsOn") or () if d not in depends]
        if not extra and depends == list(spec.get("dependsOn") or ()):
            return spec
        query = dict(spec.get("query") or {})
        parts = [x for x in (query.get("where"), *extra) if x]
        if parts:
            query["where"] = parts[0] if len(parts) == 1 else dict(type="op", operator="AND", params=parts)
        return {**spec, "query": query, "dependsOn": depends}

    def all(self) -> list[Manifest]:
        if self._all is None:
            best: dict[str, tuple[int, Manifest]] = {}
            for spec in self._specs():
                if not spec.get("enabled", True) or not self._holds(spec.get("conditions")):
                    continue
                m, weight = from_dict(self._with_conditional_where(spec)), int(spec.get("variantPriority", 0))
                if m.id not in best or weight >= best[m.id][0]:
                    best[m.id] = (weight, m)
            self._all = {i: m for i, (_, m) in best.items()}
        return list(self._all.values())

    def get(self, name: str) -> Manifest | None:
        """By id, else by logical table."""
        return next((m for m in self.all() if m.id == name), None) or next((m for m in self.all() if m.logical_table == name), None)

    # a catalogue, so that logical tables can be queried
    def tables(self) -> list[TableMeta]:
        return [m.table() for m in self.all()]

    def table(self, name: str) -> TableMeta | None:
        m = self.get(name)
        return m.table() if m else None


def fields_of(m: Manifest) -> list[FieldMeta]:
    return list(m.table().fields)
