"""Metadata catalogue: tables, fields, the relationship graph, and where they come from.

Everything here is of the size of the metadata and lives on the driver; data stay in
the DataFrames that ``queryloom.sources.tables`` hands out.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Protocol


@dataclass(frozen=True)
class FieldMeta:
    name: str
    type: str = "string"
    label: str = ""
    description: str = ""
    primary_key: bool = False
    foreign_key: str | None = None
    nullable: bool = True
    tags: tuple[str, ...] = ()
    alias: str | None = None
    sensitive: bool = False


@dataclass(frozen=True)
class JoinMeta:
    target: str
    on: tuple[tuple[str, str], ...]  # (own field, target's field), both without table
    type: str = "LEFT"
    default: bool = False


@dataclass(frozen=True)
class TableMeta:
    name: str
    label: str = ""
    description: str = ""
    domain: str = ""
    category: str = ""
    tags: tuple[str, ...] = ()
    fields: tuple[FieldMeta, ...] = ()
    joins: tuple[JoinMeta, ...] = ()
    default_filters: Any = None
    sensitive: bool = False
    position: int = 0
    meta: dict[str, Any] = field(default_factory=dict, hash=False, compare=False)

    def field(self, name: str) -> FieldMeta | None:
        return next((f for f in self.fields if f.name == name), None)

    @property
    def primary_key(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields if f.primary_key)


def _bare(name: str) -> str:
    return name.rsplit(".", 1)[-1]


def field_from(spec: dict[str, Any], table: str, foreign_key: bool = False) -> FieldMeta:
    if not spec.get("name"):
        raise ValueError(f"Table '{table}' has a field without a name.")
    if "foreignKey" in spec and not foreign_key:
        raise ValueError(f"Field '{table}.{spec['name']}': foreign keys are declared as joins of the table.")
    label = spec.get("label", "")
    return FieldMeta(
        name=spec["name"],
        type=spec.get("type", "string"),
        label=label,
        description=spec.get("description") or label,
        primary_key=bool(spec.get("primaryKey", False)),
        foreign_key=spec.get("foreignKey"),
        nullable=bool(spec["nullable"]) if "nullable" in spec else not spec.get("required", False),
        tags=tuple(spec.get("tags", ())),
        alias=spec.get("alias"),
        sensitive=bool(spec.get("sensitive", False)),
    )


def table_from(spec: dict[str, Any], foreign_key: bool = False) -> TableMeta:
    """A table from its JSON form; wrong forms are rejected here rather than in a query."""
    name = spec.get("name")
    if not name:
        raise ValueError("A table file needs a 'name'.")
    joins = []
    for j in spec.get("joins", ()):
        on = j.get("on") or {}
        if not on:
            raise ValueError(f"Join from '{name}' to '{j.get('targetTable')}' has an empty 'on'.")
        meta = j.get("meta") or {}
        joins.append(JoinMeta(j["targetTable"], tuple((_bare(a), _bare(b)) for a, b in on.items()), str(j.get("type", "LEFT")).upper(), bool(meta.get("default", j.get("default", False)))))
    return TableMeta(
        name=name,
        label=spec.get("label", ""),
        description=spec.get("description", ""),
        domain=spec.get("domain", ""),
        category=spec.get("category", ""),
        tags=tuple(spec.get("tags", ())),
        fields=tuple(field_from(f, name, foreign_key) for f in spec.get("fields", ())),
        joins=tuple(joins),
        default_filters=spec.get("defaultFilters"),
        sensitive=bool(spec.get("sensitive", False)),
        position=int(spec.get("position", 0)),
    )


class Provider(Protocol):
    def tables(self) -> list[TableMeta]: ...

    def table(self, name: str) -> TableMeta | None: ...


class StaticCatalog:
    """Tables given as objects."""

    def __init__(self, tables: Iterable[TableMeta] = ()) -> None:
        self._tables = list(tables)

    def tables(self) -> list[TableMeta]:
        return list(self._tables)

    def table(self, name: str) -> TableMeta | None:
        return next((t for t in self.tables() if t.name == name), None)


class FileCatalog(StaticCatalog):
    """One JSON file per table in a folder, read on first use; a missing folder has no tables."""

    def __init__(self, folder: str | Path) -> None:
        super().__init__()
        self.folder, self._read = Path(folder), False

    def tables(self) -> list[TableMeta]:
        if not self._read:
            self._read = True
            for path in sorted(self.folder.glob("*.json")) if self.folder.is_dir() else ():
                try:
                    spec = json.loads(path.read_text(encoding="utf-8"))
                except (OSError, ValueError) as e:
                    raise RuntimeError(f"Cannot read table file {path}: {e}") from e
                if not isinstance(spec, dict) or not spec.get("name"):
                    raise RuntimeError(f"Table file {path} needs a 'name'.")
                try:
                    self._tables.append(table_from(spec))
                except ValueError as e:
                    raise RuntimeError(f"{path}: {e}") from e
        return list(self._tables)


class CompositeCatalog:
    """Several providers under names; ``provider:table`` or ``provider.table`` picks one of them."""

    def __init__(self, providers: dict[str, Provider], default: str | None = None) -> None:
        for name, p in providers.items():
            if not (hasattr(p, "tables") and hasattr(p, "table")):
                raise TypeError(f"Provider '{name}' is not a catalogue.")
        self.providers, self.default = dict(providers), default

    def tables(self) -> list[TableMeta]:
        return [t for p in self.providers.values() for t in p.tables()]

    def provider(self, name: str) -> Provider | None:
        return self.providers.get(name)

    def table(self, name: str) -> TableMeta | None:
        for mark in (":", "."):
            if mark in name:
                first, rest = name.split(mark, 1)
                if first in self.providers:
                    return self.providers[first].table(rest)
        order = list(self.providers)
        if self.default in self.providers:
            order = [self.default, *(n for n in order if n != self.default)]
        return next((t for n in order if (t := self.providers[n].table(name))), None)


def distinct(values: Iterable[str]) -> list[str]:
    """First-seen order, without empties."""
    return list(dict.fromkeys(v for v in values if v))


def domains(catalog: Provider) -> list[str]:
    return distinct(t.domain for t in catalog.tables())


def categories(catalog: Provider) -> list[str]:
    return distinct(t.category for t in catalog.tables())


def tags(catalog: Provider) -> list[str]:
    return distinct(x for t in catalog.tables() for x in (*t.tags, *(y for f in t.fields for y in f.tags)))


def schema_endpoint(catalog: Provider, q: str | None = None) -> list:
    """What a schema browser asks for: domains, categories, tags, or the tables themselves."""
    if q in ("domains", "categories", "tags"):
        return {"domains": domains, "categories": categories, "tags": tags}[q](catalog)
    return [
        {"name": t.name, "label": t.label, "description": t.description, "domain": t.domain, "category": t.category, "tags": list(t.tags), "sensitive": t.sensitive, "position": t.position, "fields": [{"name": f.name, "type": f.type, "description": f.description, "nullable": f.nullable, "primaryKey": f.primary_key, "sensitive": f.sensitive, "tags": list(f.tags)} for f in t.fields], "joins": [{"targetTable": j.target, "on": dict(j.on), "type": j.type} for j in t.joins]}
        for t in catalog.tables()
    ]
