"""Builds generations: run the query, cast to the declared columns, write, publish, retire."""

from __future__ import annotations

import hashlib
import json
import re
import secrets
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryloom.functions.types import column_type
from queryloom.materialize import manifest as manifests
from queryloom.materialize.manifest import Manifest
from queryloom.materialize.registry import Registry
from queryloom.operators.dml import Writer
from queryloom.plans.expressions import quoted
from queryloom.service import QueryService

TABLE = re.compile(r"\{\{\s*table:\s*(?:([A-Za-z0-9_]+)\.)?([A-Za-z0-9_]+)\s*\}\}")


@dataclass
class Outcome:
    ok: bool
    message: str = ""
    row_count: int | None = None
    physical_table: str | None = None
    generation: str | None = None


def spark_type(c: dict[str, Any]) -> T.DataType:
    return column_type(str(c.get("type", "string")), c.get("precision"), c.get("scale"))


def index_names(m: Manifest) -> dict[str, dict[str, Any]]:
    """Index definitions by name, from a list of them or an object by name."""
    specs = m.indexes.items() if isinstance(m.indexes, dict) else ((None, x) for x in m.indexes or ())
    out = {}
    for name, spec in specs:
        spec = {"columns": spec} if isinstance(spec, list) else {"columns": [spec]} if isinstance(spec, str) else spec
        columns = list(spec.get("columns") or spec.get("fields") or ())
        if not columns:
            raise ValueError(f"Index of manifest '{m.id}' has no columns.")
        name = spec.get("name") or name or f"idx_{manifests.safe(m.logical_table)}_{manifests.safe('_'.join(columns))}"
        out[str(name)[:64]] = {"columns": columns, "unique": bool(spec.get("unique", False))}
    return out


class Materializer:
    def __init__(self, service: QueryService, registry: Registry, clock: Callable[[], datetime] = lambda: datetime.now(UTC)) -> None:
        if service.store is None:
            raise ValueError("Materialization needs a store.")
        self.service, self.store, self.registry, self.clock = service, service.store, registry, clock

    def refresh(self, m: Manifest) -> Outcome:
        mode = str(m.refresh.get("mode", "full"))
        return self.incremental(m) if mode == "incremental" else self.build(m)

    def incremental(self, m: Manifest) -> Outcome:
        return Outcome(False, f"Incremental refresh of '{m.id}' is not implemented yet.")

    def build(self, m: Manifest) -> Outcome:
        """A full build. Failures are an outcome, not an exception, and leave nothing behind."""
        try:
            manifests.check(m)
        except ValueError as e:
            return Outcome(False, str(e))
        generation = self.clock().strftime("%Y%m%d%H%M%S")
        physical = manifests.physical_name(m, generation, secrets.token_hex(2))
        run = self.registry.start({"manifest_id": m.id, "schema_name": m.target_schema, "logical_table": m.logical_table, "physical_table": physical, "generation": generation, "mode": "full"})
        try:
            with self.store.transaction():
                n = self._write(m, physical)
            self.registry.publish({"schema_name": m.target_schema, "logical_table": m.logical_table, "physical_table": physical, "generation": generation, "schema_hash": _digest(m.columns), "query_hash": _digest(m.query), "row_count": n, "meta": {"manifest": m.id}})
        except Exception as e:  # whatever a query can raise becomes the run's message
            if physical in self.store.names():
                self.store.discard(physical)
            self.registry.finish(run, False, str(e)[:2000])
            return Outcome(False, str(e), None, physical, generation)
        note = None
        try:
            self.retire(m)
        except Exception as e:  # the new generation is published; the next build retires what is left
            note = f"Old generations were not retired: {e}"[:2000]
        self.registry.finish(run, True, note, n)
        return Outcome(True, f"{n} rows" if note is None else f"{n} rows. {note}", n, physical, generation)

    def _write(self, m: Manifest, physical: str) -> int:
        df = self._frame(m)
        if len(df.columns) != len(m.columns):
            raise ValueError(f"Query of '{m.id}' has {len(df.columns)} columns, the manifest {len(m.columns)}.")
        df = df.toDF(*(f"_c{i}" for i in range(len(m.columns))))
        schema = T.StructType([T.StructField(c["name"], spark_type(c), True, {"type": str(c.get("type", "string"))}) for c in m.columns])
        df = df.select(*(F.col(f"_c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)))
        auto = next((c["name"] for c in m.columns if c.get("autoIncrement") or c.get("auto_increment")), None)
        defaults = {c["name"]: c["default"] for c in m.columns if c.get("default") is not None}
        indexes = index_names(m)
        plain = [x["columns"] for x in indexes.values() if not x["unique"]]
        if plain:  # sorted files carry narrow ranges, which is what an index is for here
            df = df.sortWithinPartitions(*map(quoted, plain[0]))
        key = [c["name"] for c in m.columns if c.get("primaryKey") or c.get("primary_key")]
        required = [c["name"] for c in m.columns if c.get("nullable") is False or c.get("required")]
        after = 1
        if auto is not None:
            numbered, _, after = Writer(self.service.compiler, self.store)._number(df.withColumn("_at", F.monotonically_increasing_id()), {"auto": auto, "next": 1})
            df = numbered.drop("_at")
        path = self.store.write(df)
        done = self.store.spark.read.schema(schema).parquet(path)
        checks = [F.count(F.lit(1)).alias("_n"), *(F.count(F.when(F.col(quoted(c)).isNull(), 1)).alias(c) for c in {*required, *key})]
        found = done.agg(*checks).first()
        for c in {*required, *key}:
            if found[c]:
                raise ValueError(f"Column '{c}' cannot be null")
        for columns in [x for x in (key, *(x["columns"] for x in indexes.values() if x["unique"])) if x]:
            if not done.groupBy(*map(quoted, columns)).count().where("count > 1").isEmpty():
                raise ValueError(f"Duplicate entry for key ({', '.join(columns)})")
        self.store.create(physical, schema, primary_key=key, not_null=required, unique={n: x["columns"] for n, x in indexes.items() if x["unique"]}, indexes={n: x["columns"] for n, x in indexes.items() if not x["unique"]}, defaults=defaults, auto=auto, next=after, paths=[path])
        return int(found["_n"])

    def _frame(self, m: Manifest) -> DataFrame:
        q = dict(m.query)
        if q.get("type") in ("raw_select", "raw-sql-select"):
            return self._raw(m, str(q.get("sql", "")))
        q["type"] = "select"
        if m.source_schema:
            q.setdefault("schema", m.source_schema)
        return self.service.compile(q).df

    def _raw(self, m: Manifest, sql: str) -> DataFrame:
        """A SELECT text in which {{table:[schema.]name}} stands for a table."""
        if not re.match(r"\s*(select|with)\b", sql, re.I):
            raise ValueError("A raw query must be a SELECT.")
        frames: dict[str, DataFrame] = {}

        def view(found: re.Match[str]) -> str:
            schema, name = found[1] or "", found[2]
            g = self.registry.current(name, schema)
            df = self.store.find(g["physical_table"]) if g else self.service.sources.find(name)
            if df is None:
                raise ValueError(f"Table '{schema + '.' if schema else ''}{name}' is not published.")
            frames[f"t{len(frames)}"] = df
            return "{t" + str(len(frames) - 1) + "}"

        marked = TABLE.sub(lambda f: "\0" + view(f)[1:-1] + "\0", sql).replace("{", "{{").replace("}", "}}")
        return self.store.spark.sql(re.sub("\0(t\\d+)\0", r"{\1}", marked), **frames)

    def retire(self, m: Manifest) -> list[str]:
        """Drops all but the newest generations and deletes their files, never the current one."""
        pattern = manifests.generation_pattern(m)
        names = sorted((n for n in self.store.names() if pattern.fullmatch(n)), reverse=True)
        current = self.registry.current(m.logical_table, m.target_schema)
        keep = set(names[: m.keep]) | ({current["physical_table"]} if current else set())
        gone = [n for n in names if n not in keep]
        for n in gone:
            self.store.discard(n)
        return gone


def _digest(value: Any) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()
