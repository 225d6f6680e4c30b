"""The query service: documents in, results out."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from queryloom.errors import CompileError, ExecutionError, ValidationError
from queryloom.functions.registry import last_insert_id
from queryloom.functions.types import reported
from queryloom.operators import ddl
from queryloom.operators.dml import Writer, Written
from queryloom.plans import validate
from queryloom.plans.select import Compiled, Compiler
from queryloom.sources import catalog as catalogues
from queryloom.sources.catalog import Provider, TableMeta
from queryloom.sources.files import Conflict
from queryloom.sources.store import Store
from queryloom.sources.tables import Sources

TRIES = 8
ERROR_MARK = "\n\n❌ DB Error: "


@dataclass
class QueryResult:
    """Columns with lineage, and the rows, which are computed when they are asked for."""

    columns: list[dict[str, Any]] = field(default_factory=list)
    df: DataFrame | None = None
    debug: str = ""
    sensitive: bool = False
    affected_rows: int | None = None
    insert_id: int | None = None
    error: str | None = None

    def rows(self) -> list[dict[str, Any]]:
        """All rows on the driver; for exports of report size."""
        return [] if self.df is None else [r.asDict() for r in self.df.collect()]

    def stream(self) -> Iterator[dict[str, Any]]:
        """Rows one partition at a time."""
        if self.df is not None:
            for r in self.df.toLocalIterator():
                yield r.asDict()

    def explain(self, mode: str = "formatted") -> str:
        return "" if self.df is None else self.df._sc._jvm.PythonSQLUtils.explainString(self.df._jdf.queryExecution(), mode)


class QueryService:
    """Runs query documents over a catalogue, its sources and, for writes, a store.

    ``strict`` raises what fails while running; otherwise it is kept in the result, as a
    report shows it. Documents that break a rule always raise.
    """

    def __init__(self, spark: SparkSession, catalog: Provider, sources: Sources, store: Store | None = None, strict: bool = False) -> None:
        self.spark, self.catalog, self.store, self.strict = spark, catalog, store, strict
        self.sources = sources if store is None or store in sources.sources else Sources(store, *sources.sources)
        self.compiler = Compiler(catalog, self.sources)

    # Metadata.

    def list_tables(self) -> list[TableMeta]:
        return self.catalog.tables()

    def table(self, name: str) -> TableMeta | None:
        return self.catalog.table(name)

    def list_domains(self) -> list[str]:
        return catalogues.domains(self.catalog)

    def list_categories(self) -> list[str]:
        return catalogues.categories(self.catalog)

    def list_tags(self) -> list[str]:
        return catalogues.tags(self.catalog)

    # Queries.

    def compile(self, q: dict) -> Compiled:
        """The plan of a SELECT, without a result around it."""
        return self.compiler.compile(q)

    def execute(self, q: dict | str) -> QueryResult:
        q = json.loads(q) if isinstance(q, str) else q
        debug = json.dumps(q, ensure_ascii=False, default=str)
        if isinstance(q, dict) and q.get("type") == "transaction":
            return self._transaction(q, debug)
        validate.validate(q)
        try:
            return self._select(q, debug) if q["type"] == "select" else self._write(q, debug)
        except (ValidationError, CompileError):
            raise
        except (ExecutionError, PySparkException) as e:
            if self.strict:
                raise
            return QueryResult(debug=f"{debug}{ERROR_MARK}{e}", error=str(e), affected_rows=None if q["type"] == "select" else 0)

    def _select(self, q: dict, debug: str) -> QueryResult:
        c = self.compiler.compile(q)
        schema = c.df.schema
        if not c.wildcard and [f.name for f in c.fields] != schema.fieldNames():
            raise ExecutionError(f"Result columns {schema.fieldNames()} differ from the expected {[f.name for f in c.fields]}")
        columns = [{"name": f.name, "type": reported(s.dataType), "field": f.field, "alias": f.alias, "table": f.table, "sensitive": f.sensitive} for f, s in zip(c.fields, schema.fields)]
        return QueryResult(columns, c.df, debug, c.sensitive)

    def _write(self, q: dict, debug: str) -> QueryResult:
        if self.store is None:
            raise ExecutionError("This service has no store to write to.")
        w = Writer(self.compiler, self.store)
        kind = q["type"]
        run = {"insert": w.insert, "update": w.update, "delete": w.delete}.get(kind) or (lambda x: getattr(ddl, kind)(w, x))
        done: Written = self._committed(lambda: run(q))
        if done.insert_id is not None:
            last_insert_id.set(done.insert_id)
        return QueryResult(debug=debug, affected_rows=done.affected_rows, insert_id=done.insert_id)

    def _committed(self, work: Callable[[], Any]) -> Any:
        """Work in a transaction, again if another writer was faster (unless a transaction around it decides)."""
        for attempt in range(TRIES):
            try:
                with self.store.transaction():
                    return work()
            except Conflict:
                if attempt == TRIES - 1 or self.store.open:
                    raise

    def _transaction(self, q: dict, debug: str) -> QueryResult:
        """All statements or none; reads inside see what was written before them."""
        parts = q.get("queries")
        if not isinstance(parts, list) or not parts:
            raise ValidationError("Transaction must contain a non-empty 'queries' array.")
        for p in parts:
            if not isinstance(p, dict) or not p.get("type"):
                raise ValidationError("Each query of a transaction must have a 'type'.")
        if self.store is None:
            raise ExecutionError("This service has no store to write to.")

        def work() -> QueryResult:
            affected, insert_id, last = 0, None, QueryResult(debug=debug)
            for p in parts:
                last = self.execute(p)
                if last.error is not None:
                    raise ExecutionError(last.error)
                affected += last.affected_rows or 0
                insert_id = last.insert_id if last.insert_id is not None else insert_id
            return QueryResult(last.columns, last.df, debug, last.sensitive, affected, insert_id)

        return self._committed(work)
