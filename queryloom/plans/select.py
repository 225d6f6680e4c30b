"""SELECT documents as DataFrames.

One pass builds the plan: joins from the relationship graph, filter, aggregation, having,
order, projection, limit. Aggregates are collected from all clauses into one ``agg``
under hidden names, so HAVING and ORDER BY may use ones that the SELECT list has not.
Nothing is executed here; Catalyst gets one logical plan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryloom.errors import CompileError, ValidationError
from queryloom.functions import registry
from queryloom.plans import joins, validate
from queryloom.plans.expressions import Builder, canonical, quoted, walk
from queryloom.plans.joins import Node
from queryloom.plans.scope import Scope
from queryloom.sources.catalog import Provider
from queryloom.sources.tables import Sources


@dataclass(frozen=True)
class OutputField:
    """A column of a result and where it comes from."""

    name: str
    field: str | None
    table: str | None
    alias: str | None
    sensitive: bool


@dataclass
class Compiled:
    df: DataFrame
    fields: list[OutputField]
    wildcard: bool = False

    @property
    def sensitive(self) -> bool:
        return any(f.sensitive for f in self.fields)


class Compiler:
    def __init__(self, catalog: Provider, sources: Sources) -> None:
        self.catalog, self.sources = catalog, sources
        self.graph = joins.graph_of(catalog)

    def compile(self, q: dict, outer: Scope | None = None) -> Compiled:
        validate.select(q)
        return self._union(q, outer) if "union" in q else self._select(q, outer)

    # FROM and joins, also used by statements that write.

    def scan(self, name: str) -> DataFrame:
        try:
            return self.sources.table(name)
        except LookupError as e:
            raise CompileError(str(e)) from e

    def joined(self, base: Node, elements: list, outer: Scope | None = None, frame: DataFrame | None = None) -> tuple[DataFrame, Scope]:
        """The FROM table with the joins that elements need."""
        scope = Scope(base, outer)
        wanted = scope.request(elements)
        df = (self.scan(base.table) if frame is None else frame).alias(base.alias)
        scope.schemas[base.alias] = df.schema
        for step in joins.plan(self.graph, base, wanted):
            right = self.scan(step.node.table).alias(step.node.alias)
            scope.nodes.setdefault(step.node.alias, step.node)
            scope.schemas[step.node.alias] = right.schema
            on = reduce(lambda a, b: a & b, (F.col(quoted(step.left, a)) == F.col(quoted(step.node.alias, b)) for a, b in step.on))
            df = df.join(right, on, step.how)
        return df, scope

    def builder(self, scope: Scope, known: dict[str, Column] | None = None, missing: Any = None) -> Builder:
        return Builder(scope, lambda q: self.compile({"type": "select", **q}, scope).df, known, missing)

    # Select.

    def _select(self, q: dict, outer: Scope | None) -> Compiled:
        items = q["fields"]
        orders = [(o.get("element", o.get("expression")), o.get("direction", "ASC")) for o in q.get("order_by") or ()]
        groups, where, having = list(q.get("group_by") or ()), q.get("where") or None, q.get("having") or None
        elements = [*(i["element"] for i in items), *groups, *(o for o, _ in orders), *(x for x in (where, having) if x)]
        derived = q.get("table") or q.get("from")
        frame = None
        if isinstance(derived, dict):  # a subquery as the FROM table
            inner = derived.get("query", derived)
            name = q.get("tablealias") or "derived"
            frame, base = self.compile({"type": "select", **inner}, outer).df, Node(name, name)
        else:
            name = derived or next((f["table"] for e in elements for f in walk(e) if f["type"] == "fld" and f.get("table")), None)
            if not name:
                raise CompileError("Query must contain 'table' or at least one field reference with 'table'.")
            base = Node(name, q.get("tablealias") or name)
            if provider := q.get("schema") or q.get("provider"):
                frame = self.sources.find(f"{provider}:{name}")  # else the plain name is scanned
        df, scope = self.joined(base, elements, outer, frame)
        for i in items:
            if alias := i.get("alias") or (i["element"].get("alias") if isinstance(i["element"], dict) else None):
                scope.items[alias] = i["element"]
        orders, groups = [(self._by_alias(o, scope), d) for o, d in orders], [self._by_alias(g, scope) for g in groups]
        having = self._having(having, scope)

        plain = self.builder(scope)
        if where:
            df = df.where(plain.predicate(where))
        uses = [e for x in [*(i["element"] for i in items), *(o for o, _ in orders), *([having] if having else [])] for e in walk(x)]
        aggregated = bool(groups) or any(e["type"] == "fn" and registry.is_aggregate(str(e.get("function", ""))) for e in uses)
        build = plain
        if aggregated:
            df, build = self._aggregate(df, scope, plain, groups, uses)
        if having:
            df = df.where(build.predicate(having))

        columns, fields, wildcard = self._project(items, scope, build, aggregated)
        first_distinct = [bool(i.get("distinct")) for i in items]
        if any(first_distinct[1:]) and not q.get("distinct"):
            raise ValidationError("'distinct' of a field is only possible on the first field.")
        distinct = bool(q.get("distinct")) or first_distinct[0]
        if distinct:
            df = df.select(*columns).distinct()
            if orders:
                by_item = {canonical(i["element"], scope): f.name for i, f in zip(items, fields)} if not wildcard else {}
                names = set(df.columns)
                keys = []
                for o, d in orders:
                    name = by_item.get(canonical(o, scope)) or (o.get("field") if isinstance(o, dict) and o.get("type") == "fld" else None)
                    if name not in names:
                        raise CompileError("ORDER BY of a DISTINCT query must name a selected field.")
                    keys.append(F.col(quoted(name)).desc() if str(d).upper() == "DESC" else F.col(quoted(name)).asc())
                df = df.orderBy(*keys)
        else:
            if orders:
                df = df.orderBy(*(build.ordered(o, d) for o, d in orders))
            df = df.select(*columns)
        return Compiled(self._cut(df, q), fields, wildcard)

    @staticmethod
    def _cut(df: DataFrame, q: dict) -> DataFrame:
        if q.get("offset") is not None and int(q["offset"]) > 0:
            df = df.offset(int(q["offset"]))
        return df.limit(int(q["limit"])) if q.get("limit") is not None else df

    @staticmethod
    def _by_alias(e: Any, scope: Scope) -> Any:
        """A bare field that names a select item is that item."""
        if isinstance(e, dict) and e.get("type") == "fld" and not e.get("table") and e.get("field") in scope.items:
            return scope.items[e["field"]]
        return e

    def _having(self, e: Any, scope: Scope) -> Any:
        """HAVING may name select items too, anywhere in it."""
        if isinstance(e, list):
            return [self._having(x, scope) for x in e]
        if not isinstance(e, dict) or e.get("type") == "subquery":
            return e
        swapped = self._by_alias(e, scope)
        if swapped is not e:
            return swapped
        return {k: self._having(v, scope) if k in ("params", "cases", "when", "then", "else") else v for k, v in e.items()} if "type" in e or "when" in e else e

    def _aggregate(self, df: DataFrame, scope: Scope, plain: Builder, groups: list, uses: list[dict]) -> tuple[DataFrame, Builder]:
        """Group, with every aggregate of any clause in one pass."""
        known: dict[str, Column] = {}
        keys, grouped = [], set()
        for k, g in enumerate(groups):
            text = canonical(g, scope)
            if text not in known:
                keys.append(plain.build(g).alias(f"_g{k}"))
                known[text] = F.col(f"_g{k}")
                if isinstance(g, dict) and g.get("type") == "fld":
                    grouped.add(scope.locate(g))
        measures: dict[str, Column] = {}
        for e in uses:
            if e["type"] == "fn" and registry.is_aggregate(str(e.get("function", ""))):
                text = canonical(e, scope)
                if text not in known:
                    name = f"_a{len(measures)}"
                    measures[name] = plain.build(e).alias(name)
                    known[text] = F.col(name)
        # A field that a grouped primary key determines may stand alone.
        loose: dict[tuple[str, str], str] = {}
        inside = {id(x) for e in uses if e["type"] == "fn" and registry.is_aggregate(str(e.get("function", ""))) for x in walk(e)}
        for e in uses:
            if e["type"] == "fld" and e.get("field") != "*" and id(e) not in inside and not scope.is_outer(e) and canonical(e, scope) not in known:
                at = scope.locate(e)
                table = self.catalog.table(scope.nodes[at[0]].table) if at[0] in scope.nodes else None
                if table is not None and table.primary_key and all((at[0], k) in grouped for k in table.primary_key) and at not in loose:
                    loose[at] = f"_l{len(loose)}"
                    measures[loose[at]] = F.any_value(scope.column(e)).alias(loose[at])

        def missing(f: dict) -> Column | None:
            at = scope.locate(f)
            return F.col(loose[at]) if at in loose else None

        if not measures:
            df = df.select(*keys).distinct()
        else:
            # A plain select of aggregates stays unanalyzed until an outer query gives its fields.
            df = df.groupBy(*keys).agg(*measures.values()) if keys else df.select(*measures.values())
        return df, self.builder(scope, known, missing)

    def _project(self, items: list[dict], scope: Scope, build: Builder, aggregated: bool) -> tuple[list[Column], list[OutputField], bool]:
        columns, fields, wildcard = [], [], False
        for k, item in enumerate(items):
            e = item["element"]
            alias = item.get("alias") or (e.get("alias") if isinstance(e, dict) else None)
            if isinstance(e, dict) and e.get("type") == "fld" and e.get("field") == "*":
                if aggregated:
                    raise CompileError("'*' can't be selected beside aggregates.")
                wildcard = True
                for a in [scope.node(e).alias] if e.get("table") else list(scope.schemas):
                    for name in scope.schemas[a].fieldNames():
                        columns.append(F.col(quoted(a, name)).alias(name))
                        fields.append(OutputField(name, name, scope.nodes[a].table, None, self._is_sensitive(scope.nodes[a].table, name)))
                continue
            direct = isinstance(e, dict) and e.get("type") == "fld"
            name = alias or (e["field"] if direct else f"expr_{k + 1}")
            col = build.build(e)
            columns.append(col.alias(name))
            table = None
            if direct:
                where = scope.locate(e)[0]
                table = scope.nodes[where].table if where in scope.nodes else e.get("table")
            fields.append(OutputField(name, e["field"] if direct else None, table, alias, self._touches_sensitive(e, scope)))
        names = [f.name for f in fields]
        if len(set(names)) < len(names) and not wildcard:
            twice = sorted({n for n in names if names.count(n) > 1})
            raise CompileError(f"Result columns must have different names: {', '.join(twice)}")
        if wildcard and len(set(names)) < len(names):  # of equal names in a wildcard the last one stays
            last = {n: i for i, n in enumerate(names)}
            at = sorted(last.values())
            columns, fields = [columns[i] for i in at], [fields[i] for i in at]
        return columns, fields, wildcard

    def _is_sensitive(self, table: str, name: str) -> bool:
        t = self.catalog.table(table)
        f = t.field(name) if t else None
        return bool(t and (t.sensitive or (f and f.sensitive)))

    def _touches_sensitive(self, e: Any, scope: Scope) -> bool:
        """Lineage: an expression is sensitive if any field in it is, also through a subquery."""
        if isinstance(e, list):
            return any(self._touches_sensitive(x, scope) for x in e)
        for x in walk(e):
            if x["type"] == "subquery" and isinstance(x.get("query"), dict):
                if self.compile({"type": "select", **x["query"]}, scope).sensitive:
                    return True
            if x["type"] == "fld" and x.get("field") not in (None, "*"):
                inner: Scope | None = scope
                while inner is not None and inner.is_outer(x):
                    inner = inner.outer
                alias = inner.locate(x)[0] if inner is not None else None
                table = inner.nodes[alias].table if inner is not None and alias in inner.nodes else x.get("table")
                if table and self._is_sensitive(table, x["field"]):
                    return True
        return False

    # Union.

    def _union(self, q: dict, outer: Scope | None) -> Compiled:
        spec = q["union"]
        parts = [self.compile(p, outer) for p in spec["queries"]]
        width = len(parts[0].df.columns)
        if any(len(p.df.columns) != width for p in parts):
            raise CompileError("The queries of a UNION must have equally many fields.")
        df = reduce(lambda a, b: a.union(b), (p.df for p in parts))
        if spec.get("distinct", True):
            df = df.distinct()
        fields = [OutputField(f.name, f.field, f.table, f.alias, any(p.fields[i].sensitive for p in parts if i < len(p.fields))) for i, f in enumerate(parts[0].fields)]
        if q.get("order_by"):
            base = Node("union", "union")
            df = df.alias("union")
            scope = Scope(base)
            scope.schemas["union"] = df.schema
            build = self.builder(scope)
            df = df.orderBy(*(build.ordered({**e, "table": None} if isinstance(e := o.get("element", o.get("expression")), dict) else e, o.get("direction", "ASC")) for o in q["order_by"]))
        return Compiled(self._cut(df, q), fields, any(p.wildcard for p in parts))
