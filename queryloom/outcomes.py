"""Registered queries over what is no SELECT: rules, exports, metadata, schema changes, materialization.

Each returns its outcome as rows, so that it can be compared with SQL like any other.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from datetime import UTC, datetime, timedelta
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from queryloom import export
from queryloom.errors import CompileError, ExecutionError, ValidationError
from queryloom.fixtures import catalog
from queryloom.materialize.builder import Materializer, index_names
from queryloom.materialize.job import Admin, RefreshJob
from queryloom.materialize.manifest import Manifests, from_dict, generation_pattern, physical_name
from queryloom.materialize.planner import Planner, State
from queryloom.materialize.registry import Registry, Resolver
from queryloom.plans import validate
from queryloom.queries import COUNT, NATIONS, STAR, Query, _fill, _service, _writes, by, f, fn, items, op, plain, sub, win
from queryloom.service import ERROR_MARK, QueryService
from queryloom.sources.catalog import FileCatalog, StaticCatalog, schema_endpoint, table_from
from queryloom.sources.files import Document
from queryloom.sources.store import Store
from queryloom.sources.tables import ParquetFolder, Sources
from queryloom.workspace import shared_folder


def _table(spark: SparkSession, rows: Iterable[tuple], names: str) -> DataFrame:
    """Rows of texts: whatever they hold, as text."""
    text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    return spark.createDataFrame([tuple(map(text, r)) for r in rows], ", ".join(f"{n} string" for n in names.split()))


def expected(names: str, *rows: tuple) -> str:
    """SQL for rows of texts."""
    lit = lambda v: "CAST(NULL AS VARCHAR)" if v is None else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({', '.join(names.split())})"


def _reading(spark: SparkSession, sf_dir: str) -> QueryService:
    return QueryService(spark, catalog(), Sources(ParquetFolder(spark, sf_dir)))


# Rules.

CASES: dict[str, list[tuple[str, dict]]] = {
    "select": [("good", {"type": "select", "fields": [{"element": 1}]}), ("no fields", {"type": "select"}), ("no element", {"type": "select", "fields": [{}]}), ("direction", {"type": "select", "fields": [{"element": 1}], "order_by": [{"element": 1, "direction": "UP"}]}), ("short union", {"type": "select", "union": {"queries": [{}]}})],
    "insert": [("good", {"type": "insert", "table": "t", "values": [{"a": 1}]}), ("no table", {"type": "insert"}), ("nothing", {"type": "insert", "table": "t"}), ("both", {"type": "insert", "table": "t", "values": [{}], "from": {}}), ("empty", {"type": "insert", "table": "t", "values": []})],
    "update": [("good", {"type": "update", "table": "t", "set": {"a": 1}}), ("no set", {"type": "update", "table": "t"}), ("untyped", {"type": "update", "table": "t", "set": {"a": {}}}), ("where", {"type": "update", "table": "t", "set": {"a": 1}, "where": 1})],
    "delete": [("good", {"type": "delete", "table": "t", "where": op("=", 1, 1)}), ("no where", {"type": "delete", "table": "t"}), ("limit", {"type": "delete", "table": "t", "where": op("=", 1, 1), "limit": "x"})],
    "truncate": [("good", {"type": "truncate", "table": "t"}), ("no table", {"type": "truncate"}), ("where", {"type": "truncate", "table": "t", "where": {}}), ("drop", {"type": "drop"}), ("rename", {"type": "rename", "tables": {"from": "a"}})],
    "create": [("good", {"type": "create", "table": "t", "columns": [{"name": "a", "type": "int"}]}), ("no columns", {"type": "create", "table": "t"}), ("no type", {"type": "create", "table": "t", "columns": [{"name": "a"}]}), ("flag", {"type": "create", "table": "t", "columns": [{"name": "a", "type": "int", "nullable": 1}]})],
    "alter": [("good", {"type": "alter", "table": "t", "actions": [{"action": "drop_index", "name": "i"}]}), ("no actions", {"type": "alter", "table": "t"}), ("unknown", {"type": "alter", "table": "t", "actions": [{"action": "FLY"}]}), ("needs", {"type": "alter", "table": "t", "actions": [{"action": "RENAME_COLUMN", "from": "a"}]})],
    "dispatch": [("untyped", {}), ("unknown", {"type": "merge"}), ("good", {"type": "drop", "table": "t"})],
}
SAYS: dict[str, tuple[str | None, ...]] = {
    "select": (None, "SELECT query must contain a non-empty 'fields' array.", "Missing element in fields entry.", "Invalid order direction: UP", "UNION must contain a 'queries' array with at least two SELECTs."),
    "insert": (None, "INSERT query must contain a valid 'table' name.", "INSERT query must contain either 'values' or 'from'.", "INSERT query cannot contain both 'values' and 'from'.", "'values' must be a non-empty array."),
    "update": (None, "UPDATE query must contain a non-empty 'set' object.", "Invalid 'set' value for 'a': missing 'type' in expression.", "'where' must be a valid expression object."),
    "delete": (None, "DELETE query must contain a 'where' clause to avoid full deletions.", "LIMIT must be an integer."),
    "truncate": (None, "TRUNCATE query must define a valid 'table'.", "TRUNCATE query must not contain 'where'.", "DROP query must define a valid 'table'.", "RENAME query requires a valid 'to' table name."),
    "create": (None, "CREATE query must contain a non-empty 'columns' array.", "Column 'a' is missing a valid 'type'.", "Column 'a': 'nullable' must be boolean."),
    "alter": (None, "ALTER query must include a non-empty 'actions' array.", "Unsupported ALTER action: 'FLY' in action #0.", "Action #0 (RENAME_COLUMN) requires 'from' and 'to'."),
    "dispatch": ("Unsupported query type: [not defined]", "Unsupported query type: merge", None),
}


def _rules(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = []
        for name, q in CASES[kind]:
            try:
                validate.validate(q)
                out.append((name, None))
            except ValidationError as e:
                out.append((name, str(e)))
        return _table(spark, out, "input message")

    return run


RULES: dict[str, tuple[Query, str]] = {f"validate_{k}": (_rules(k), expected("input message", *((n, m) for (n, _), m in zip(CASES[k], SAYS[k])))) for k in CASES}


# Exports.

_REGIONS = {"type": "select", "table": "region", "fields": [{"element": f("r_name", "region"), "alias": "name"}, {"element": fn("COUNT", f("n_nationkey", "nation")), "alias": "n"}], "group_by": [f("r_name", "region")], "order_by": by(f("r_name", "region"))}
_N = "(SELECT r_name AS name, COUNT(n_nationkey) AS n FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name)"


def _export(name: str, render: Callable[[export.Exporter], str] = lambda x: x.to_string()) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = export.exporter(name, _reading(spark, sf_dir)).set_query(_REGIONS)
        return _table(spark, [(x.mime, x.extension, render(x))], "mime extension body")

    return run


def _payload(x: export.Exporter) -> str:
    """What a page's script holds as data."""
    text = x.to_string()
    start = text.index('{"')
    return json.dumps(json.JSONDecoder().raw_decode(text[start:])[0], separators=(",", ":"))


def _sql(mime: str, extension: str, body: str) -> str:
    return f"SELECT '{mime}' AS mime, '{extension}' AS extension, {body} AS body FROM {_N}"


def _rows_html(cell: str = "") -> str:
    return f"string_agg('<tr><td{cell}>' || name || '</td><td{cell}>' || n || '</td></tr>', '' ORDER BY name)"


_T = export.HtmlTableExporter
_JSON_ROWS = "string_agg('{\"name\":\"' || name || '\",\"n\":' || n || '}', ',' ORDER BY name)"
EXPORTS: dict[str, tuple[Query, str]] = {
    "export_csv": (_export("csv"), _sql("text/csv", "csv", "'name,n' || chr(10) || string_agg(name || ',' || n || chr(10), '' ORDER BY name)")),
    "export_json": (_export("json", lambda x: json.dumps(json.loads(x.to_string())["rows"], separators=(",", ":"))), _sql("application/json", "json", f"'[' || {_JSON_ROWS} || ']'")),
    "export_html_table": (
        _export("htmltable"),
        _sql("text/html", "html", f"'<table style=\"border-collapse:collapse\"><thead><tr><th style=\"{_T.head}\">name</th><th style=\"{_T.head}\">n</th></tr></thead><tbody>' || {_rows_html(f' style=\"{_T.cell}\"')} || '</tbody></table>'"),
    ),
    "export_html_page": (_export("htmlpage", lambda x: x.to_string().split("<tbody>")[1].split("</tbody>")[0]), _sql("text/html", "html", _rows_html())),
    "export_spreadsheet": (_export("excelhtml", lambda x: x.to_string().split('<table border="1">')[1].split("</table>")[0]), _sql("application/vnd.ms-excel", "xls", f"'<tr><th>name</th><th>n</th></tr>' || {_rows_html()}")),
    "export_data_table": (
        _export("datatable", _payload),
        _sql("text/html", "html", "'{\"columns\":[\"name\",\"n\"],\"rows\":[' || string_agg('[\"' || name || '\",\"' || n || '\"]', ',' ORDER BY name) || '],\"sizes\":[5,10,20],\"size\":10}'"),
    ),
    "export_bar_chart": (_export("barchart", _payload), _sql("text/html", "html", "'{\"type\":\"bar\",\"labels\":[\"' || string_agg(name, '\",\"' ORDER BY name) || '\"],\"values\":[' || string_agg(n || '.0', ',' ORDER BY name) || ']}'")),
    "export_pie_chart": (_export("piechart", _payload), _sql("text/html", "html", "'{\"type\":\"doughnut\",\"labels\":[\"' || string_agg(name, '\",\"' ORDER BY name) || '\"],\"values\":[' || string_agg(n || '.0', ',' ORDER BY name) || ']}'")),
}


def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV and JSON as the executors write them, read again."""
    folder, service = shared_folder(spark, "export"), _reading(spark, sf_dir)
    for kind in ("csv", "json"):
        export.exporter(kind, service).set_query(_REGIONS).to_folder(f"{folder}/{kind}")
    kinds = [spark.read.option("header", True).csv(f"{folder}/csv"), spark.read.json(f"{folder}/json")]
    return kinds[0].selectExpr("'csv' AS kind", "name", "CAST(n AS BIGINT) AS n").unionByName(kinds[1].selectExpr("'json' AS kind", "name", "n"))


def export_factory(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for name in ("csv", "JsonReportExporter", "PIECHART", "fax"):
        try:
            out.append((name, export.exporter(name).name))
        except RuntimeError as e:
            out.append((name, str(e)))
    return _table(spark, out, "asked got")


EXPORTS |= {
    "export_files": (export_files, f"SELECT kind, name, n FROM {_N} CROSS JOIN (VALUES ('csv'), ('json')) t(kind)"),
    "export_factory": (export_factory, expected("asked got", ("csv", "csvreportexporter"), ("JsonReportExporter", "jsonreportexporter"), ("PIECHART", "piechartreportexporter"), ("fax", "Report exporter 'fax' could not be instantiated or is invalid"))),
}


# Metadata and results.


def schema_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables described by JSON files, and what they say of fields."""
    found = FileCatalog(Path(__file__).resolve().parent / "fixtures" / "tables")
    return _table(spark, [(t.name, x.name, x.type, x.nullable, x.primary_key, x.sensitive, x.description) for t in found.tables() for x in t.fields], "tab field kind nullable pk sensitive description")


def schema_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog()
    out = [("domain", i, d) for i, d in enumerate(schema_endpoint(c, "domains"))]
    out += [("table", i, t["name"]) for i, t in enumerate(schema_endpoint(c))]
    out += [("sensitive", i, x["name"]) for i, x in enumerate(x for t in schema_endpoint(c) for x in t["fields"] if x["sensitive"])]
    out += [(k, len(schema_endpoint(c, k)), None) for k in ("categories", "tags")]
    return _table(spark, out, "what place name")


def result_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors with lineage, through functions, subqueries and renaming."""
    s = _reading(spark, sf_dir)
    q = {"type": "select", "table": "orders", "fields": [*plain("orders", "o_orderkey"), *items(buyer=f("c_name", "customer"), shout=fn("UPPER", f("c_name", "customer")), top=sub(table="customer", fields=items(x=fn("MAX", f("c_acctbal", "customer")))), one=1)]}
    return _table(spark, [(c["name"], c["type"], c["field"], c["table"], c["alias"], c["sensitive"]) for c in s.execute(q).columns], "name kind field tab alias sensitive")


def result_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _reading(spark, sf_dir)
    of = lambda *e: s.execute({"type": "select", "table": "customer", "fields": items(**{f"x{i}": x for i, x in enumerate(e)})}).sensitive
    return _table(spark, [("key", of(f("c_custkey", "customer"))), ("name", of(f("c_name", "customer"))), ("count", of(COUNT)), ("inside", of(fn("LENGTH", f("c_name", "customer"))))], "of sensitive")


def result_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes wrong: raised while compiling, kept in the result while running."""
    s, out = _reading(spark, sf_dir), []
    for name, q in (
        ("unreachable", {"table": "part", "fields": plain("documents", "doc_id")}),
        ("element", {"table": "part", "fields": items(x={"type": "hologram"})}),
        ("same name", {"table": "part", "fields": [*plain("part", "p_size"), *plain("part", "p_size")]}),
        ("window distinct", {"table": "part", "fields": items(x={**win("SUM", f("p_size")), "distinct": True})}),
        ("star", {"table": "part", "fields": items(x=fn("SUM", STAR))}),
    ):
        try:
            s.execute({"type": "select", **q})
            out.append((name, "raised", None))
        except (CompileError, ValidationError) as e:
            out.append((name, "raised", str(e)))
    r = s.execute({"type": "select", "table": "part", "fields": items(x=fn("NO_SUCH_FUNCTION", 1))})
    out.append(("function", "kept", f"{bool(r.error)} {ERROR_MARK in r.debug} {len(r.rows())}"))
    r = s.execute({"type": "select", "table": "part", "fields": items(x=1)})
    return _table(spark, [*out, ("debug", "kept", json.loads(r.debug)["table"])], "input how message")


def affected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and numbers of each statement of a life of a table."""
    s = _service(spark, sf_dir)
    kv = {"type": "create", "table": "kv", "columns": [{"name": "id", "type": "int", "primary_key": True, "auto_increment": True}, {"name": "name", "type": "varchar(9)"}, {"name": "n", "type": "int"}]}
    steps = (
        kv,
        {"type": "insert", "table": "kv", "values": [{"name": "a"}, {"name": "b"}]},
        {"type": "insert", "table": "kv", "ignore": True, "values": [{"id": 2, "name": "c"}, {"id": 7, "name": "d"}]},
        {"type": "insert", "table": "kv", "values": [{"id": 7, "name": "e"}, {"id": 8, "name": "f"}], "on_duplicate": {"name": fn("VALUES", f("name"))}},
        {"type": "update", "table": "kv", "set": {"name": "x"}, "where": op(">", f("id"), 1), "limit": 2},
        {"type": "insert", "table": "kv", "values": [{"name": "g"}]},
        {"type": "delete", "table": "kv", "where": op("=", f("name"), "x")},
        {"type": "transaction", "queries": [{"type": "insert", "table": "kv", "values": [{"name": "h"}]}, {"type": "delete", "table": "kv", "where": op("=", f("name"), "h")}]},
    )
    done = [s.execute(q) for q in steps]
    last = s.execute({"type": "select", "table": "region", "fields": items(x=fn("LAST_INSERT_ID")), "limit": 1}).rows()[0]["x"]
    return _table(spark, [*((f"{i} {q['type']}", r.affected_rows, r.insert_id) for i, (q, r) in enumerate(zip(steps, done))), ("last insert id", last, None)], "step affected number")


def zero_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions without arguments: their results differ by run, so what they must satisfy is told."""
    s = _reading(spark, sf_dir)
    got = s.execute({"type": "select", "table": "region", "fields": items(now=op("=", fn("DATE", fn("NOW")), fn("CURDATE")), uuid=fn("LENGTH", fn("UUID")), time=fn("LENGTH", fn("CURTIME")), rand=op("AND", op(">=", fn("RAND"), 0), op("<", fn("RAND"), 1)), version=op(">", fn("LENGTH", fn("VERSION")), 0), base=op(">", fn("LENGTH", fn("DATABASE")), 0)), "limit": 1}).rows()[0]
    return _table(spark, got.items(), "name holds")


METADATA: dict[str, tuple[Query, str]] = {
    "schema_files": (schema_files, expected("tab field kind nullable pk sensitive description", ("log", "what", "string", "true", "false", "false", ""), ("usage", "id", "integer", "false", "true", "false", ""), ("usage", "tokens", "integer", "true", "false", "false", ""), ("usage", "who", "string", "true", "false", "true", "Who"))),
    "schema_listing": (
        schema_listing,
        expected(
            "what place name",
            *(("domain", i, d) for i, d in enumerate(("sales", "activity", "corpus"))),
            *(("table", i, t) for i, t in enumerate("region nation customer supplier part orders lineitem events documents labels".split())),
            ("sensitive", 0, "c_name"),
            ("sensitive", 1, "c_acctbal"),
            ("categories", 0, None),
            ("tags", 0, None),
        ),
    ),
    "result_columns": (result_columns, expected("name kind field tab alias sensitive", ("o_orderkey", "integer", "o_orderkey", "orders", None, "false"), ("buyer", "string", "c_name", "customer", "buyer", "true"), ("shout", "string", None, None, "shout", "true"), ("top", "double", None, None, "top", "true"), ("one", "integer", None, None, "one", "false"))),
    "result_sensitivity": (result_sensitivity, expected("of sensitive", ("key", "false"), ("name", "true"), ("count", "false"), ("inside", "true"))),
    "result_errors": (
        result_errors,
        expected(
            "input how message",
            ("unreachable", "raised", "No join path from 'part' to 'documents'"),
            ("element", "raised", "Unsupported element type: hologram"),
            ("same name", "raised", "Result columns must have different names: p_size"),
            ("window distinct", "raised", "DISTINCT is not supported in a window function."),
            ("star", "raised", "'*' is only allowed in COUNT, not in SUM."),
            ("function", "kept", "True True 0"),
            ("debug", "kept", "part"),
        ),
    ),
    "affected_rows": (
        affected_rows,
        expected("step affected number", ("0 create", 0, None), ("1 insert", 2, 1), ("2 insert", 1, None), ("3 insert", 3, None), ("4 update", 2, None), ("5 insert", 1, 9), ("6 delete", 2, None), ("7 transaction", 2, 10), ("last insert id", 10, None)),
    ),
    "zero_functions": (zero_functions, expected("name holds", ("now", "true"), ("uuid", 36), ("time", 8), ("rand", "true"), ("version", "true"), ("base", "true"))),
}


# Writes that the first set lacks.


def _names(*statements: dict) -> Query:
    """The tables there are after some statements."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _service(spark, sf_dir)
        for q in statements:
            s.execute(q)
        return _table(spark, [(n,) for n in s.store.names()], "name")

    return run


def _structure(*actions: dict) -> Query:
    """Columns and indexes of a table after ALTER actions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _service(spark, sf_dir)
        _fill(s)
        s.execute({"type": "alter", "table": "stock", "actions": list(actions)})
        info = s.store.info("stock")
        out = [("column", x.name, x.dataType.simpleString()) for x in s.store.schema("stock").fields]
        out += [(k, n, ",".join(c)) for k in ("indexes", "unique") for n, c in info[k].items()]
        return _table(spark, [*out, ("not null", ",".join(sorted(info["not_null"])), None), ("rows", s.store.find("stock").count(), None)], "what name detail")

    return run


def unique_index_refuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _service(spark, sf_dir)
    _fill(s)
    out = []
    for q in (
        {"type": "alter", "table": "stock", "actions": [{"action": "ADD_UNIQUE_INDEX", "name": "u", "columns": ["n"]}]},
        {"type": "alter", "table": "stock", "actions": [{"action": "ADD_UNIQUE_INDEX", "name": "u", "columns": ["name"]}]},
        {"type": "insert", "table": "stock", "values": [{"id": -1, "name": "Customer#000000001"}, {"id": -2, "name": "Customer#000000001"}]},
        {"type": "alter", "table": "stock", "actions": [{"action": "DROP_INDEX", "name": "u"}]},
        {"type": "alter", "table": "stock", "actions": [{"action": "DROP_INDEX", "name": "u"}]},
        {"type": "insert", "table": "stock", "values": [{"id": -1, "name": "x"}, {"id": -2, "name": "x"}]},
    ):
        try:
            out.append((len(out), f"{q['type']} {s.execute(q).affected_rows}"))
        except ExecutionError as e:
            out.append((len(out), str(e)))
    return _table(spark, out, "step outcome")


_ROWS_SQL = "(SELECT CAST(COUNT(*) AS VARCHAR) FROM customer)"
_TWO_KEYS = {"type": "create", "table": "stock", "columns": [{"name": "id", "type": "bigint", "primary_key": True}, {"name": "name", "type": "varchar(50)"}, {"name": "n", "type": "int", "default": 0}]}
_BY_NAME = {"type": "alter", "table": "stock", "actions": [{"action": "ADD_UNIQUE_INDEX", "name": "by_name", "columns": ["name"]}]}
_LINES = {"type": "select", "table": "lineitem", "fields": [{"element": f("l_suppkey", "lineitem")}, {"element": fn("CAST", f("l_linenumber", "lineitem"), "CHAR")}, {"element": f("l_linenumber", "lineitem"), "alias": "n"}]}
MORE_WRITES: dict[str, tuple[Query, str]] = {
    "drop_table": (_names(NATIONS, {**NATIONS, "table": "other"}, {"type": "drop", "table": "stock"}), expected("name", ("other",))),
    "insert_ignore_ties": (
        _writes(NATIONS, {"type": "insert", "table": "stock", "ignore": True, "values": [{"id": 1, "name": "a"}, {"id": 1, "name": "b"}, {"id": 2, "name": "c"}]}, {"type": "insert", "table": "stock", "ignore": True, "values": [{"id": 2, "name": "d"}, {"id": 3, "name": "e"}, {"id": 3, "name": "f"}]}, fill=False),
        "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', 0), (2, 'c', 0), (3, 'e', 0)) t(id, name, n)",
    ),
    "upsert_twice": (
        _writes({"type": "insert", "table": "stock", "from": _LINES, "on_duplicate": {"n": op("+", f("n", "stock"), fn("VALUES", f("n")))}}),
        "SELECT id, coalesce(name, '1') AS name, CAST(n AS INTEGER) AS n FROM (SELECT coalesce(c_custkey, k) AS id, c_name AS name, coalesce(c_nationkey, 0) + coalesce(s, 0) AS n FROM customer FULL JOIN (SELECT l_suppkey AS k, SUM(l_linenumber) AS s FROM lineitem GROUP BY 1) ON k = c_custkey)",
    ),
    "upsert_second_key": (
        _writes(_TWO_KEYS, _BY_NAME, {"type": "insert", "table": "stock", "values": [{"id": 1, "name": "a", "n": 1}, {"id": 2, "name": "b", "n": 2}]}, {"type": "insert", "table": "stock", "values": [{"id": 9, "name": "b", "n": 5}, {"id": 1, "name": "z", "n": 7}, {"id": 3, "name": "c", "n": 3}], "on_duplicate": {"n": op("+", f("n", "stock"), fn("VALUES", f("n")))}}, fill=False),
        "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', 8), (2, 'b', 7), (3, 'c', 3)) t(id, name, n)",
    ),
    "update_limit": (
        _writes({"type": "update", "table": "stock", "set": {"n": -1}, "where": op("<", f("id", "stock"), 10), "limit": 10}),
        "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey < 10 THEN -1 ELSE c_nationkey END AS n FROM customer",
    ),
    "alter_indexes": (
        _structure({"action": "ADD_INDEX", "name": "i", "columns": ["n"]}, {"action": "ADD_UNIQUE_INDEX", "name": "u", "columns": ["id", "name"]}, {"action": "ADD_INDEX", "name": "gone", "columns": ["name"]}, {"action": "DROP_INDEX", "name": "gone"}),
        expected("what name detail", ("column", "id", "bigint"), ("column", "name", "string"), ("column", "n", "int"), ("indexes", "i", "n"), ("unique", "u", "id,name"), ("not null", "id", None)) + f" UNION ALL SELECT 'rows', {_ROWS_SQL}, NULL",
    ),
    "alter_modify_rename": (
        _structure({"action": "MODIFY_COLUMN", "name": "n", "type": "bigint", "nullable": False}, {"action": "RENAME_COLUMN", "from": "name", "to": "label"}),
        expected("what name detail", ("column", "id", "bigint"), ("column", "label", "string"), ("column", "n", "bigint"), ("not null", "id,n", None)) + f" UNION ALL SELECT 'rows', {_ROWS_SQL}, NULL",
    ),
    "alter_modify_values": (
        _writes({"type": "alter", "table": "stock", "actions": [{"action": "MODIFY_COLUMN", "name": "n", "type": "varchar(9)"}, {"action": "RENAME_COLUMN", "from": "name", "to": "label"}]}),
        "SELECT c_custkey AS id, c_name AS label, CAST(c_nationkey AS VARCHAR) AS n FROM customer",
    ),
    "unique_index_refuses": (
        unique_index_refuses,
        expected("step outcome", (0, "Duplicate entry for key 'u'"), (1, "alter 0"), (2, "Duplicate entry for key (name)"), (3, "alter 0"), (4, "Can't DROP 'u'; check that it exists"), (5, "insert 2")),
    ),
}


def concurrent_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second writer commits while the first one works: both land, and the first works again where it must."""
    folder = shared_folder(spark, "store")
    first, second = (QueryService(spark, catalog(), Sources(ParquetFolder(spark, sf_dir)), Store(spark, folder), strict=True) for _ in range(2))
    for t in ("stock", "other"):
        first.execute({**NATIONS, "table": t})
    add = lambda t, i: {"type": "insert", "table": t, "values": [{"id": i, "name": str(i)}]}
    with first.store.transaction():
        first.execute(add("stock", 1))
        second.execute(add("other", 2))
    tries = []

    def work() -> None:
        tries.append(1)
        first.execute(add("stock", 3))
        if len(tries) == 1:
            second.execute(add("stock", 4))

    first._committed(work)
    out = [(t, r["id"]) for t in ("stock", "other") for r in first.store.find(t).collect()]
    return _table(spark, [*out, ("tries", len(tries))], "tab id")


MORE_WRITES["concurrent_commits"] = (concurrent_commits, expected("tab id", ("stock", 1), ("stock", 3), ("stock", 4), ("other", 2), ("tries", 2)))


# Materialization.


class _Clock:
    def __init__(self) -> None:
        self.at = datetime(2024, 1, 1, 1, 0, tzinfo=UTC)

    def __call__(self) -> datetime:
        self.at += timedelta(seconds=1)
        return self.at


def _spec(i: str, **more: Any) -> dict:
    return {"id": i, "targetSchema": "rep", "target": {"logicalTable": i, "keepGenerations": 2}, "query": {"table": "region", "fields": items(k=f("r_regionkey", "region"))}, "columns": [{"name": "key", "type": "bigint"}], **more}


def _world(spark: SparkSession, sf_dir: str) -> tuple[_Clock, QueryService, Registry, Materializer]:
    clock, folder = _Clock(), shared_folder(spark, "materialized")
    store, registry = Store(spark, folder), Registry(f"{folder}/registry", lambda: int(clock.at.timestamp()), spark)
    service = QueryService(spark, catalog(), Sources(Resolver(registry, store), ParquetFolder(spark, sf_dir)), store)
    return clock, service, registry, Materializer(service, registry, clock)


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four builds: two generations stay, the newest is current, files of the others are gone, every run is logged."""
    _, service, registry, m = _world(spark, sf_dir)
    spec, other = from_dict(_spec("course")), from_dict(_spec("course_rows"))
    builds = [m.build(other), *(m.build(spec) for _ in range(4))]
    names = [n for n in service.store.names() if generation_pattern(spec).fullmatch(n)]
    kept = service.store._fs().listStatus(service.store._path(f"{service.store.root}/data"))
    out = [("ok", sum(b.ok for b in builds)), ("rows", builds[-1].row_count), ("kept", len(names)), ("other kept", registry.current("course_rows")["physical_table"] in service.store.names()), ("newest is current", registry.current("course", "rep")["physical_table"] == max(names)), ("current", sum(g["is_current"] for g in registry.generations("course"))), ("logged", ",".join(r["status"] for r in registry.runs("course"))), ("folders", len(kept))]
    cleaned = registry.clean(lambda t: t in service.store.names(), 1)
    return _table(spark, [*out, ("forgotten", cleaned["generations"]), ("runs forgotten", cleaned["runs"]), ("after", len(registry.generations()))], "what value")


def manifest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests that can't be built, and why; nothing of them stays."""
    _, service, registry, m = _world(spark, sf_dir)
    out = []
    for name, spec in (
        ("no table", {"id": "y"}),
        ("not null", _spec("x", columns=[{"name": "key", "type": "bigint", "nullable": False}], query={"table": "region", "fields": items(k=None)})),
        ("columns", _spec("x", columns=[{"name": "a", "type": "int"}, {"name": "b", "type": "int"}])),
        ("unique", _spec("x", query={"table": "nation", "fields": items(k=f("n_regionkey", "nation"))}, indexes=[{"columns": ["key"], "unique": True}])),
        ("no select", _spec("x", query={"type": "raw_select", "sql": "DROP TABLE x"})),
        ("unpublished", _spec("x", query={"type": "raw_select", "sql": "SELECT 1 FROM {{table:rep.nowhere}}"})),
    ):
        out.append((name, m.build(from_dict(spec)).message))
    out.append(("incremental", m.refresh(from_dict(_spec("z", refresh={"mode": "incremental"}))).message))
    return _table(spark, [*out, ("left", len(service.store.names())), ("current", registry.current("x")), ("failed", sum(r["status"] == "failed" for r in registry.runs("x")))], "input message")


def manifest_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and defaults of declared columns, also for what is inserted afterwards."""
    _, service, registry, m = _world(spark, sf_dir)
    spec = _spec("numbered", query={"table": "region", "fields": items(k=None, n=f("r_name", "region"), s="new")}, columns=[{"name": "id", "type": "int", "autoIncrement": True, "primaryKey": True}, {"name": "name", "type": "varchar(40)"}, {"name": "state", "type": "varchar(9)", "default": "open"}])
    if not (done := m.build(from_dict(spec))).ok:
        raise RuntimeError(done.message)
    physical = registry.current("numbered")["physical_table"]
    service.execute({"type": "insert", "table": physical, "columns": ["name"], "values": [{"name": "ATLANTIS"}]})
    rows = service.store.find(physical).collect()
    return _table(spark, [("ids", ",".join(str(r["id"]) for r in sorted(rows))), *((r["name"], r["state"]) for r in rows)], "name value")


def manifest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = from_dict(_spec("a b", indexes=[{"columns": ["key"]}, {"fields": ["key"], "unique": True, "name": "u"}]))
    out = [("index", n, f"{','.join(x['columns'])} {x['unique']}") for n, x in index_names(a).items()]
    out += [("index", n, None) for n in index_names(from_dict(_spec("m", indexes={"named": ["key"]})))]
    out += [("physical", physical_name(a, "20240101000000", "0a1b"), None), ("matches", generation_pattern(a).fullmatch("mat_a_b_20240101000000_0a1b") is not None, None), ("longer prefix", generation_pattern(a).fullmatch("mat_a_b_rows_20240101000000_0a1b") is not None, None), ("state key", Planner.key("m", "last_status"), None)]
    return _table(spark, out, "what name detail")


def manifest_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = op("=", f("r_regionkey"), 1)
    specs = [_spec("v", variantPriority=1, priority=5), _spec("v", variantPriority=2, conditions={"requiresTables": ["extra"]}, priority=7), _spec("off", enabled=False), _spec("w", conditionalWhere=[{"requiresTables": ["extra"], "where": where, "dependsOn": ["v"]}])]
    out = []
    for name, ms in (("without", Manifests(specs)), ("with", Manifests(specs, lambda t: t == "extra"))):
        out += [(name, m.id, m.priority, m.query.get("where") == where, ",".join(m.depends_on)) for m in ms.all()]
    t = Manifests(specs).table("w")
    return _table(spark, [*out, ("table", t.name, t.domain, "materialized" in t.tags, ",".join(x.name for x in t.fields))], "extra id priority filtered depends")


def refresh_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is due when, under each policy, and in which order."""
    clock, _, registry, m = _world(spark, sf_dir)
    ms = Manifests([_spec("m10", dependsOn=["m2"]), _spec("m2", dependsOn=["m1"], refresh={"schedule": {"policy": "manual"}}), _spec("m1", refresh={"schedule": {"policy": "daily_after", "time": "02:00"}}), _spec("m3", priority=1, refresh={"schedule": {"policy": "always"}})])
    p, out = Planner(ms, registry, State(), clock), []
    tell = lambda name, plan: out.append((name, ",".join(x.id for x in plan)))
    tell("first", p.plan())
    for i in ("m1", "m2"):
        m.build(ms.get(i))
    p.result(ms.get("m10"), m.build(ms.get("m10")))
    tell("just built", p.plan())
    clock.at += timedelta(seconds=301)
    tell("after the interval", p.plan())
    clock.at = datetime(2024, 1, 1, 2, 0, tzinfo=UTC)
    tell("after two", p.plan())
    tell("forced", p.plan(only=["m10"], force=True))
    try:
        Planner(Manifests([_spec("a", dependsOn=["b"]), _spec("b", dependsOn=["a"])]), registry, State(), clock).plan()
    except RuntimeError as e:
        out.append(("cycle", str(e)))
    return _table(spark, out, "moment plan")


def refresh_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job's report, the state it keeps, and the administration's counters and grids."""
    clock, service, registry, m = _world(spark, sf_dir)
    state = Document(f"{service.store.root}/state", spark)
    p = Planner(Manifests([_spec("a"), _spec("b", query={"table": "nowhere", "fields": items(k=1)}), _spec("c10"), _spec("c9")]), registry, State(state.path, spark), clock)
    job = RefreshJob(p, m, {"keep_runs": 1, "force": True})
    out = [("run", job.run().split(";")[0]), ("force", job.settings["force"]), ("again", job.run().split(";")[0])]
    kept = State(state.path, spark)
    out += [("state a", kept.get(p.key("a", "last_status"))), ("state b", kept.get(p.key("b", "last_status")))]
    admin = Admin(job)
    out += [(k, v) for k, v in admin.overview().items() if k in ("manifests", "enabled", "current", "tables", "running")]
    out += [("natural order", ",".join(r["id"] for r in admin.grid("manifests", sort="id")["rows"])), ("search", admin.grid("manifests", search="C1")["total"]), ("filter", admin.grid("runs", filters={"status": "succ"})["total"]), ("page size", admin.grid("runs", size=1000)["size"]), ("second page", ",".join(r["id"] for r in admin.grid("manifests", sort="id", page=2, size=3)["rows"])), ("action", admin.act("refresh_manifest", "a").ok)]
    out.append(("inactive", RefreshJob(p, m, {"active": False}).run()))
    first = registry.start({"manifest_id": "a"})
    registry.start({"manifest_id": "a"})
    return _table(spark, [*out, ("superseded", next(r for r in registry.runs("a") if r["id"] == first)["message"])], "what value")


BUILDS: dict[str, tuple[Query, str]] = {
    "generations": (generations, expected("what value", ("ok", 5), ("rows", 5), ("kept", 2), ("other kept", "true"), ("newest is current", "true"), ("current", 1), ("logged", "success,success,success,success"), ("folders", 3), ("forgotten", 2), ("runs forgotten", 3), ("after", 3))),
    "manifest_checks": (
        manifest_checks,
        expected(
            "input message",
            ("no table", "Manifest 'y' must define 'logicalTable'."),
            ("not null", "Column 'key' cannot be null"),
            ("columns", "Query of 'x' has 1 columns, the manifest 2."),
            ("unique", "Duplicate entry for key (key)"),
            ("no select", "A raw query must be a SELECT."),
            ("unpublished", "Table 'rep.nowhere' is not published."),
            ("incremental", "Incremental refresh of 'z' is not implemented yet."),
            ("left", 0),
            ("current", None),
            ("failed", 5),
        ),
    ),
    "manifest_columns": (manifest_columns, expected("name value", ("ids", "1,2,3,4,5,6"), ("ATLANTIS", "open")) + " UNION ALL SELECT r_name, 'new' FROM region"),
    "manifest_names": (
        manifest_names,
        expected("what name detail", ("index", "idx_a_b_key", "key False"), ("index", "u", "key True"), ("index", "named", None), ("physical", "mat_a_b_20240101000000_0a1b", None), ("matches", "true", None), ("longer prefix", "false", None), ("state key", "materialization.m.last_status", None)),
    ),
    "manifest_variants": (
        manifest_variants,
        expected("extra id priority filtered depends", ("without", "v", 5, "false", ""), ("without", "w", 100, "false", ""), ("with", "v", 7, "false", ""), ("with", "w", 100, "true", "v"), ("table", "w", "rep", "true", "key")),
    ),
    "refresh_policies": (
        refresh_policies,
        expected("moment plan", ("first", "m3,m1,m2,m10"), ("just built", "m3"), ("after the interval", "m3,m10"), ("after two", "m3,m1,m10"), ("forced", "m1,m2,m10"), ("cycle", "Circular materialization dependency detected at manifest: a")),
    ),
    "refresh_job": (
        refresh_job,
        expected(
            "what value",
            ("run", "4 manifests, 3 refreshed, 1 failed"),
            ("force", "false"),
            ("again", "1 manifests, 0 refreshed, 1 failed"),
            ("state a", "success"),
            ("state b", "failed"),
            ("manifests", 4),
            ("enabled", 4),
            ("current", 3),
            ("tables", 3),
            ("running", 0),
            ("natural order", "a,b,c9,c10"),
            ("search", 1),
            ("filter", 3),
            ("page size", 250),
            ("second page", "c10"),
            ("action", "true"),
            ("inactive", "Materialization refresh is not active."),
            ("superseded", "Superseded by a newer run."),
        ),
    ),
}

ALL = RULES | EXPORTS | METADATA | MORE_WRITES | BUILDS
