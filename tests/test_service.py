"""The service, writes, exporters, and what nulls do."""

import json

import pytest

from queryloom import export
from queryloom.errors import CompileError, ExecutionError, ValidationError
from queryloom.functions.registry import date_pattern
from queryloom.functions.types import column_type
from queryloom.queries import case, f, fn, items, op, plain, sub, win
from queryloom.service import ERROR_MARK, QueryService
from queryloom.sources.catalog import StaticCatalog, table_from
from queryloom.sources.files import Conflict
from queryloom.sources.store import Store
from queryloom.sources.tables import Frames, Sources

USERS = {"name": "users", "fields": [{"name": "id", "primaryKey": True}, {"name": "email", "sensitive": True}, {"name": "manager_id"}], "joins": [{"targetTable": "users", "on": {"users.manager_id": "users.id"}, "type": "LEFT"}, {"targetTable": "logs", "on": {"users.id": "logs.user_id"}, "type": "LEFT"}]}


@pytest.fixture
def service(spark, tmp_path):
    frames = Frames({
        "users": spark.createDataFrame([(1, "a@x", None), (2, "b@x", 1), (3, None, 1)], "id int, email string, manager_id int"),
        "logs": spark.createDataFrame([(1, "in"), (1, "out"), (3, None)], "user_id int, what string"),
        "nulls": spark.createDataFrame([(1, "7", 1.5), (2, None, None), (3, "x", 0.0)], "k int, v string, x double"),
    })
    catalog = StaticCatalog([table_from(USERS), table_from({"name": "logs"}), table_from({"name": "nulls"})])
    return QueryService(spark, catalog, Sources(frames), Store(spark, str(tmp_path / "store")))


def rows(service, **q):
    return [tuple(r.values()) for r in service.execute({"type": "select", **q}).rows()]


def test_result_columns_and_lineage(service):
    r = service.execute({"type": "select", "table": "users", "fields": [{"element": f("id", "users")}, *items(mail=fn("UPPER", f("email", "users")), n=1)]})
    assert [(c["name"], c["type"], c["field"], c["sensitive"]) for c in r.columns] == [("id", "integer", "id", False), ("mail", "string", None, True), ("n", "integer", None, False)]
    assert r.sensitive and json.loads(r.debug)["table"] == "users" and "Scan" in r.explain()
    assert not service.execute({"type": "select", "table": "users", "fields": plain("users", "id")}).sensitive
    assert service.execute({"type": "select", "table": "logs", "fields": items(x=sub(table="users", fields=items(m=fn("MAX", f("email", "users")))))}).sensitive


def test_null_logic(service):
    assert rows(service, table="nulls", fields=plain("nulls", "k"), where=op("NOT IN", f("v"), ["7", None])) == []
    assert rows(service, table="nulls", fields=items(k=f("k", "nulls"), a=op("=", f("v"), 7), b=op("/", 1, f("x")), c=op("%", f("k"), 0)), order_by=[{"element": f("k", "nulls")}]) == [(1, True, 1 / 1.5, None), (2, None, None, None), (3, None, None, None)]
    assert rows(service, table="nulls", fields=items(a=fn("GROUP_CONCAT", f("v", "nulls")), b=fn("COUNT", f("v")), c=fn("COUNT", f("*")))) == [("7,x", 2, 3)]
    assert rows(service, table="nulls", fields=plain("nulls", "v"), order_by=[{"element": f("v", "nulls")}])[0] == (None,)
    assert rows(service, table="nulls", fields=items(a=case((op(">", f("k"), 2), "b"), otherwise=None)), order_by=[{"expression": f("k", "nulls")}]) == [(None,), (None,), ("b",)]


def test_text_keeps_its_zeros_and_meets_numbers(service):
    assert rows(service, table="nulls", fields=plain("nulls", "k"), where=op("=", f("v"), "07")) == []
    assert rows(service, table="nulls", fields=plain("nulls", "k"), where=op("=", f("k"), "03")) == [(3,)]
    assert rows(service, table="nulls", fields=plain("nulls", "k"), where=op("IN", f("k"), "1", "2.0")) == [(1,), (2,)]


def test_self_edge_correlation_and_derived(service):
    assert rows(service, table="users", fields=[{"element": f("id", "users")}, {"element": f("id", "users", "boss"), "alias": "boss"}], order_by=[{"element": f("id", "users")}]) == [(1, None), (2, 1), (3, 1)]
    assert rows(service, table="users", fields=plain("users", "id"), where=op("NOT EXISTS", sub(table="logs", fields=items(one=1), where=op("=", f("user_id", "logs"), f("id", "users"))))) == [(2,)]
    assert rows(service, table="users", tablealias="u", fields=plain("users", "id"), where=op("=", f("id", "users"), 2)) == [(2,)]
    assert sorted(rows(service, table="users", fields=[{"element": f("id", "users")}, {"element": f("what", "logs", variant="optional")}]), key=str) == [(1, "in"), (1, "out"), (2, None), (3, None)]


BAD = [
    (dict(table="users", fields=items(x={"type": "hologram"})), "Unsupported element type: hologram"),
    (dict(table="users", fields=items(x={"type": "fn"})), "Function must have 'function' and 'params'."),
    (dict(table="users", fields=items(x=op("IN", 1))), "IN expects at least 2 parameters."),
    (dict(table="users", fields=items(x=op("~~", 1, 2))), "Unsupported operator: ~~"),
    (dict(table="users", fields=items(x=[])), "Invalid array element structure: []"),
    (dict(table="users", fields=items(x={"type": "case", "cases": [{"when": 0}]})), "CASE entry missing 'when'."),
    (dict(table="users", fields=items(x=fn("CAST", 1))), "CAST expects 2 parameters: value and type string."),
    (dict(table="users", fields=items(x=fn("GROUP_CONCAT", f("id"), 1))), "GROUP_CONCAT separator must be a string literal."),
    (dict(table="logs", fields=plain("users", "id")), "No join path from 'logs' to 'users'"),
    (dict(fields=items(x=1)), "Query must contain 'table' or at least one field reference with 'table'."),
    (dict(table="users", fields=[*plain("users", "id"), *plain("users", "id")]), "Result columns must have different names: id"),
    (dict(table="nowhere", fields=items(x=1)), "Table 'nowhere' does not exist."),
    (dict(table="users", fields=items(a=f("id", "users"), n=fn("COUNT", f("*")))), "Field 'id' is neither grouped nor inside an aggregate."),
]


@pytest.mark.parametrize(("query", "message"), BAD)
def test_compile_errors(service, query, message):
    with pytest.raises(CompileError) as e:
        service.execute({"type": "select", **query})
    assert str(e.value) == message


def test_window_distinct_is_refused(service):
    with pytest.raises(ValidationError):
        service.execute({"type": "select", "table": "users", "fields": items(x={**win("SUM", f("id")), "distinct": True})})


def test_failures_become_results(service):
    r = service.execute({"type": "select", "table": "users", "fields": items(x=fn("NO_SUCH_FUNCTION", 1))})
    assert r.error and ERROR_MARK in r.debug and r.rows() == []


KV = {"type": "create", "table": "kv", "columns": [{"name": "id", "type": "int", "primary_key": True, "auto_increment": True}, {"name": "name", "type": "varchar(9)", "nullable": False}, {"name": "on_", "type": "bool", "default": True}]}


def table(service, name="kv"):
    return sorted(map(tuple, service.store.find(name).collect()), key=str)


def test_writes(service):
    go = service.execute
    go(KV)
    r = go({"type": "insert", "table": "kv", "values": [{"name": "a"}, {"name": "O'x"}]})
    assert (r.affected_rows, r.insert_id) == (2, 1) and table(service) == [(1, "a", True), (2, "O'x", True)]
    assert "cannot be null" in go({"type": "insert", "table": "kv", "values": [{"name": None}]}).error
    assert "Duplicate entry" in go({"type": "insert", "table": "kv", "values": [{"id": 2, "name": "z"}]}).error
    assert go({"type": "insert", "table": "kv", "ignore": True, "values": [{"id": 2, "name": "z"}, {"id": 9, "name": "n"}, {"id": 9, "name": "m"}]}).affected_rows == 1
    r = go({"type": "insert", "table": "kv", "values": [{"id": 9, "name": "q"}, {"id": 10, "name": "r"}], "on_duplicate": {"name": fn("CONCAT", f("name"), "!")}})
    assert r.affected_rows == 3 and table(service)[:2] == [(1, "a", True), (10, "r", True)] and (9, "n!", True) in table(service)
    assert go({"type": "insert", "table": "kv", "values": [{"name": "next"}]}).insert_id == 11
    assert go({"type": "update", "table": "kv", "set": {"on_": False}, "where": op(">", f("id"), 8), "limit": 2}).affected_rows == 2
    assert go({"type": "delete", "table": "kv", "where": op("=", f("on_"), False), "order_by": [{"element": f("id"), "direction": "DESC"}], "limit": 1}).affected_rows == 1
    assert len(table(service)) == 4
    assert "Unknown column" in go({"type": "update", "table": "kv", "set": {"zz": 1}}).error
    go({"type": "alter", "table": "kv", "actions": [{"action": "add_column", "name": "t", "type": "int", "nullable": False}, {"action": "rename_column", "from": "on_", "to": "active"}, {"action": "add_unique_index", "name": "u", "columns": ["name"]}]})
    assert service.store.find("kv").columns == ["id", "name", "active", "t"] and {r[3] for r in table(service)} == {0}
    assert "Duplicate entry" in go({"type": "insert", "table": "kv", "values": [{"name": "a", "t": 1}]}).error
    go({"type": "truncate", "table": "kv"})
    assert table(service) == [] and go({"type": "rename", "tables": {"from": "kv", "to": "k2"}}).error is None
    go({"type": "drop", "table": "k2"})
    assert service.store.names() == [] and service.store.vacuum() > 0


def test_concurrent_writers(service):
    """Two writers on one version: different tables are joined, the same table is written again on top."""
    other = QueryService(service.spark, service.catalog, service.sources, Store(service.spark, service.store.root), strict=True)
    for name in ("kv", "k2"):
        service.execute({**KV, "table": name})
    with service.store.transaction():
        service.execute({"type": "insert", "table": "kv", "values": [{"name": "a"}]})
        other.execute({"type": "insert", "table": "k2", "values": [{"name": "b"}]})
    assert [r[1] for r in table(service)] == ["a"] and [r[1] for r in table(service, "k2")] == ["b"]
    with pytest.raises(Conflict):
        with service.store.transaction():
            service.execute({"type": "insert", "table": "kv", "values": [{"name": "c"}]})
            other.execute({"type": "insert", "table": "kv", "values": [{"name": "d"}]})
    assert [r[1] for r in table(service)] == ["a", "d"] and service.store.vacuum() == 0


def test_transactions_are_atomic(service):
    service.execute(KV)
    add = {"type": "insert", "table": "kv", "values": [{"name": "a"}]}
    with pytest.raises(ExecutionError, match="Duplicate"):
        service.execute({"type": "transaction", "queries": [add, {"type": "insert", "table": "kv", "values": [{"id": 1, "name": "b"}]}]})
    assert table(service) == []
    r = service.execute({"type": "transaction", "queries": [add, add, {"type": "select", "table": "kv", "fields": items(n=fn("COUNT", f("*")))}]})
    assert (r.affected_rows, r.insert_id, r.rows()) == (2, 2, [{"n": 2}])


def test_exporters(service, tmp_path):
    q = {"type": "select", "table": "users", "fields": items(name=f("email", "users"), n=f("id", "users"), flag=op("=", f("id", "users"), 1)), "order_by": [{"element": f("id", "users")}]}
    out = export.exporter("csv", service).set_query(q)
    assert out.to_string() == "name,n,flag\na@x,1,1\nb@x,2,\n,3,\n"
    out.to_file(str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").read_text() == out.to_string() and out.to_sql().startswith("{")
    assert [c["name"] for c in json.loads(export.exporter("jsonreportexporter", service).set_query(q).to_string())["columns"]] == ["name", "n", "flag"]
    for name, mime in (("htmltable", "text/html"), ("htmlpage", "text/html"), ("excelhtml", "application/vnd.ms-excel"), ("datatable", "text/html"), ("barchart", "text/html"), ("piechart", "text/html")):
        x = export.exporter(name, service).set_result(service.execute(q))
        assert x.mime == mime and "a@x" in x.to_string()
    with pytest.raises(RuntimeError, match="No query result set for export."):
        export.exporter("csv").to_string()
    with pytest.raises(RuntimeError, match="could not be instantiated"):
        export.exporter("fax")
    evil = service.execute({"type": "select", "table": "users", "fields": items(a="<script>'&", b=1), "limit": 1})
    for name in export.EXPORTERS:
        if "html" in export.exporter(name).mime:
            assert "<script>'&" not in export.exporter(name).set_result(evil).to_string()


def test_types_and_patterns():
    assert [column_type(t).simpleString() for t in ("int", "INT UNSIGNED", "decimal", "decimal(9,1)", "tinyint(1)", "varchar(50)", "datetime", "json")] == ["int", "bigint", "decimal(14,4)", "decimal(9,1)", "boolean", "string", "timestamp_ntz", "string"]
    assert date_pattern("%d.%m.%Y at %H:%i") == "dd.MM.yyyy 'a''t' HH:mm"
    with pytest.raises(CompileError):
        date_pattern("%Q")


def test_functions_by_name(service):
    calls = {
        "a": fn("UNHEX", "414243"), "b": fn("CONCAT", "x", 1, 2.5), "c": fn("SUBSTRING_INDEX", "a.b.c", ".", 2), "d": fn("FIND_IN_SET", "b", "a,b"),
        "e": fn("LOCATE", "b", "abc"), "g": fn("IF", op(">", 2, 1), "y", "n"), "h": fn("FORMAT", 12345.678, 2), "i": fn("HEX", 255), "j": fn("SHA1", "x"),
        "k": fn("ELT", 2, "a", "b"), "l": fn("LENGTH", "é"), "m": fn("CHAR_LENGTH", "é"), "n": fn("TRUNCATE", -1.999, 2), "o": fn("GREATEST", 1, None),
        "p": fn("JSON_OBJECT", "a", 1, "b", None), "q": fn("JSON_LENGTH", "[1,2]"), "r": fn("DATE_FORMAT", fn("STR_TO_DATE", "05.06.2024", "%d.%m.%Y"), "%Y/%m/%d"),
        "s": fn("TIMESTAMPDIFF", "HOUR", fn("CAST", "2024-01-01 00:00:00", "DATETIME"), fn("CAST", "2024-01-02 03:00:00", "DATETIME")), "t": fn("DATE_FORMAT", fn("DATE_SUB", fn("CAST", "2024-03-01", "DATE"), 1, "DAY"), "%e %M"),
        "u": fn("WEEK", fn("CAST", "2024-01-01", "DATE"), 3), "v": fn("CAST", "12abc", "SIGNED"), "w": fn("CAST", "3.7", "DECIMAL(4,1)"), "x": fn("LOG", 1), "y": fn("JSON_UNQUOTE", '"q"'), "z": fn("LAST_INSERT_ID"),
    }
    got = service.execute({"type": "select", "table": "nulls", "fields": items(**calls), "limit": 1}).rows()[0]
    assert {k: (bytes(v) if isinstance(v, bytearray) else float(v) if k == "w" else v) for k, v in got.items()} == {
        "a": b"ABC", "b": "x12.5", "c": "a.b", "d": 2, "e": 2, "g": "y", "h": "12,345.68", "i": "FF", "j": "11f6ad8ec52a2984abaafd7c3b516503785c2072",
        "k": "b", "l": 2, "m": 1, "n": -1.99, "o": None, "p": '{"a":1,"b":null}', "q": 2, "r": "2024/06/05", "s": 27, "t": "29 February",
        "u": 1, "v": None, "w": 3.7, "x": 0.0, "y": "q", "z": got["z"],
    }
    service.execute(KV)
    service.execute({"type": "insert", "table": "kv", "values": [{"name": fn("UPPER", "n")}, {"name": "m", "on_": op("=", 1, 2)}]})
    assert table(service) == [(1, "N", True), (2, "m", True)]
    assert rows(service, table="nulls", fields=items(x=fn("LAST_INSERT_ID")), limit=1) == [(1,)]
    assert service.execute({"type": "update", "table": "kv", "set": {"name": fn("DATE_FORMAT", fn("NOW"), "%Y")}}).affected_rows == 2
