"""Graph, join planner and validation rules."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from queryloom.errors import CompileError, ValidationError
from queryloom.plans import joins
from queryloom.plans.graph import Graph
from queryloom.plans.joins import Node
from queryloom.plans.validate import validate
from queryloom.sources.catalog import CompositeCatalog, FileCatalog, StaticCatalog, categories, domains, schema_endpoint, table_from, tags


def graph(*edges):
    g = Graph()
    for a, b, *rest in edges:
        g.add_edge(a, b, rest[0] if rest else None, bool(rest[1:]))
    return g


def test_paths_and_cycles():
    g = graph("AB", "BD", "AC", "CD", "BA")
    assert [[e.target for e in p] for p in g.all_paths("A", "D")] == [["B", "D"], ["C", "D"]]
    assert g.all_paths("A", "A") == [[]]
    with pytest.raises(LookupError, match="End node 'X' does not exist."):
        g.all_paths("A", "X")


def test_default_edge():
    g = graph(("A", "B", 1), ("A", "B", 2, True))
    assert g.default_edge("A", "B").label == 2
    assert g.default_edge("B", "A") is None and len(g.edges_to("A", "B")) == 2


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_shortest_path_is_the_least_simple_path(seed):
    r = random.Random(seed)
    names = ["a", "b", "bb", "c", "ca", "d"]
    g = Graph()
    for n in names:
        g.add_node(n)
    for _ in range(r.randint(0, 12)):
        g.add_edge(*r.sample(names, 2))
    text = lambda p: "|".join(f"{e.source}>{e.target}" for e in p)
    every = g.all_paths("a", "d")
    path = g.shortest_path("a", "d")
    if not every:
        assert path is None
    else:
        assert text(path) == text(min(every, key=lambda p: (len(p), text(p))))


def catalogue(*tables):
    return StaticCatalog(table_from(t) for t in tables)


def one(name, **joins_):
    return {"name": name, "joins": [{"targetTable": t, "on": on, "type": kind} for t, (on, kind) in joins_.items()]}


def test_left_and_optional():
    c = catalogue(one("users", orders=({"users.id": "orders.user_id"}, "LEFT"), profiles=({"users.id": "profiles.user_id"}, "INNER")), one("orders"), one("profiles"))
    g = joins.graph_of(c)
    steps = joins.plan(g, Node("users", "users"), {Node("orders", "orders"): False, Node("profiles", "profiles"): True})
    assert [(s.node.alias, s.how, s.on) for s in steps] == [("orders", "left", (("id", "user_id"),)), ("profiles", "left", (("id", "user_id"),))]
    assert joins.plan(g, Node("users", "users"), {Node("profiles", "profiles"): False})[0].how == "inner"
    with pytest.raises(CompileError, match="No join path from 'orders' to 'users'"):
        joins.plan(g, Node("orders", "orders"), {Node("users", "users"): False})


def test_optional_only_if_every_request_is():
    c = catalogue(one("a", b=({"a.x": "b.x"}, "INNER")), one("b", c=({"b.y": "c.y"}, "INNER"), d=({"b.z": "d.z"}, "INNER")), one("c"), one("d"))
    steps = joins.plan(joins.graph_of(c), Node("a", "a"), {Node("c", "c"): True, Node("d", "d"): False})
    assert {s.node.alias: s.how for s in steps} == {"b": "inner", "c": "left", "d": "inner"}


def test_self_join_only_forwards_over_a_bridge():
    alloc = {"name": "alloc", "joins": [{"targetTable": "entry", "on": {"alloc.entry_id": "entry.id"}, "type": "INNER"}, {"targetTable": "entry", "on": {"alloc.peer_id": "entry.id"}, "type": "INNER"}]}
    g = joins.graph_of(catalogue(one("entry", alloc=({"entry.id": "alloc.entry_id"}, "INNER")), alloc))
    steps = joins.plan(g, Node("entry", "entry"), {Node("alloc", "alloc"): False, Node("entry", "peer"): False})
    assert [(s.left, s.node.alias, s.on) for s in steps] == [("entry", "alloc", (("id", "entry_id"),)), ("alloc", "peer", (("peer_id", "id"),))]
    with pytest.raises(CompileError, match="No self join path"):
        joins.plan(g, Node("entry", "entry"), {Node("entry", "peer"): False})


BAD = [
    ({}, "Unsupported query type: [not defined]"),
    ({"type": "explode"}, "Unsupported query type: explode"),
    ({"type": "select"}, "SELECT query must contain a non-empty 'fields' array."),
    ({"type": "select", "fields": [{"element": 1}], "order_by": [{}]}, "Missing element in order_by clause."),
    ({"type": "select", "fields": [{"element": 1}], "order_by": [{"element": 1, "direction": "up"}]}, "Invalid order direction: up"),
    ({"type": "select", "union": {"queries": [1]}}, "UNION must contain a 'queries' array with at least two SELECTs."),
    ({"type": "insert"}, "INSERT query must contain a valid 'table' name."),
    ({"type": "insert", "table": "t"}, "INSERT query must contain either 'values' or 'from'."),
    ({"type": "insert", "table": "t", "values": [{"a": 1}], "from": {}}, "INSERT query cannot contain both 'values' and 'from'."),
    ({"type": "insert", "table": "t", "values": [1]}, "Each entry in 'values' must be an object (row). Entry at index 0 is invalid."),
    ({"type": "insert", "table": "t", "values": [{"a": 1}], "limit": 1}, "INSERT query must not contain 'limit' at the top level."),
    ({"type": "update", "table": "t", "set": {}}, "UPDATE query must contain a non-empty 'set' object."),
    ({"type": "update", "table": "t", "set": {"a": {"x": 1}}}, "Invalid 'set' value for 'a': missing 'type' in expression."),
    ({"type": "delete", "table": "t"}, "DELETE query must contain a 'where' clause to avoid full deletions."),
    ({"type": "delete", "table": "t", "where": {"type": "op"}, "limit": "3"}, "LIMIT must be an integer."),
    ({"type": "truncate", "table": "t", "where": {}}, "TRUNCATE query must not contain 'where'."),
    ({"type": "drop"}, "DROP query must define a valid 'table'."),
    ({"type": "rename", "tables": {"from": "a"}}, "RENAME query requires a valid 'to' table name."),
    ({"type": "create", "table": "t", "columns": [{"name": "a"}]}, "Column 'a' is missing a valid 'type'."),
    ({"type": "create", "table": "t", "columns": [{"name": "a", "type": "int", "nullable": 1}]}, "Column 'a': 'nullable' must be boolean."),
    ({"type": "alter", "table": "t", "actions": [{"action": "add_column", "name": "a"}]}, "Action #0 (ADD_COLUMN) requires 'name' and 'type'."),
    ({"type": "alter", "table": "t", "actions": [{"action": "fly"}]}, "Unsupported ALTER action: 'fly' in action #0."),
]


@pytest.mark.parametrize(("query", "message"), BAD)
def test_rules(query, message):
    with pytest.raises(ValidationError) as e:
        validate(query)
    assert str(e.value) == message


def test_file_catalogue(tmp_path):
    (tmp_path / "usage.json").write_text('{"name": "usage", "domain": "ai", "category": "core", "tags": ["x", ""], "fields": [{"name": "id", "type": "integer", "required": true, "primaryKey": true}, {"name": "tokens", "nullable": true, "tags": ["y"]}], "joins": [{"targetTable": "t", "on": {"usage.id": "t.id"}}]}')
    c = FileCatalog(tmp_path)
    t = c.table("usage")
    assert [f.nullable for f in t.fields] == [False, True] and t.primary_key == ("id",) and t.joins[0].type == "LEFT"
    assert domains(c) == ["ai"] and categories(c) == ["core"] and tags(c) == ["x", "y"]
    assert schema_endpoint(c, "tags") == ["x", "y"] and schema_endpoint(c)[0]["name"] == "usage"
    assert FileCatalog(tmp_path / "none").tables() == []
    both = CompositeCatalog({"a": StaticCatalog(), "b": c}, "a")
    assert both.table("b:usage") == both.table("b.usage") == both.table("usage") == t and both.table("c:usage") is None
    for bad in ("{", "{}", '{"name": "x", "fields": [{}]}', '{"name": "x", "fields": [{"name": "a", "foreignKey": "b.c"}]}', '{"name": "x", "joins": [{"targetTable": "y", "on": {}}]}'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(RuntimeError):
            FileCatalog(tmp_path).tables()
