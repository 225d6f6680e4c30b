"""Rules of the statement types. The messages are part of the interface."""

from __future__ import annotations

from typing import Any

from queryloom.errors import ValidationError

FORBIDDEN = ("where", "fields", "limit", "order_by", "group_by", "having")


def _need(ok: Any, message: str) -> None:
    if not ok:
        raise ValidationError(message)


def _name(x: Any) -> bool:
    return isinstance(x, str) and x.strip() != ""


def _forbid(q: dict, kind: str, keys: tuple[str, ...], tail: str = "") -> None:
    for key in keys:
        _need(key not in q, f"{kind} query must not contain '{key}'{tail}.")


def _orders(entries: list) -> None:
    for o in entries:
        _need(isinstance(o, dict) and ("element" in o or "expression" in o), "Missing element in order_by clause.")
        direction = o.get("direction", "ASC")
        _need(str(direction).upper() in ("ASC", "DESC"), f"Invalid order direction: {direction}")


def select(q: dict) -> None:
    _need(q.get("type") == "select", f"Unsupported query type: {q.get('type') or '[not defined]'}")
    if "union" in q:
        parts = (q["union"] or {}).get("queries")
        _need(isinstance(parts, list) and len(parts) >= 2, "UNION must contain a 'queries' array with at least two SELECTs.")
        for i, part in enumerate(parts):
            _need(isinstance(part, dict) and part.get("type") == "select", f"UNION subquery #{i} must be a valid SELECT query.")
            _need("union" in part or (isinstance(part.get("fields"), list) and part["fields"]), f"UNION subquery #{i} must contain a non-empty 'fields' array.")
            select(part)
    else:
        _need(isinstance(q.get("fields"), list) and q["fields"], "SELECT query must contain a non-empty 'fields' array.")
        for f in q["fields"]:
            _need(isinstance(f, dict) and "element" in f, "Missing element in fields entry.")
    _orders(q.get("order_by") or [])


def insert(q: dict) -> None:
    _need(q.get("type") == "insert", f"Unsupported query type: {q.get('type') or '[not defined]'}")
    _need(_name(q.get("table")), "INSERT query must contain a valid 'table' name.")
    values, source = "values" in q, "from" in q
    _need(values or source, "INSERT query must contain either 'values' or 'from'.")
    _need(not (values and source), "INSERT query cannot contain both 'values' and 'from'.")
    if values:
        _need(isinstance(q["values"], list) and q["values"], "'values' must be a non-empty array.")
        for i, row in enumerate(q["values"]):
            _need(isinstance(row, dict), f"Each entry in 'values' must be an object (row). Entry at index {i} is invalid.")
            _need(all(isinstance(k, str) for k in row), f"Each row must have named columns. Found invalid key in row {i}.")
    else:
        _need(isinstance(q["from"], dict) and q["from"].get("type") == "select", "'from' must be a valid SELECT query structure.")
    if "columns" in q:
        _need(isinstance(q["columns"], list) and q["columns"], "'columns' must be a non-empty array of strings.")
        _need(all(_name(c) for c in q["columns"]), "Each entry in 'columns' must be a non-empty string.")
    _forbid(q, "INSERT", ("fields", "where", "group_by", "order_by", "having", "limit"), " at the top level")


def update(q: dict) -> None:
    _need(q.get("type") == "update", f"Unsupported query type: {q.get('type') or '[not defined]'}")
    _need(_name(q.get("table")), "UPDATE query must contain a valid 'table' name.")
    _need(isinstance(q.get("set"), dict) and q["set"], "UPDATE query must contain a non-empty 'set' object.")
    for key, value in q["set"].items():
        _need(_name(key), "Each 'set' key must be a non-empty string.")
        _need(not isinstance(value, (dict, list)) or (isinstance(value, dict) and "type" in value), f"Invalid 'set' value for '{key}': missing 'type' in expression.")
    _need("where" not in q or isinstance(q["where"], dict), "'where' must be a valid expression object.")
    _forbid(q, "UPDATE", ("fields", "values", "group_by", "having"))


def delete(q: dict) -> None:
    _need(q.get("type") == "delete", f"Unsupported query type: {q.get('type') or '[not defined]'}")
    _need(_name(q.get("table")), "DELETE query must define a valid 'table'.")
    _need(isinstance(q.get("where"), dict) and q["where"], "DELETE query must contain a 'where' clause to avoid full deletions.")
    _orders(q.get("order_by") or [])
    _need("limit" not in q or (isinstance(q["limit"], int) and not isinstance(q["limit"], bool)), "LIMIT must be an integer.")


def truncate(q: dict) -> None:
    _need(_name(q.get("table")), "TRUNCATE query must define a valid 'table'.")
    _forbid(q, "TRUNCATE", FORBIDDEN)


def drop(q: dict) -> None:
    _need(_name(q.get("table")), "DROP query must define a valid 'table'.")
    _forbid(q, "DROP", FORBIDDEN)


def rename(q: dict) -> None:
    _need(isinstance(q.get("tables"), dict), "RENAME query must contain a 'tables' object with 'from' and 'to'.")
    _need(_name(q["tables"].get("from")), "RENAME query requires a valid 'from' table name.")
    _need(_name(q["tables"].get("to")), "RENAME query requires a valid 'to' table name.")
    _forbid(q, "RENAME", FORBIDDEN)


def create(q: dict) -> None:
    _need(_name(q.get("table")), "CREATE query must define a non-empty 'table' name.")
    _need(isinstance(q.get("columns"), list) and q["columns"], "CREATE query must contain a non-empty 'columns' array.")
    for i, c in enumerate(q["columns"]):
        _need(isinstance(c, dict), "Each column entry must be an object.")
        _need(_name(c.get("name")), f"Column at index {i} is missing a valid 'name'.")
        _need(_name(c.get("type")), f"Column '{c['name']}' is missing a valid 'type'.")
        for flag in ("nullable", "auto_increment", "primary_key"):
            _need(flag not in c or isinstance(c[flag], bool), f"Column '{c['name']}': '{flag}' must be boolean.")
        _need(not isinstance(c.get("default"), (dict, list)), f"Column '{c['name']}': 'default' must be a scalar value.")
    _forbid(q, "CREATE", FORBIDDEN)


ALTER_NEEDS = {
    "ADD_INDEX": ("name", "columns"),
    "ADD_UNIQUE_INDEX": ("name", "columns"),
    "DROP_INDEX": ("name",),
    "ADD_COLUMN": ("name", "type"),
    "DROP_COLUMN": ("name",),
    "MODIFY_COLUMN": ("name", "type"),
    "RENAME_COLUMN": ("from", "to"),
    "CHANGE_COLUMN": ("from", "to", "type"),
}
ALTER_SAYS = {
    ("name",): "'name'",
    ("name", "columns"): "'name' and non-empty 'columns'",
    ("name", "type"): "'name' and 'type'",
    ("from", "to"): "'from' and 'to'",
    ("from", "to", "type"): "'from', 'to', and 'type'",
}


def alter(q: dict) -> None:
    _need(_name(q.get("table")), "ALTER query must include a 'table' name.")
    _need(isinstance(q.get("actions"), list) and q["actions"], "ALTER query must include a non-empty 'actions' array.")
    for i, a in enumerate(q["actions"]):
        _need(isinstance(a, dict) and a.get("action"), f"Action #{i} must contain an 'action' field.")
        act = str(a["action"]).upper()
        _need(act in ALTER_NEEDS, f"Unsupported ALTER action: '{a['action']}' in action #{i}.")
        needs = ALTER_NEEDS[act]
        _need(all(a.get(k) for k in needs), f"Action #{i} ({act}) requires {ALTER_SAYS[needs]}.")


VALIDATORS = {f.__name__: f for f in (select, insert, update, delete, truncate, drop, rename, create, alter)}


def validate(q: dict) -> None:
    kind = q.get("type") if isinstance(q, dict) else None
    if kind not in VALIDATORS:
        raise ValidationError(f"Unsupported query type: {kind or '[not defined]'}")
    VALIDATORS[kind](q)
