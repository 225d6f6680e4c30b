"""The relationship graph of the benchmark tables."""

from __future__ import annotations

from queryloom.sources.catalog import StaticCatalog, table_from

_FIELDS = {
    "region": ("r_regionkey:integer:pk", "r_name"),
    "nation": ("n_nationkey:integer:pk", "n_name", "n_regionkey:integer"),
    "customer": ("c_custkey:bigint:pk", "c_name:string:sensitive", "c_nationkey:integer", "c_acctbal:double:sensitive", "c_mktsegment"),
    "supplier": ("s_suppkey:bigint:pk", "s_name", "s_nationkey:integer", "s_acctbal:double"),
    "part": ("p_partkey:bigint:pk", "p_name", "p_brand", "p_type", "p_size:integer", "p_retailprice:double"),
    "orders": ("o_orderkey:bigint:pk", "o_custkey:bigint", "o_orderstatus", "o_totalprice:double", "o_orderdate:datetime", "o_orderpriority"),
    "lineitem": ("l_orderkey:bigint", "l_partkey:bigint", "l_suppkey:bigint", "l_linenumber:integer", "l_quantity:double", "l_extendedprice:double", "l_discount:double", "l_tax:double", "l_returnflag", "l_linestatus", "l_shipdate:datetime"),
    "events": ("event_id:bigint:pk", "ts:datetime", "user_id:bigint", "event_type", "value:double", "props:json"),
    "documents": ("doc_id:bigint:pk", "text", "lang", "source", "n_chars:bigint"),
    "labels": ("doc_id:bigint:pk", "quality:integer", "toxic:integer"),
}
_JOINS = {
    "lineitem": (("orders", "l_orderkey", "o_orderkey", "INNER"), ("part", "l_partkey", "p_partkey", "INNER"), ("supplier", "l_suppkey", "s_suppkey", "INNER")),
    "orders": (("customer", "o_custkey", "c_custkey", "INNER"), ("lineitem", "o_orderkey", "l_orderkey", "LEFT")),
    "customer": (("nation", "c_nationkey", "n_nationkey", "INNER"), ("orders", "c_custkey", "o_custkey", "LEFT")),
    "supplier": (("nation", "s_nationkey", "n_nationkey", "INNER"),),
    "nation": (("region", "n_regionkey", "r_regionkey", "INNER"), ("customer", "n_nationkey", "c_nationkey", "LEFT"), ("supplier", "n_nationkey", "s_nationkey", "LEFT")),
    "region": (("nation", "r_regionkey", "n_regionkey", "LEFT"),),
    "events": (("customer", "user_id", "c_custkey", "LEFT"),),
    "documents": (("labels", "doc_id", "doc_id", "LEFT"),),
    "labels": (("documents", "doc_id", "doc_id", "LEFT"),),
}
_DOMAIN = {"documents": "corpus", "labels": "corpus", "events": "activity"}


def _field(text: str) -> dict:
    name, *rest = text.split(":")
    return {"name": name, "type": rest[0] if rest else "string", "primaryKey": "pk" in rest, "sensitive": "sensitive" in rest}


def catalog() -> StaticCatalog:
    return StaticCatalog(
        table_from({"name": t, "domain": _DOMAIN.get(t, "sales"), "fields": [_field(f) for f in fields], "joins": [{"targetTable": to, "on": {f"{t}.{a}": f"{to}.{b}"}, "type": kind} for to, a, b, kind in _JOINS.get(t, ())]})
        for t, fields in _FIELDS.items()
    )
