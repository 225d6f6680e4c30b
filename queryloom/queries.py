"""Registered queries: a document for each operator, and SQL with the same result.

Sums of money are taken as decimals on both sides, so that they do not depend on the
order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from queryloom.fixtures import catalog
from queryloom.materialize.builder import Materializer
from queryloom.materialize.manifest import Manifests, from_dict
from queryloom.materialize.planner import Planner, State
from queryloom.materialize.registry import Registry, Resolver
from queryloom.service import QueryService
from queryloom.sources.catalog import CompositeCatalog, StaticCatalog, table_from
from queryloom.sources.store import Store
from queryloom.sources.tables import Frames, ParquetFolder, Sources
from queryloom.workspace import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def f(name: str, table: str | None = None, alias: str | None = None, variant: str | None = None) -> dict:
    return {"type": "fld", "field": name} | ({"table": table} if table else {}) | ({"tablealias": alias} if alias else {}) | ({"variant": variant} if variant else {})


def fn(name: str, *params: Any, distinct: bool = False) -> dict:
    return {"type": "fn", "function": name, "params": list(params)} | ({"distinct": True} if distinct else {})


def op(operator: str, *params: Any) -> dict:
    return {"type": "op", "operator": operator, "params": list(params)}


def win(name: str, *params: Any, by: list | None = None, order: list | None = None) -> dict:
    return {"type": "windowfn", "function": name, "params": list(params), "over": {"partition_by": by or [], "order_by": [{"expression": e, "direction": d} for e, d in order or ()]}}


def sub(**query: Any) -> dict:
    return {"type": "subquery", "query": {"type": "select", **query}}


def case(*cases: tuple, otherwise: Any = None) -> dict:
    return {"type": "case", "cases": [{"when": w, "then": t} for w, t in cases], "else": otherwise}


def items(**columns: Any) -> list[dict]:
    return [{"element": e, "alias": a} for a, e in columns.items()]


def plain(table: str, *names: str) -> list[dict]:
    return [{"element": f(n, table)} for n in names]


def by(*orders: Any) -> list[dict]:
    return [{"element": o[0], "direction": o[1]} if isinstance(o, tuple) else {"element": o} for o in orders]


def money(e: Any) -> dict:
    return fn("CAST", fn("SUM", fn("CAST", e, "DECIMAL(18,2)")), "DOUBLE")


MONEY = "CAST(SUM(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
STAR = f("*")
COUNT = fn("COUNT", STAR)

#: name: (document, SQL)
SELECTS: dict[str, tuple[dict, str]] = {
    "revenue_by_region_priority": (
        {"table": "orders", "fields": [{"element": f("r_name", "region")}, {"element": f("o_orderpriority", "orders")}, *items(n_orders=COUNT, revenue=money(f("o_totalprice", "orders")))], "group_by": [f("r_name", "region"), f("o_orderpriority", "orders")], "order_by": by(f("r_name", "region"), f("o_orderpriority", "orders"))},
        f"SELECT r_name, o_orderpriority, COUNT(*) AS n_orders, {MONEY.format('o_totalprice')} AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, o_orderpriority",
    ),
    "scan_project_filter": (
        {"table": "lineitem", "fields": plain("lineitem", "l_orderkey", "l_partkey", "l_quantity"), "where": op("AND", op(">", f("l_quantity"), 45), op("=", f("l_returnflag"), "R"))},
        "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'",
    ),
    "wildcard": ({"table": "nation", "fields": [{"element": f("*", "nation")}, {"element": f("r_name", "region")}]}, "SELECT nation.*, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "from_derived": (
        {"from": {"query": {"table": "orders", "fields": [{"element": f("o_custkey", "orders")}, *items(n=COUNT)], "group_by": [f("o_custkey", "orders")]}}, "tablealias": "d", "fields": items(n=f("n", "d"), customers=COUNT), "group_by": [f("n", "d")]},
        "SELECT n, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) d GROUP BY n",
    ),
    "case_when": (
        {"table": "part", "fields": [{"element": f("p_partkey", "part")}, *items(size_class=case((op("<", f("p_size"), 10), "small"), (op("<", f("p_size"), 30), "medium"), otherwise="large"), odd=case((op("=", op("%", f("p_size"), 2), 1), 1)))]},
        "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, CASE WHEN p_size % 2 = 1 THEN 1 END AS odd FROM part",
    ),
    "in_list": ({"table": "orders", "fields": plain("orders", "o_orderkey", "o_orderpriority"), "where": op("IN", f("o_orderpriority"), ["1-URGENT", "2-HIGH"])}, "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "not_in_list": ({"table": "customer", "fields": plain("customer", "c_custkey"), "where": op("NOT IN", f("c_mktsegment"), "BUILDING", "MACHINERY")}, "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    "numeric_text_literal": ({"table": "part", "fields": plain("part", "p_partkey"), "where": op("=", f("p_size"), "7")}, "SELECT p_partkey FROM part WHERE p_size = 7"),
    "row_value_in": (
        {"table": "nation", "fields": plain("nation", "n_name"), "where": op("=", [f("n_nationkey", "nation"), f("n_regionkey", "nation")], [fn("CAST", 1, "INT"), fn("CAST", 1, "INT")])},
        "SELECT n_name FROM nation WHERE n_nationkey = 1 AND n_regionkey = 1",
    ),
    "in_subquery": (
        {"table": "customer", "fields": plain("customer", "c_custkey", "c_name"), "where": op("IN", f("c_custkey"), sub(table="orders", fields=plain("orders", "o_custkey"), where=op(">", f("o_totalprice"), 400000)))},
        "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    ),
    "not_in_subquery": (
        {"table": "customer", "fields": plain("customer", "c_custkey"), "where": op("NOT IN", f("c_custkey"), sub(table="orders", fields=plain("orders", "o_custkey")))},
        "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    ),
    "between_dates": (
        {"table": "orders", "fields": plain("orders", "o_orderkey"), "where": op("BETWEEN", f("o_orderdate"), "1995-01-01", "1996-12-31")},
        "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'",
    ),
    "like_filter": (
        {"table": "part", "fields": plain("part", "p_partkey", "p_name"), "where": op("AND", op("LIKE", f("p_name"), "%a%"), op("NOT LIKE", f("p_type"), "%B%"))},
        "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE '%B%'",
    ),
    "regexp_filter": ({"table": "customer", "fields": plain("customer", "c_custkey"), "where": op("REGEXP", f("c_mktsegment"), "^(B|M)")}, "SELECT c_custkey FROM customer WHERE regexp_matches(c_mktsegment, '^(B|M)')"),
    "null_predicates": (
        {"table": "documents", "fields": [{"element": f("doc_id", "documents")}, *items(state=case((op("IS NULL", f("toxic", "labels")), "open"), otherwise="known"), same=fn("IF", op("<=>", f("toxic", "labels"), None), 1, 0))], "where": op("OR", op("IS NULL", f("toxic", "labels")), op("=", f("toxic", "labels"), 1))},
        "SELECT documents.doc_id, CASE WHEN toxic IS NULL THEN 'open' ELSE 'known' END AS state, CASE WHEN toxic IS NULL THEN 1 ELSE 0 END AS same FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id WHERE toxic IS NULL OR toxic = 1",
    ),
    "arith_ops": (
        {"table": "part", "fields": [{"element": f("p_partkey", "part")}, *items(a=op("+", f("p_size"), 1, 2), b=op("-", f("p_size"), 5), c=op("*", f("p_size"), 3), d=op("/", f("p_size"), op("-", f("p_size"), 7)), e=op("%", f("p_size"), 4), g=op("DIV", f("p_size"), 4), h=op("-", f("p_size")), i=op("&", f("p_size"), 6), j=op("|", f("p_size"), 8), k=op("<<", f("p_size"), 2))]},
        "SELECT p_partkey, p_size + 1 + 2 AS a, p_size - 5 AS b, p_size * 3 AS c, CASE WHEN p_size = 7 THEN NULL ELSE CAST(p_size AS DOUBLE) / (p_size - 7) END AS d, p_size % 4 AS e, p_size // 4 AS g, -p_size AS h, p_size & 6 AS i, p_size | 8 AS j, p_size << 2 AS k FROM part",
    ),
    "boolean_ops": (
        {"table": "customer", "fields": plain("customer", "c_custkey"), "where": op("XOR", op("=", f("c_mktsegment"), "BUILDING"), op("NOT", op("<", f("c_acctbal"), 0)))},
        "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING') <> (NOT c_acctbal < 0)",
    ),
    "string_funcs": (
        {"table": "nation", "fields": [{"element": f("n_nationkey", "nation")}, *items(a=fn("UPPER", f("n_name")), b=fn("LOWER", f("n_name")), c=fn("CONCAT", f("n_name"), "-", f("n_nationkey")), d=fn("SUBSTRING", f("n_name"), 2, 3), e=fn("LENGTH", f("n_name")), g=fn("REPLACE", f("n_name"), "A", "a"), h=fn("LPAD", f("n_name"), 12, "*"), i=fn("INSTR", f("n_name"), "A"), j=fn("REVERSE", f("n_name")), k=fn("LEFT", f("n_name"), 2), l=fn("CONCAT_WS", "/", f("n_name"), f("n_name")), m=fn("MD5", f("n_name")), o=fn("FIELD", f("n_name"), "BRAZIL", "CHINA"), p=fn("MID", f("n_name"), 0, 2), q=fn("STRCMP", f("n_name"), "FRANCE"))]},
        "SELECT n_nationkey, upper(n_name) AS a, lower(n_name) AS b, n_name || '-' || n_nationkey AS c, substring(n_name, 2, 3) AS d, strlen(n_name) AS e, replace(n_name, 'A', 'a') AS g, lpad(n_name, 12, '*') AS h, instr(n_name, 'A') AS i, reverse(n_name) AS j, left(n_name, 2) AS k, n_name || '/' || n_name AS l, md5(n_name) AS m, CASE n_name WHEN 'BRAZIL' THEN 1 WHEN 'CHINA' THEN 2 ELSE 0 END AS o, '' AS p, CASE WHEN n_name < 'FRANCE' THEN -1 WHEN n_name = 'FRANCE' THEN 0 ELSE 1 END AS q FROM nation",
    ),
    "date_funcs": (
        {"table": "orders", "fields": [{"element": f("o_orderkey", "orders")}, *items(y=fn("YEAR", f("o_orderdate")), m=fn("MONTH", f("o_orderdate")), d=fn("DAYOFMONTH", f("o_orderdate")), q=fn("QUARTER", f("o_orderdate")), ym=fn("DATE_FORMAT", f("o_orderdate"), "%Y-%m"), day_name=fn("DAYNAME", f("o_orderdate")), plus=fn("DATE_FORMAT", fn("DATE_ADD", f("o_orderdate"), 10, "DAY"), "%Y-%m-%d"), days=fn("DATEDIFF", "1999-01-01", f("o_orderdate")), months=fn("TIMESTAMPDIFF", "DAY", fn("DATE", f("o_orderdate")), fn("CAST", "1999-01-01", "DATE")))]},
        "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, strftime(o_orderdate, '%Y-%m') AS ym, dayname(o_orderdate) AS day_name, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS plus, datediff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS days, datediff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS months FROM orders",
    ),
    "math_funcs": (
        {"table": "supplier", "fields": [{"element": f("s_suppkey", "supplier")}, *items(a=fn("ABS", f("s_acctbal")), b=fn("FLOOR", f("s_acctbal")), c=fn("CEIL", f("s_acctbal")), d=fn("SIGN", f("s_acctbal")), e=fn("TRUNCATE", f("s_acctbal"), 0), g=fn("MOD", f("s_suppkey"), 7), h=fn("GREATEST", f("s_suppkey"), 50), i=fn("LEAST", f("s_suppkey"), None), j=fn("SQRT", fn("POWER", f("s_suppkey"), 2)))]},
        "SELECT s_suppkey, abs(s_acctbal) AS a, CAST(floor(s_acctbal) AS BIGINT) AS b, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(sign(s_acctbal) AS DOUBLE) AS d, trunc(s_acctbal) AS e, s_suppkey % 7 AS g, greatest(s_suppkey, 50) AS h, CAST(NULL AS BIGINT) AS i, CAST(s_suppkey AS DOUBLE) AS j FROM supplier",
    ),
    "conditional_funcs": (
        {"table": "documents", "fields": [{"element": f("doc_id", "documents")}, *items(a=fn("IFNULL", f("toxic", "labels"), -1), b=fn("NULLIF", f("lang"), "en"), c=fn("COALESCE", f("quality", "labels"), f("toxic", "labels"), 9), d=fn("ISNULL", f("toxic", "labels")))]},
        "SELECT documents.doc_id, coalesce(toxic, -1) AS a, nullif(lang, 'en') AS b, coalesce(quality, toxic, 9) AS c, CASE WHEN toxic IS NULL THEN 1 ELSE 0 END AS d FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id",
    ),
    "json_extract_events": (
        {"table": "events", "fields": [{"element": f("event_id", "events")}, *items(k=fn("CAST", fn("JSON_EXTRACT", f("props"), "$.k"), "SIGNED"), ok=fn("JSON_VALID", f("props")))]},
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN json_valid(props) THEN 1 ELSE 0 END AS ok FROM events",
    ),
    "cast_types": (
        {"table": "lineitem", "fields": [{"element": f("l_orderkey", "lineitem")}, {"element": f("l_partkey", "lineitem")}, *items(a=fn("CAST", f("l_quantity"), "SIGNED"), b=fn("CAST", f("l_orderkey"), "CHAR"), c=fn("CAST", f("l_shipdate"), "DATE"), d=fn("CAST", f("l_returnflag"), "SIGNED"), e=fn("CONVERT", f("l_returnflag"), "utf8mb4"), g=fn("CAST", f("l_orderkey"), "CHAR(2)"))]},
        "SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS a, CAST(l_orderkey AS VARCHAR) AS b, CAST(l_shipdate AS DATE) AS c, TRY_CAST(l_returnflag AS BIGINT) AS d, l_returnflag AS e, substring(CAST(l_orderkey AS VARCHAR), 1, 2) AS g FROM lineitem",
    ),
    "join_auto_one_hop": ({"table": "orders", "fields": [*plain("orders", "o_orderkey"), *plain("customer", "c_name")]}, "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_auto_multi_hop": (
        {"table": "orders", "fields": [{"element": f("n_name", "nation")}, *items(n=COUNT)], "group_by": [f("n_name", "nation")], "where": op("=", f("r_name", "region"), "ASIA")},
        "SELECT n_name, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name",
    ),
    "join_shortest_path": (
        {"table": "lineitem", "fields": [{"element": f("n_name", "nation")}, *items(qty=money(f("l_quantity", "lineitem")))], "group_by": [f("n_name", "nation")]},
        f"SELECT n_name, {MONEY.format('l_quantity')} AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    ),
    "join_optional_left": (
        {"table": "orders", "fields": [{"element": f("o_orderkey", "orders")}, {"element": f("c_name", "customer", variant="optional")}], "where": op(">", f("o_totalprice"), 100000)},
        "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000",
    ),
    "join_schema_left": (
        {"table": "region", "fields": [{"element": f("r_name", "region")}, *items(n=fn("COUNT", f("n_nationkey", "nation")))], "group_by": [f("r_name", "region")]},
        "SELECT r_name, COUNT(n_nationkey) AS n FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name",
    ),
    "join_alias_twice": (
        {"table": "lineitem", "fields": [{"element": f("l_orderkey", "lineitem")}, {"element": f("l_partkey", "lineitem")}, {"element": f("s_name", "supplier", "s1"), "alias": "first_name"}, {"element": f("s_nationkey", "supplier", "s2"), "alias": "second_nation"}]},
        "SELECT l_orderkey, l_partkey, s1.s_name AS first_name, s2.s_nationkey AS second_nation FROM lineitem JOIN supplier s1 ON l_suppkey = s1.s_suppkey JOIN supplier s2 ON l_suppkey = s2.s_suppkey",
    ),
    "agg_basic": (
        {"table": "lineitem", "fields": [{"element": f("l_returnflag", "lineitem")}, {"element": f("l_linestatus", "lineitem")}, *items(n=COUNT, qty=money(f("l_quantity")), price=money(f("l_extendedprice")), lo=fn("MIN", f("l_discount")), hi=fn("MAX", f("l_discount")), avg_qty=fn("ROUND", fn("AVG", f("l_quantity")), 6))], "where": op("<=", f("l_shipdate"), "1998-09-02"), "group_by": [f("l_returnflag", "lineitem"), f("l_linestatus", "lineitem")]},
        f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, {MONEY.format('l_quantity')} AS qty, {MONEY.format('l_extendedprice')} AS price, MIN(l_discount) AS lo, MAX(l_discount) AS hi, ROUND(AVG(l_quantity), 6) AS avg_qty FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    ),
    "agg_distinct": (
        {"table": "orders", "fields": [{"element": f("o_orderpriority", "orders")}, *items(customers=fn("COUNT", f("o_custkey"), distinct=True), keys=fn("SUM", f("o_custkey"), distinct=True))], "group_by": [f("o_orderpriority", "orders")]},
        "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS customers, CAST(SUM(DISTINCT o_custkey) AS BIGINT) AS keys FROM orders GROUP BY o_orderpriority",
    ),
    "agg_group_concat": (
        {"table": "nation", "fields": [{"element": f("r_name", "region")}, *items(names=fn("GROUP_CONCAT", f("n_name", "nation"), ", "), regions=fn("GROUP_CONCAT", f("n_regionkey", "nation"), distinct=True))], "group_by": [f("r_name", "region")]},
        "SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS names, string_agg(DISTINCT CAST(n_regionkey AS VARCHAR), ',') AS regions FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "agg_statistics": (
        {"table": "events", "fields": [{"element": f("event_type", "events")}, *items(a=fn("ROUND", fn("STDDEV", f("value")), 4), b=fn("ROUND", fn("VARIANCE", f("value")), 4), c=fn("BIT_XOR", f("event_id")), d=fn("ANY_VALUE", f("event_type")))], "group_by": [f("event_type", "events")]},
        "SELECT event_type, ROUND(stddev_pop(value), 4) AS a, ROUND(var_pop(value), 4) AS b, bit_xor(event_id) AS c, event_type AS d FROM events GROUP BY event_type",
    ),
    "having_hidden_agg": (
        {"table": "orders", "fields": [{"element": f("o_custkey", "orders")}], "group_by": [f("o_custkey", "orders")], "having": op("AND", op(">", COUNT, 10), op(">", money(f("o_totalprice")), 2000000))},
        f"SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10 AND {MONEY.format('o_totalprice')} > 2000000",
    ),
    "global_agg": ({"table": "events", "fields": items(n=COUNT, users=fn("COUNT", f("user_id"), distinct=True), first_ts=fn("MIN", f("ts")), last_ts=fn("MAX", f("ts")))}, "SELECT COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM events"),
    "group_by_expression": (
        {"table": "orders", "fields": items(y=fn("YEAR", f("o_orderdate")), total=money(f("o_totalprice"))), "group_by": [f("y")]},
        f"SELECT year(o_orderdate) AS y, {MONEY.format('o_totalprice')} AS total FROM orders GROUP BY 1",
    ),
    "group_by_primary_key": (
        {"table": "customer", "fields": [*plain("customer", "c_custkey", "c_name"), *items(n=fn("COUNT", f("o_orderkey", "orders")))], "group_by": [f("c_custkey", "customer")]},
        "SELECT c_custkey, any_value(c_name) AS c_name, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    ),
    "select_distinct": ({"table": "part", "distinct": True, "fields": plain("part", "p_brand", "p_size"), "order_by": by(f("p_brand", "part"), f("p_size", "part"))}, "SELECT DISTINCT p_brand, p_size FROM part"),
    "field_distinct": ({"table": "lineitem", "fields": [{"element": f("l_returnflag", "lineitem"), "distinct": True}, {"element": f("l_linestatus", "lineitem")}]}, "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "window_row_number": (
        {"table": "orders", "fields": [*plain("orders", "o_orderkey"), *items(rn=win("ROW_NUMBER", by=[f("o_custkey")], order=[(f("o_orderdate"), "DESC"), (f("o_orderkey"), "ASC")]))]},
        "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders",
    ),
    "window_ranks": (
        {"table": "part", "fields": [*plain("part", "p_partkey"), *items(a=win("RANK", by=[f("p_brand")], order=[(f("p_size"), "ASC")]), b=win("DENSE_RANK", by=[f("p_brand")], order=[(f("p_size"), "ASC")]), c=win("NTILE", 4, by=[f("p_brand")], order=[(f("p_partkey"), "ASC")]), d=win("PERCENT_RANK", by=[f("p_brand")], order=[(f("p_size"), "ASC")]), e=win("CUME_DIST", by=[f("p_brand")], order=[(f("p_size"), "ASC")]))]},
        "SELECT p_partkey, RANK() OVER w AS a, DENSE_RANK() OVER w AS b, NTILE(4) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS c, PERCENT_RANK() OVER w AS d, CUME_DIST() OVER w AS e FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)",
    ),
    "window_rank_over_agg": (
        {"table": "orders", "fields": [{"element": f("n_name", "nation")}, *items(total=money(f("o_totalprice", "orders")), place=win("RANK", order=[(money(f("o_totalprice", "orders")), "DESC")]))], "group_by": [f("n_name", "nation")]},
        f"SELECT n_name, {MONEY.format('o_totalprice')} AS total, RANK() OVER (ORDER BY {MONEY.format('o_totalprice')} DESC) AS place FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    ),
    "window_running_sum": (
        {"table": "orders", "fields": [*plain("orders", "o_orderkey"), *items(so_far=fn("CAST", win("SUM", fn("CAST", f("o_totalprice"), "DECIMAL(18,2)"), by=[f("o_custkey")], order=[(f("o_orderdate"), "ASC"), (f("o_orderkey"), "ASC")]), "DOUBLE"), share=win("COUNT", STAR, by=[f("o_custkey")]))]},
        "SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DOUBLE) AS so_far, COUNT(*) OVER (PARTITION BY o_custkey) AS share FROM orders",
    ),
    "window_lag_lead": (
        {"table": "events", "fields": [*plain("events", "event_id"), *items(a=win("LAG", f("event_type"), 1, by=[f("user_id")], order=[(f("ts"), "ASC"), (f("event_id"), "ASC")]), b=win("LEAD", f("event_id"), 2, by=[f("user_id")], order=[(f("ts"), "ASC"), (f("event_id"), "ASC")]), c=win("FIRST_VALUE", f("event_type"), by=[f("user_id")], order=[(f("ts"), "ASC"), (f("event_id"), "ASC")]), d=win("LAST_VALUE", f("event_id"), by=[f("user_id")], order=[(f("ts"), "ASC"), (f("event_id"), "ASC")]))]},
        "SELECT event_id, LAG(event_type, 1) OVER w AS a, LEAD(event_id, 2) OVER w AS b, FIRST_VALUE(event_type) OVER w AS c, LAST_VALUE(event_id) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    ),
    "topk_limit_offset": (
        {"table": "orders", "fields": plain("orders", "o_orderkey", "o_totalprice"), "order_by": by((f("o_totalprice"), "DESC"), f("o_orderkey")), "limit": 20, "offset": 5},
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    ),
    "order_by_hidden": (
        {"table": "customer", "fields": plain("customer", "c_custkey"), "order_by": by((f("c_acctbal", "customer"), "DESC"), f("c_custkey", "customer")), "limit": 10},
        "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10",
    ),
    "union_distinct": (
        {"union": {"queries": [{"type": "select", "table": "customer", "fields": items(nation=f("c_nationkey", "customer"))}, {"type": "select", "table": "supplier", "fields": items(nation=f("s_nationkey", "supplier"))}]}, "order_by": by(f("nation"))},
        "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
    ),
    "union_all": (
        {"union": {"distinct": False, "queries": [{"type": "select", "table": "customer", "fields": items(name=f("c_name", "customer"), kind="customer")}, {"type": "select", "table": "supplier", "fields": items(name=f("s_name", "supplier"), kind="supplier")}]}},
        "SELECT c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier",
    ),
    "scalar_subquery": (
        {"table": "part", "fields": [*plain("part", "p_partkey"), *items(over=op("-", f("p_size"), sub(table="part", fields=items(x=fn("MIN", f("p_size", "part"))))))], "where": op(">", f("p_retailprice"), sub(table="part", fields=items(x=fn("AVG", f("p_retailprice", "part")))))},
        "SELECT p_partkey, p_size - (SELECT MIN(p_size) FROM part) AS over FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part)",
    ),
    "correlated_scalar": (
        {"table": "customer", "fields": [*plain("customer", "c_custkey"), *items(n=sub(table="orders", fields=items(x=COUNT), where=op("=", f("o_custkey", "orders"), f("c_custkey", "customer"))))]},
        "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer",
    ),
    "correlated_exists": (
        {"table": "customer", "fields": plain("customer", "c_custkey"), "where": op("EXISTS", sub(table="orders", fields=items(one=1), where=op("AND", op("=", f("o_custkey", "orders"), f("c_custkey", "customer")), op(">", f("o_totalprice", "orders"), 300000))))},
        "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    ),
    "correlated_not_exists": (
        {"table": "part", "fields": plain("part", "p_partkey"), "where": op("NOT EXISTS", sub(table="lineitem", fields=items(one=1), where=op("AND", op("=", f("l_partkey", "lineitem"), f("p_partkey", "part")), op("=", f("l_returnflag", "lineitem"), "R"))))},
        "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')",
    ),
    "row_value_list": (
        {"table": "nation", "fields": plain("nation", "n_name"), "where": op("IN", [f("n_nationkey", "nation"), f("n_regionkey", "nation")], *([fn("CAST", a, "INT"), fn("CAST", b, "INT")] for a, b in ((1, 1), (2, 1), (3, 4))))},
        "SELECT n_name FROM nation WHERE (n_nationkey, n_regionkey) IN ((1, 1), (2, 1), (3, 4))",
    ),
    "list_edges": (
        {"table": "region", "fields": [*plain("region", "r_regionkey"), *items(a=op("IN", f("r_regionkey"), []), b=op("NOT IN", f("r_regionkey"), []), c=op("IN", f("r_regionkey"), [0, None]), d=op("IN", f("r_regionkey"), 1, f("r_regionkey")), e=op("IN", f("r_regionkey"), "1", "2"))]},
        "SELECT r_regionkey, false AS a, true AS b, CASE WHEN r_regionkey = 0 THEN true END AS c, true AS d, r_regionkey IN (1, 2) AS e FROM region",
    ),
    "quoted_names": (
        {"from": {"query": {"table": "region", "fields": [{"element": f("r_name", "region"), "alias": "the `name`"}, {"element": f("r_regionkey", "region"), "alias": "select"}]}}, "tablealias": "d", "fields": items(a=f("the `name`", "d"), b=f("select", "d"))},
        "SELECT r_name AS a, r_regionkey AS b FROM region",
    ),
    "from_alias": ({"table": "nation", "tablealias": "n", "fields": [{"element": f("n_name", "nation")}, {"element": f("n_regionkey", "nation", "n")}], "where": op("<", f("n_nationkey", "nation"), 9)}, "SELECT n_name, n_regionkey FROM nation WHERE n_nationkey < 9"),
    "bit_ops": ({"table": "part", "fields": [*plain("part", "p_partkey"), *items(a=op("^", f("p_size"), 5), b=op(">>", f("p_size"), 1), c=op("~", f("p_size")))]}, "SELECT p_partkey, xor(p_size, 5) AS a, p_size >> 1 AS b, ~p_size AS c FROM part"),
    "agg_bits_json": (
        {"table": "part", "fields": [{"element": f("p_brand", "part")}, *items(a=fn("BIT_AND", f("p_size")), b=fn("BIT_OR", f("p_size")), c=fn("JSON_ARRAYAGG", f("p_size"), distinct=True), d=fn("STDDEV_SAMP", f("p_size")), e=fn("VAR_SAMP", f("p_size")))], "group_by": [f("p_brand", "part")]},
        "SELECT p_brand, bit_and(p_size) AS a, bit_or(p_size) AS b, '[' || string_agg(DISTINCT p_size, ',' ORDER BY p_size) || ']' AS c, stddev_samp(p_size) AS d, var_samp(p_size) AS e FROM part GROUP BY p_brand",
    ),
    "agg_distinct_all": (
        {"table": "part", "fields": [{"element": f("p_brand", "part")}, *items(a=fn("ROUND", fn("STDDEV", f("p_size"), distinct=True), 6), b=fn("ROUND", fn("VARIANCE", f("p_size"), distinct=True), 6), c=fn("AVG", f("p_size"), distinct=True), d=fn("MAX", f("p_size"), distinct=True), e=fn("BIT_XOR", f("p_size"), distinct=True))], "group_by": [f("p_brand", "part")]},
        "SELECT p_brand, ROUND(stddev_pop(DISTINCT p_size), 6) AS a, ROUND(var_pop(DISTINCT p_size), 6) AS b, AVG(DISTINCT p_size) AS c, MAX(p_size) AS d, bit_xor(DISTINCT p_size) AS e FROM part GROUP BY p_brand",
    ),
    "window_frames": (
        {"table": "orders", "fields": [*plain("orders", "o_orderkey"), *items(near={**win("SUM", f("o_orderkey"), by=[f("o_custkey")], order=[(f("o_orderkey"), "ASC")]), "over": {"partition_by": [f("o_custkey")], "order_by": [{"expression": f("o_orderkey")}], "frame": {"start": -1, "end": 1}}}, later={**win("COUNT", STAR), "over": {"partition_by": [f("o_custkey")], "order_by": [{"expression": f("o_orderkey")}], "frame": {"start": 0, "end": None}}}, second=win("NTH_VALUE", f("o_orderkey"), 2, by=[f("o_custkey")], order=[(f("o_orderkey"), "ASC")]))]},
        "SELECT o_orderkey, CAST(SUM(o_orderkey) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS near, COUNT(*) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later, NTH_VALUE(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    ),
    "window_unordered": ({"table": "region", "fields": items(a=win("RANK"), b=win("COUNT", STAR), c=win("DENSE_RANK", by=[f("r_regionkey")]))}, "SELECT 1 AS a, COUNT(*) OVER () AS b, 1 AS c FROM region"),
    "offset_alone": ({"table": "nation", "fields": plain("nation", "n_name"), "order_by": by(f("n_name", "nation")), "offset": 20}, "SELECT n_name FROM nation ORDER BY n_name OFFSET 20"),
    "union_nested": (
        {"union": {"distinct": False, "queries": [{"type": "select", "union": {"queries": [{"type": "select", "table": "region", "fields": items(x=f("r_regionkey", "region"))}, {"type": "select", "table": "nation", "fields": items(x=f("n_regionkey", "nation"))}]}}, {"type": "select", "table": "nation", "fields": items(x=f("n_nationkey", "nation"))}]}, "order_by": by((f("x"), "DESC")), "limit": 7, "offset": 1},
        "SELECT x FROM (SELECT r_regionkey AS x FROM region UNION ALL SELECT n_nationkey FROM nation) ORDER BY x DESC LIMIT 7 OFFSET 1",
    ),
    "more_string_funcs": (
        {"table": "supplier", "fields": [*plain("supplier", "s_suppkey"), *items(a=fn("FORMAT", f("s_suppkey"), 2), b=fn("SUBSTRING_INDEX", f("s_name"), "#", 1), c=fn("FIND_IN_SET", f("s_suppkey"), "1,2,3"), d=fn("LOCATE", "#", f("s_name")), e=fn("RPAD", f("s_suppkey"), 6, "0"), g=fn("TRIM", fn("CONCAT", " ", f("s_name"), " ")), h=fn("HEX", f("s_suppkey")), i=fn("ELT", 2, "a", f("s_name")), j=fn("CHAR_LENGTH", f("s_name")), k=fn("RIGHT", f("s_name"), 3), l=fn("REPEAT", "x", 3))]},
        "SELECT s_suppkey, printf('%,.2f', CAST(s_suppkey AS DOUBLE)) AS a, split_part(s_name, '#', 1) AS b, CASE WHEN s_suppkey <= 3 THEN s_suppkey ELSE 0 END AS c, instr(s_name, '#') AS d, rpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS e, s_name AS g, hex(s_suppkey) AS h, s_name AS i, length(s_name) AS j, right(s_name, 3) AS k, 'xxx' AS l FROM supplier",
    ),
    "week_modes": (
        {"table": "orders", "fields": [*plain("orders", "o_orderkey"), *items(a=fn("WEEK", f("o_orderdate"), 3), b=fn("WEEK", f("o_orderdate"), 5), c=fn("WEEK", f("o_orderdate")), d=fn("WEEK", f("o_orderdate"), 1))]},
        "SELECT o_orderkey, weekofyear(o_orderdate) AS a, CAST(strftime(o_orderdate, '%W') AS INTEGER) AS b, CAST(strftime(o_orderdate, '%U') AS INTEGER) AS c, CASE WHEN isoyear(o_orderdate) < year(o_orderdate) THEN 0 WHEN isoyear(o_orderdate) > year(o_orderdate) THEN weekofyear(o_orderdate - INTERVAL 7 DAY) + 1 ELSE weekofyear(o_orderdate) END AS d FROM orders",
    ),
    "more_date_funcs": (
        {"table": "orders", "fields": [*plain("orders", "o_orderkey"), *items(a=fn("DATE_FORMAT", fn("STR_TO_DATE", fn("DATE_FORMAT", f("o_orderdate"), "%d.%m.%Y"), "%d.%m.%Y"), "%Y/%m/%d"), b=fn("UNIX_TIMESTAMP", f("o_orderdate")), c=fn("DATE_FORMAT", fn("DATE_SUB", f("o_orderdate"), 1, "MONTH"), "%Y-%m-%d"), d=fn("MONTHNAME", f("o_orderdate")), e=fn("TIMESTAMPDIFF", "MONTH", f("o_orderdate"), fn("CAST", "2000-01-01", "DATETIME")), g=fn("HOUR", f("o_orderdate")), h=fn("DATE_FORMAT", fn("FROM_UNIXTIME", fn("UNIX_TIMESTAMP", f("o_orderdate"))), "%Y"), i=fn("LAST_DAY", f("o_orderdate")))]},
        "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS a, CAST(epoch(o_orderdate) AS BIGINT) AS b, strftime(o_orderdate - INTERVAL 1 MONTH, '%Y-%m-%d') AS c, monthname(o_orderdate) AS d, datesub('month', o_orderdate, TIMESTAMP '2000-01-01') AS e, hour(o_orderdate) AS g, strftime(o_orderdate, '%Y') AS h, last_day(o_orderdate) AS i FROM orders",
    ),
    "json_funcs": (
        {"table": "events", "fields": [*plain("events", "event_id"), *items(a=fn("JSON_CONTAINS", '[1, "a", {"b": 2}]', '"a"'), b=fn("JSON_CONTAINS", "[1, 2, 3]", "[3, 1]"), c=fn("JSON_CONTAINS", f("props"), '{"k": 1}'), d=fn("JSON_ARRAY", f("event_id"), f("event_type"), None), e=fn("JSON_LENGTH", fn("JSON_ARRAY", 1, 2)), g=fn("JSON_OBJECT", "t", f("event_type")), h=fn("JSON_CONTAINS", "[1]", "2"))]},
        "SELECT event_id, 1 AS a, 1 AS b, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) = 1 THEN 1 ELSE 0 END AS c, '[' || event_id || ',\"' || event_type || '\",null]' AS d, 2 AS e, '{\"t\":\"' || event_type || '\"}' AS g, 0 AS h FROM events",
    ),
    "array_funcs": ({"table": "part", "fields": [*plain("part", "p_partkey"), *items(a=fn("SIZE", fn("SPLIT", f("p_name"), " ")), b=fn("ELEMENT_AT", fn("SPLIT", f("p_name"), " "), 1), c=fn("ARRAY_JOIN", fn("SORT_ARRAY", fn("SPLIT", f("p_name"), " ")), "+"))]}, "SELECT p_partkey, len(string_split(p_name, ' ')) AS a, string_split(p_name, ' ')[1] AS b, array_to_string(list_sort(string_split(p_name, ' ')), '+') AS c FROM part"),
}

# Statements that write.

NATIONS = {"type": "create", "table": "stock", "columns": [{"name": "id", "type": "bigint", "primary_key": True, "nullable": False}, {"name": "name", "type": "varchar(50)"}, {"name": "n", "type": "int", "default": 0}]}


def _service(spark: SparkSession, sf_dir: str) -> QueryService:
    store = Store(spark, shared_folder(spark, "store"))
    stock = table_from({"name": "stock", "fields": [{"name": "id", "primaryKey": True}, {"name": "name"}, {"name": "n"}], "joins": [{"targetTable": "nation", "on": {"stock.n": "nation.n_nationkey"}, "type": "INNER"}]})
    both = CompositeCatalog({"main": catalog(), "own": StaticCatalog([stock])}, "main")
    return QueryService(spark, both, Sources(store, ParquetFolder(spark, sf_dir)), store, strict=True)


def _fill(s: QueryService) -> None:
    """stock: every customer's key, name and nation."""
    s.execute(NATIONS)
    s.execute({"type": "insert", "table": "stock", "from": {"type": "select", "table": "customer", "fields": plain("customer", "c_custkey", "c_name", "c_nationkey")}})


def _writes(*statements: dict, fill: bool = True, create: bool = False, table: str = "stock") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _service(spark, sf_dir)
        if fill:
            _fill(s)
        for q in statements:
            s.execute(q)
        return s.sources.table(table)

    return run


_STOCK = "SELECT c_custkey AS id, c_name AS name, c_nationkey AS n FROM customer"
_SUPPLIERS = {"type": "select", "table": "supplier", "fields": plain("supplier", "s_suppkey", "s_name", "s_nationkey")}
_MORE = {"type": "insert", "table": "stock", "columns": ["id", "name"]}

WRITES: dict[str, tuple[Query, str]] = {
    "insert_values": (
        _writes(NATIONS, {"type": "insert", "table": "stock", "values": [{"id": 1, "name": "O'Reilly", "n": 5}, {"id": 2, "name": None}, {"id": 3, "name": "007", "n": 7, "extra": 1}]}, fill=False),
        "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'O''Reilly', 5), (2, NULL, NULL), (3, '007', 7)) t(id, name, n)",
    ),
    "insert_select": (_writes(), _STOCK),
    "insert_ignore": (_writes({"type": "insert", "table": "stock", "ignore": True, "from": _SUPPLIERS}), f"{_STOCK} UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)"),
    "upsert": (
        _writes({"type": "insert", "table": "stock", "from": _SUPPLIERS, "on_duplicate": {"n": op("+", f("n", "stock"), 100), "name": fn("VALUES", f("name"))}}),
        "SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(s_name, c_name) AS name, CASE WHEN c_custkey IS NULL THEN s_nationkey WHEN s_suppkey IS NULL THEN c_nationkey ELSE c_nationkey + 100 END AS n FROM customer FULL JOIN supplier ON c_custkey = s_suppkey",
    ),
    "update_where": (
        _writes({"type": "update", "table": "stock", "set": {"n": op("+", f("n", "stock"), 1), "name": fn("UPPER", f("name", "stock"))}, "where": op("<", f("n", "stock"), 5)}),
        "SELECT c_custkey AS id, CASE WHEN c_nationkey < 5 THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_nationkey < 5 THEN c_nationkey + 1 ELSE c_nationkey END AS n FROM customer",
    ),
    "update_join": (
        _writes({"type": "update", "table": "stock", "set": {"name": f("n_name", "nation")}, "where": op("=", f("n_regionkey", "nation"), 2)}),
        "SELECT c_custkey AS id, CASE WHEN n_regionkey = 2 THEN n_name ELSE c_name END AS name, c_nationkey AS n FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "delete_where": (_writes({"type": "delete", "table": "stock", "where": op("OR", op("=", f("n", "stock"), 3), op("IS NULL", f("name", "stock")))}), f"SELECT * FROM ({_STOCK}) WHERE n <> 3"),
    "delete_where_limit": (
        _writes({"type": "delete", "table": "stock", "where": op(">", f("n", "stock"), 10), "order_by": by((f("id", "stock"), "DESC")), "limit": 25}),
        f"SELECT * FROM ({_STOCK}) WHERE id NOT IN (SELECT id FROM ({_STOCK}) WHERE n > 10 ORDER BY id DESC LIMIT 25)",
    ),
    "truncate_table": (_writes({"type": "truncate", "table": "stock"}), f"SELECT * FROM ({_STOCK}) WHERE false"),
    "rename_table": (_writes({"type": "rename", "tables": {"from": "stock", "to": "goods"}}, table="goods"), _STOCK),
    "alter_columns": (
        _writes({"type": "alter", "table": "stock", "actions": [{"action": "ADD_COLUMN", "name": "state", "type": "varchar(20)", "nullable": False, "default": "active"}, {"action": "CHANGE_COLUMN", "from": "n", "to": "nation", "type": "bigint"}, {"action": "DROP_COLUMN", "name": "name"}, {"action": "ADD_INDEX", "name": "by_nation", "columns": ["nation"]}]}),
        "SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS nation, 'active' AS state FROM customer",
    ),
    "transaction_multi": (
        _writes({"type": "transaction", "queries": [{"type": "delete", "table": "stock", "where": op(">", f("n", "stock"), 3)}, {"type": "update", "table": "stock", "set": {"n": 0}, "where": op("=", f("n", "stock"), 1)}]}),
        "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_nationkey = 1 THEN 0 ELSE c_nationkey END AS n FROM customer WHERE c_nationkey <= 3",
    ),
}


# Materialization.

SPEND = {
    "id": "customer_spend",
    "targetSchema": "reports",
    "target": {"logicalTable": "customer_spend", "physicalPrefix": "customer_spend", "keepGenerations": 2},
    "query": {"type": "select", "table": "orders", "fields": [{"element": f("o_custkey", "orders")}, *items(n=COUNT, spent=money(f("o_totalprice", "orders")))], "group_by": [f("o_custkey", "orders")]},
    "columns": [{"name": "custkey", "type": "bigint", "primaryKey": True, "nullable": False}, {"name": "orders", "type": "int"}, {"name": "spent", "type": "decimal", "precision": 16, "scale": 2}],
    "indexes": [{"columns": ["spent"]}],
}
RAW = {
    "id": "top_spenders",
    "targetSchema": "reports",
    "target": {"logicalTable": "top_spenders"},
    "query": {"type": "raw_select", "sql": "SELECT custkey, spent FROM {{table:reports.customer_spend}} WHERE spent > 1000000"},
    "columns": [{"name": "custkey", "type": "bigint"}, {"name": "spent", "type": "double"}],
    "dependsOn": ["customer_spend"],
}


def _materializer(spark: SparkSession, sf_dir: str) -> tuple[QueryService, Materializer, Manifests]:
    folder = shared_folder(spark, "materialized")
    store = Store(spark, folder)
    registry = Registry(f"{folder}/registry.json", lambda: int(datetime.now(UTC).timestamp()), spark)
    manifests = Manifests([SPEND, RAW])
    both = CompositeCatalog({"main": catalog(), "reports": manifests}, "main")
    service = QueryService(spark, both, Sources(Resolver(registry, store), ParquetFolder(spark, sf_dir)), store, strict=True)
    return service, Materializer(service, registry), manifests


def _built(m: Materializer, manifests: Manifests, *ids: str) -> None:
    for i in ids:
        done = m.build(manifests.get(i))
        if not done.ok:
            raise RuntimeError(done.message)


def materialize_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    service, m, manifests = _materializer(spark, sf_dir)
    _built(m, manifests, "customer_spend")
    return service.store.find(m.registry.current("customer_spend", "reports")["physical_table"])


def materialize_raw_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    service, m, manifests = _materializer(spark, sf_dir)
    _built(m, manifests, "customer_spend", "top_spenders")
    return service.store.find(m.registry.current("top_spenders", "reports")["physical_table"])


def materialized_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    service, m, manifests = _materializer(spark, sf_dir)
    _built(m, manifests, "customer_spend")
    return service.compile({"type": "select", "table": "customer_spend", "fields": items(orders=f("orders", "customer_spend"), customers=COUNT), "group_by": [f("orders", "customer_spend")]}).df


def refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which the manifests would be refreshed, as rows."""
    _, m, manifests = _materializer(spark, sf_dir)
    todo = Planner(manifests, m.registry, State(), lambda: datetime(2024, 1, 2, 3, 4)).plan()
    return spark.createDataFrame([(i, x.id) for i, x in enumerate(todo)], "place int, manifest string")


MATERIALIZED: dict[str, tuple[Query, str | None]] = {
    "materialize_full": (materialize_full, "SELECT o_custkey AS custkey, CAST(COUNT(*) AS INTEGER) AS orders, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(16,2)) AS spent FROM orders GROUP BY o_custkey"),
    "materialize_raw_select": (materialize_raw_select, f"SELECT o_custkey AS custkey, {MONEY.format('o_totalprice')} AS spent FROM orders GROUP BY o_custkey HAVING {MONEY.format('o_totalprice')} > 1000000"),
    "materialized_read": (materialized_read, "SELECT CAST(n AS INTEGER) AS orders, COUNT(*) AS customers FROM (SELECT COUNT(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n"),
    "refresh_plan": (refresh_plan, "SELECT * FROM (VALUES (0, 'customer_spend'), (1, 'top_spenders')) t(place, manifest)"),
}


def registered_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of the session is called by its name like any other."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION queryloom_twice(x INT) RETURNS INT RETURN x * 2")
    return _select({"table": "part", "fields": [*plain("part", "p_partkey"), *items(x=fn("QUERYLOOM_TWICE", f("p_size")))]})(spark, sf_dir)


MATERIALIZED["registered_function"] = (registered_function, "SELECT p_partkey, p_size * 2 AS x FROM part")


# A table met twice.


def _with_tables(document: dict, frames: dict[str, dict], *tables: dict) -> Query:
    """A document over further tables, each a query itself."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = ParquetFolder(spark, sf_dir)
        first = QueryService(spark, catalog(), Sources(source), strict=True)
        made = Frames({n: first.compile({"type": "select", **d}).df for n, d in frames.items()})
        extra = [table_from(t) for t in tables]
        known = [t for t in catalog().tables() if t.name not in {x.name for x in extra}]
        return QueryService(spark, StaticCatalog([*known, *extra]), Sources(made, source), strict=True).compile({"type": "select", **document}).df

    return run


_TRADE = {"table": "lineitem", "distinct": True, "fields": items(buyer=f("c_nationkey", "customer"), seller=f("s_nationkey", "supplier"))}
TWICE: dict[str, tuple[Query, str]] = {
    "join_self_via_bridge": (
        _with_tables(
            {"table": "nation", "fields": [*items(buyer=f("n_name", "nation"), pair=f("buyer", "trade")), {"element": f("n_name", "nation", "other"), "alias": "seller"}]},
            {"trade": _TRADE},
            {"name": "nation", "fields": [{"name": "n_nationkey", "primaryKey": True}], "joins": [{"targetTable": "trade", "on": {"nation.n_nationkey": "trade.buyer"}, "type": "INNER"}]},
            {"name": "trade", "joins": [{"targetTable": "nation", "on": {"trade.buyer": "nation.n_nationkey"}, "type": "INNER"}, {"targetTable": "nation", "on": {"trade.seller": "nation.n_nationkey"}, "type": "INNER"}]},
        ),
        "SELECT a.n_name AS buyer, t.buyer AS pair, b.n_name AS seller FROM nation a JOIN (SELECT DISTINCT c_nationkey AS buyer, s_nationkey AS seller FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) t ON a.n_nationkey = t.buyer JOIN nation b ON t.seller = b.n_nationkey",
    ),
    "join_self_edge": (
        _with_tables(
            {"table": "nation", "fields": [*plain("nation", "n_name"), {"element": f("n_name", "nation", "head"), "alias": "head"}]},
            {},
            {"name": "nation", "joins": [{"targetTable": "nation", "on": {"nation.n_regionkey": "nation.n_nationkey"}, "type": "LEFT"}]},
        ),
        "SELECT a.n_name, b.n_name AS head FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_nationkey",
    ),
}


def _select(document: dict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return QueryService(spark, catalog(), Sources(ParquetFolder(spark, sf_dir)), strict=True).compile({"type": "select", **document}).df

    return run


def queries() -> dict[str, Query]:
    from queryloom import outcomes

    return {n: _select(d) for n, (d, _) in SELECTS.items()} | {n: q for n, (q, _) in (TWICE | WRITES | MATERIALIZED | outcomes.ALL).items()}


#: Integer widths that DuckDB chooses otherwise for the same functions.
WIDTHS = {
    "more_string_funcs": {"c": "INTEGER", "d": "INTEGER", "j": "INTEGER"},
    "week_modes": {"a": "INTEGER", "b": "INTEGER", "c": "INTEGER", "d": "INTEGER"},
    "more_date_funcs": {"g": "INTEGER"},
    "window_unordered": {"a": "INTEGER", "c": "INTEGER"},
    "array_funcs": {"a": "INTEGER"},
    "arith_ops": {"g": "BIGINT"},
    "string_funcs": {"e": "INTEGER", "i": "INTEGER", "o": "BIGINT"},
    "date_funcs": {"y": "INTEGER", "m": "INTEGER", "d": "INTEGER", "q": "INTEGER", "days": "INTEGER"},
    "group_by_expression": {"y": "INTEGER"},
    "window_row_number": {"rn": "INTEGER"},
    "window_ranks": {"a": "INTEGER", "b": "INTEGER", "c": "INTEGER"},
    "window_rank_over_agg": {"place": "INTEGER"},
}


def oracle_sql() -> dict[str, str]:
    from queryloom import outcomes

    found = {n: s for n, (_, s) in (SELECTS | TWICE | WRITES | MATERIALIZED | outcomes.ALL).items() if s}
    for name, columns in WIDTHS.items():
        casts = ", ".join(f"CAST({c} AS {kind}) AS {c}" for c, kind in columns.items())
        found[name] = f"SELECT * REPLACE ({casts}) FROM ({found[name]})"
    return found
