"""Functions of query documents by name.

Names are open: what is not listed here is looked up among Spark's functions and the
session's registered ones. Listed are the names whose meaning differs from the Spark
function of that name, or that Spark has under another one. Everything is a built-in
Column expression, so it stays inside generated code.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as Classic

from queryloom.errors import CompileError
from queryloom.functions import types


#: The number the last INSERT of the running service gave; the service sets it.
last_insert_id: ContextVar[int] = ContextVar("last_insert_id", default=0)


@dataclass
class Call:
    """A function call: its arguments as columns, and as they stand in the document."""

    name: str
    cols: list[Column]
    raw: list[Any]
    distinct: bool = False

    def text(self, i: int, what: str) -> str:
        if i >= len(self.raw) or not isinstance(self.raw[i], str):
            raise CompileError(what)
        return self.raw[i]

    def count(self, least: int, most: int | None, what: str) -> None:
        if not least <= len(self.raw) <= (least if most is None else most):
            raise CompileError(what)


_CODES = {"Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "j": "DDD", "T": "HH:mm:ss", "r": "hh:mm:ss a", "%": "%"}


def date_pattern(codes: str) -> str:
    """%-codes to a datetime pattern."""
    out, i = [], 0
    while i < len(codes):
        ch = codes[i]
        if ch == "%" and i + 1 < len(codes):
            i += 1
            if codes[i] not in _CODES:
                raise CompileError(f"Date format code %{codes[i]} is not supported.")
            out.append(_CODES[codes[i]])
        else:
            out.append(f"'{ch}'" if ch.isalpha() else ("''" if ch == "'" else ch))
        i += 1
    return "".join(out)


UNITS = {"MICROSECOND", "SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR"}


def _unit(c: Call, i: int) -> str:
    unit = c.text(i, f"{c.name} needs a unit.").upper()
    if unit not in UNITS:
        raise CompileError(f"Unit '{unit}' is not supported.")
    return unit


def _shift(sign: int) -> Callable[[Call], Column]:
    def make(c: Call) -> Column:
        c.count(2, 3, f"{c.name} expects a date, a number and a unit.")
        n, unit = c.cols[1] * sign, _unit(c, 2) if len(c.raw) == 3 else "DAY"
        return F.timestamp_add(unit, n.cast("int"), c.cols[0])

    return make


def _guard(f: Callable[..., Column]) -> Callable[[Call], Column]:
    """Null as soon as one argument is."""

    def make(c: Call) -> Column:
        null = reduce(lambda a, b: a | b, (x.isNull() for x in c.cols))
        return F.when(~null, f(*c.cols))

    return make


def _substring(c: Call) -> Column:
    c.count(2, 3, f"{c.name} expects 2 or 3 parameters.")
    n = c.cols[2] if len(c.cols) == 3 else F.lit(2**31 - 1)
    return F.when(c.cols[1] == 0, F.lit("")).otherwise(F.substring(c.cols[0], c.cols[1], n))


def _truncate(c: Call) -> Column:
    scale = F.pow(F.lit(10.0), c.cols[1])
    return F.signum(c.cols[0]) * F.floor(F.abs(c.cols[0]) * scale) / scale


def _group_concat(c: Call) -> Column:
    c.count(1, 2, "GROUP_CONCAT expects 1 or 2 parameters.")
    if len(c.raw) == 2 and not isinstance(c.raw[1], str):
        raise CompileError("GROUP_CONCAT separator must be a string literal.")
    sep = c.raw[1] if len(c.raw) == 2 and c.raw[1] not in ("", "0") else ","
    values = (F.collect_set if c.distinct else F.collect_list)(c.cols[0])
    # Sorted by value, so that the text does not depend on the order of the rows.
    joined = F.array_join(F.transform(F.array_sort(values), lambda x: x.cast("string")), sep)
    return F.when(F.count(c.cols[0]) > 0, joined)


def _json_object(c: Call) -> Column:
    names = [c.text(i, "JSON_OBJECT needs literal keys.") for i in range(0, len(c.raw), 2)]
    return F.to_json(F.struct(*(c.cols[2 * k + 1].alias(n) for k, n in enumerate(names))), {"ignoreNullFields": "false"})


def _convert(c: Call) -> Column:
    c.count(2, None, "CONVERT expects 2 parameters: value and charset string.")
    cs = c.text(1, "CONVERT expects 2 parameters: value and charset string.").lower()
    if cs in ("utf8", "utf8mb4", "utf8mb3"):
        return c.cols[0].cast("string")
    java = {"latin1": "ISO-8859-1", "ascii": "US-ASCII", "utf16": "UTF-16"}.get(cs, cs)
    return F.decode(F.encode(c.cols[0].cast("string"), java), java)


def _cast(c: Call) -> Column:
    c.count(2, None, "CAST expects 2 parameters: value and type string.")
    return types.cast(c.cols[0], c.text(1, "CAST expects 2 parameters: value and type string."))


def _week(c: Call) -> Column:
    """Week of the year in the modes 0 to 7.

    A mode says on which day weeks start, whether the first week of a year is the one with
    four days in it or the first that starts in it, and whether days of no week of their
    own year are in week 0 or in the other year's last.
    """
    c.count(1, 2, "WEEK expects 1 or 2 parameters.")
    mode = c.raw[1] if len(c.raw) == 2 else 0
    if not isinstance(mode, int) or not 0 <= mode <= 7:
        raise CompileError("WEEK needs a mode from 0 to 7.")
    monday, four_days, own_year = mode % 2 == 1, mode in (1, 3, 4, 6), mode not in (2, 3, 6, 7)
    day = c.cols[0].cast("date")
    start = F.date_sub(day, F.weekday(day) if monday else F.dayofweek(day) - 1)
    decides = F.date_add(start, 3) if four_days else start
    number = F.floor((F.dayofyear(decides) - 1) / 7).cast("int") + 1
    if not own_year:
        return number
    before = F.floor((F.dayofyear(F.date_sub(decides, 7)) - 1) / 7).cast("int") + 2
    return F.when(F.year(decides) < F.year(day), 0).when(F.year(decides) > F.year(day), before).otherwise(number)


def _json_array(c: Call) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *(F.regexp_replace(F.to_json(F.array(x), {"ignoreNullFields": "false"}), r"^\[(.*)\]$", "$1") for x in c.cols)), F.lit("]"))


def _json_contains(c: Call) -> Column:
    """A value is in an array that holds it, an array in one that holds all its values, an object in one that has all its members."""
    c.count(2, 2, "JSON_CONTAINS expects 2 parameters.")
    target, inner = F.try_parse_json(c.cols[0].cast("string")), F.try_parse_json(c.cols[1].cast("string"))
    of = lambda x, kind: F.try_variant_get(x, "$", kind)
    texts = lambda x: F.transform(of(x, "array<variant>"), lambda v: F.to_json(v))
    members = lambda x: F.transform_values(of(x, "map<string,variant>"), lambda _, v: F.to_json(v))
    all_there = F.forall(F.map_entries(members(inner)), lambda e: F.coalesce(F.try_element_at(members(target), e["key"]) == e["value"], F.lit(False)))
    found = (
        F.when(of(target, "array<variant>").isNotNull() & of(inner, "array<variant>").isNotNull(), F.size(F.array_except(texts(inner), texts(target))) == 0)
        .when(of(target, "array<variant>").isNotNull(), F.array_contains(texts(target), F.to_json(inner)))
        .when(of(target, "map<string,variant>").isNotNull() & of(inner, "map<string,variant>").isNotNull(), all_there)
        .otherwise(F.to_json(target) == F.to_json(inner))
    )
    return F.when(target.isNotNull() & inner.isNotNull(), found.cast("int"))


ADAPTERS: dict[str, Callable[[Call], Column]] = {
    "CAST": _cast,
    "CONVERT": _convert,
    "LENGTH": lambda c: F.octet_length(c.cols[0].cast("string")),
    "OCTET_LENGTH": lambda c: F.octet_length(c.cols[0].cast("string")),
    "SUBSTRING": _substring,
    "SUBSTR": _substring,
    "MID": _substring,
    "FIELD": lambda c: F.coalesce(F.array_position(F.array(*c.cols[1:]), c.cols[0]), F.lit(0)),
    "FORMAT": lambda c: F.format_number(c.cols[0], c.raw[1] if len(c.raw) > 1 else 0),
    "STRCMP": lambda c: F.when(c.cols[0] < c.cols[1], -1).when(c.cols[0] == c.cols[1], 0).when(c.cols[0] > c.cols[1], 1),
    "TRUNCATE": _truncate,
    "MOD": lambda c: F.try_mod(c.cols[0], c.cols[1]),
    "GREATEST": _guard(F.greatest),
    "LEAST": _guard(F.least),
    "RAND": lambda c: F.rand(c.raw[0]) if c.raw else F.rand(),
    "IF": lambda c: F.when(c.cols[0].cast("boolean"), c.cols[1]).otherwise(c.cols[2]),
    "ISNULL": lambda c: c.cols[0].isNull().cast("int"),
    "NOT": lambda c: ~c.cols[0].cast("boolean"),
    "DATE": lambda c: c.cols[0].cast("date"),
    "DATEDIFF": lambda c: F.datediff(c.cols[0], c.cols[1]),
    "DATE_FORMAT": lambda c: F.date_format(c.cols[0], date_pattern(c.text(1, "DATE_FORMAT needs a format."))),
    "STR_TO_DATE": lambda c: F.try_to_timestamp(c.cols[0], F.lit(date_pattern(c.text(1, "STR_TO_DATE needs a format.")))),
    "MONTHNAME": lambda c: F.date_format(c.cols[0], "MMMM"),
    "DAYNAME": lambda c: F.date_format(c.cols[0], "EEEE"),
    "DATE_ADD": _shift(1),
    "ADDDATE": _shift(1),
    "DATE_SUB": _shift(-1),
    "SUBDATE": _shift(-1),
    "TIMESTAMPADD": lambda c: F.timestamp_add(_unit(c, 0), c.cols[1].cast("int"), c.cols[2]),
    "TIMESTAMPDIFF": lambda c: F.timestamp_diff(_unit(c, 0), c.cols[1], c.cols[2]),
    "UNIX_TIMESTAMP": lambda c: F.unix_timestamp(c.cols[0].cast("timestamp")) if c.cols else F.unix_timestamp(),
    "FROM_UNIXTIME": lambda c: F.timestamp_seconds(c.cols[0]),
    "NOW": lambda c: F.date_trunc("second", F.current_timestamp()),
    "CURRENT_TIMESTAMP": lambda c: F.date_trunc("second", F.current_timestamp()),
    "SYSDATE": lambda c: F.date_trunc("second", F.current_timestamp()),
    "CURDATE": lambda c: F.current_date(),
    "CURTIME": lambda c: F.date_format(F.current_timestamp(), "HH:mm:ss"),
    "WEEK": _week,
    "JSON_EXTRACT": lambda c: F.get_json_object(c.cols[0], c.text(1, "JSON_EXTRACT needs a path.")),
    "JSON_VALUE": lambda c: F.get_json_object(c.cols[0], c.text(1, "JSON_VALUE needs a path.")),
    "JSON_UNQUOTE": lambda c: F.regexp_replace(c.cols[0], '^"(.*)"$', "$1"),
    "JSON_OBJECT": _json_object,
    "JSON_ARRAY": _json_array,
    "JSON_LENGTH": lambda c: F.json_array_length(c.cols[0]),
    "JSON_VALID": lambda c: F.try_parse_json(c.cols[0]).isNotNull().cast("int"),
    "JSON_CONTAINS": _json_contains,
    "UUID": lambda c: F.expr("uuid()"),
    "VERSION": lambda c: F.version(),
    "DATABASE": lambda c: F.current_database(),
    "SCHEMA": lambda c: F.current_database(),
    "LAST_INSERT_ID": lambda c: F.lit(last_insert_id.get()),
}


def _plain(name: str, distinct: Callable[[Call], Column] | None = None) -> Callable[[Call], Column]:
    f = getattr(F, name)

    def make(c: Call) -> Column:
        return distinct(c) if c.distinct and distinct else f(*c.cols)

    return make


def _on_distinct(name: str) -> Callable[[Call], Column]:
    # sum(DISTINCT x) and the like, for functions whose Column form has no such switch
    return lambda c: {"avg": lambda x: F.try_divide(F.sum_distinct(x).cast("double"), F.count_distinct(x)), "sum": F.sum_distinct}[name](c.cols[0])


AGGREGATES: dict[str, Callable[[Call], Column]] = {
    "COUNT": lambda c: F.count_distinct(*c.cols) if c.distinct else F.count(c.cols[0] if c.cols else F.lit(1)),
    "SUM": _plain("sum", _on_distinct("sum")),
    "AVG": _plain("avg", _on_distinct("avg")),
    "MIN": _plain("min"),
    "MAX": _plain("max"),
    "GROUP_CONCAT": _group_concat,
    "STD": _plain("stddev_pop"),
    "STDDEV": _plain("stddev_pop"),
    "STDDEV_POP": _plain("stddev_pop"),
    "STDDEV_SAMP": _plain("stddev_samp"),
    "VARIANCE": _plain("var_pop"),
    "VAR_POP": _plain("var_pop"),
    "VAR_SAMP": _plain("var_samp"),
    "BIT_AND": _plain("bit_and"),
    "BIT_OR": _plain("bit_or"),
    "BIT_XOR": _plain("bit_xor"),
    "ANY_VALUE": _plain("any_value"),
    "JSON_ARRAYAGG": lambda c: F.to_json(F.array_sort((F.collect_set if c.distinct else F.collect_list)(c.cols[0]))),
    "JSON_OBJECTAGG": lambda c: F.to_json(F.map_from_entries(F.collect_list(F.struct(*c.cols)))),
    "APPROX_COUNT_DISTINCT": _plain("approx_count_distinct"),
    "MEDIAN": _plain("median"),
    "COLLECT_LIST": _plain("collect_list"),
    "COLLECT_SET": _plain("collect_set"),
    "CORR": _plain("corr"),
}

RANKING = {"ROW_NUMBER": "row_number", "RANK": "rank", "DENSE_RANK": "dense_rank", "PERCENT_RANK": "percent_rank", "CUME_DIST": "cume_dist", "NTILE": "ntile", "LAG": "lag", "LEAD": "lead", "NTH_VALUE": "nth_value"}
WINDOW_VALUES = {"FIRST_VALUE": "first_value", "LAST_VALUE": "last_value"}


#: Aggregates that see to DISTINCT themselves, or that copies don't change.
OWN_DISTINCT = frozenset("COUNT SUM AVG MIN MAX GROUP_CONCAT ANY_VALUE BIT_AND BIT_OR COLLECT_SET APPROX_COUNT_DISTINCT JSON_ARRAYAGG JSON_OBJECTAGG".split())


def _distinct(col: Column) -> Column:
    """The same aggregate call over distinct values, which the Column API names for some functions only."""
    node = col._jc.node()
    call = node.copy(node.functionName(), node.arguments(), True, node.isUserDefinedFunction(), node.isInternal(), node.origin())
    return Classic(SparkSession.active()._jvm.org.apache.spark.sql.Column(call))


def is_aggregate(name: str) -> bool:
    return name.upper() in AGGREGATES


def call(c: Call) -> Column:
    """A scalar or aggregate call."""
    if c.name in AGGREGATES:
        if c.distinct and c.name not in OWN_DISTINCT:
            return _distinct(AGGREGATES[c.name](c))
        return AGGREGATES[c.name](c)
    if c.distinct:
        raise CompileError(f"DISTINCT is only meaningful in an aggregate, not in {c.name}.")
    if c.name in ADAPTERS:
        try:
            return ADAPTERS[c.name](c)
        except IndexError:
            raise CompileError(f"{c.name} has too few parameters.") from None
    if not re.fullmatch(r"[A-Z_][A-Z0-9_.]*", c.name):
        raise CompileError(f"'{c.name}' is not a function name.")
    return F.call_function(c.name.lower(), *c.cols)


def window_call(c: Call, ordered: bool) -> Column:
    if c.name in RANKING:
        raw = [x if isinstance(x, (int, float, str)) else x for x in c.raw]
        f = getattr(F, RANKING[c.name])
        if c.name == "NTILE":
            return f(int(raw[0]))
        if c.name == "NTH_VALUE":
            return f(c.cols[0], int(raw[1]))
        if c.name in ("LAG", "LEAD"):
            return f(c.cols[0], int(raw[1]) if len(raw) > 1 else 1, raw[2] if len(raw) > 2 and not isinstance(raw[2], dict) else None)
        return f()
    if c.name in WINDOW_VALUES:
        return getattr(F, WINDOW_VALUES[c.name])(c.cols[0])
    return call(c)
