"""Type names of query documents and manifests, as Spark types."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIMPLE = {
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "mediumint": T.IntegerType(),
    "bigint": T.LongType(),
    "smallint": T.ShortType(),
    "tinyint": T.ByteType(),
    "bool": T.BooleanType(),
    "boolean": T.BooleanType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "real": T.DoubleType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "timestamp": T.TimestampType(),
    "binary": T.BinaryType(),
    "varbinary": T.BinaryType(),
    "blob": T.BinaryType(),
}


def column_type(name: str, precision: int | None = None, scale: int | None = None) -> T.DataType:
    """The type of a stored column: ``int``, ``decimal`` (14, 4 by default), ``varchar(50)``, ``int unsigned``, ..."""
    text = name.strip().lower()
    m = re.match(r"([a-z]+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*(.*)", text)
    base, a, b, rest = (m[1], m[2], m[3], m[4]) if m else (text, None, None, "")
    if base in ("decimal", "numeric", "dec"):
        if a is not None:
            return T.DecimalType(int(a), int(b or 0))
        return T.DecimalType(int(precision or 14), int(4 if scale is None else scale))
    if "unsigned" in rest:
        return {"int": T.LongType(), "integer": T.LongType(), "bigint": T.DecimalType(20, 0), "smallint": T.IntegerType(), "tinyint": T.ShortType()}.get(base, _SIMPLE.get(base, T.StringType()))
    if base == "tinyint" and a == "1":
        return T.BooleanType()
    return _SIMPLE.get(base, T.StringType())


def cast(col: Column, target: str) -> Column:
    """CAST to a target type; what can't be converted is null."""
    text = " ".join(target.strip().upper().split())
    m = re.fullmatch(r"(N?CHAR|VARCHAR|BINARY)\s*\(\s*(\d+)\s*\)", text)
    if m:
        return F.substring(col.cast("string"), 1, int(m[2])) if m[1] != "BINARY" else F.substring(col.cast("binary"), 1, int(m[2]))
    fixed = {"CHAR": "string", "NCHAR": "string", "VARCHAR": "string", "TEXT": "string", "JSON": "string", "TIME": None, "SIGNED": "bigint", "SIGNED INTEGER": "bigint", "UNSIGNED": "decimal(20,0)", "UNSIGNED INTEGER": "decimal(20,0)", "DATETIME": "timestamp_ntz", "BINARY": "binary"}
    if text == "TIME":
        return F.date_format(col.try_cast("timestamp_ntz"), "HH:mm:ss")
    if text in fixed:
        return col.try_cast(fixed[text]) if fixed[text] != "binary" else col.cast("binary")
    if text == "DECIMAL":
        return col.try_cast("decimal(10,0)")
    return col.try_cast(column_type(text))


def reported(kind: T.DataType) -> str:
    """The name a result's column descriptor uses for a type."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "NULL" if isinstance(kind, T.NullType) else "string"
