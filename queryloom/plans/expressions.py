"""Elements of query documents as Spark columns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryloom.errors import CompileError, ValidationError
from queryloom.functions import registry

if TYPE_CHECKING:
    from queryloom.plans.scope import Scope

NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<=>": lambda a, b: a.eqNullSafe(b),
}
ARITHMETIC = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a, b),
    "%": lambda a, b: F.try_mod(a, b),
    "MOD": lambda a, b: F.try_mod(a, b),
    "DIV": lambda a, b: F.when(b != 0, F.call_function("div", a, b)),
    "&": lambda a, b: a.bitwiseAND(b),
    "|": lambda a, b: a.bitwiseOR(b),
    "^": lambda a, b: a.bitwiseXOR(b),
    "<<": lambda a, b: F.call_function("shiftleft", a, b.cast("int")),
    ">>": lambda a, b: F.call_function("shiftright", a, b.cast("int")),
}


def children(e: Any) -> Iterator[Any]:
    """Direct sub-elements; a subquery is a scope of its own and has none here."""
    if isinstance(e, list):
        yield from e
    elif isinstance(e, dict) and e.get("type") != "subquery":
        yield from e.get("params") or ()
        for c in e.get("cases") or ():
            yield c.get("when")
            yield c.get("then")
        if "else" in e:
            yield e["else"]
        over = e.get("over") or {}
        yield from over.get("partition_by") or ()
        yield from (o.get("expression", o.get("element")) for o in over.get("order_by") or ())


def walk(e: Any) -> Iterator[dict]:
    """All typed elements in e, outermost first."""
    if isinstance(e, dict) and "type" in e:
        yield e
    for c in children(e):
        yield from walk(c)


def quoted(*names: str) -> str:
    return ".".join("`" + n.replace("`", "``") + "`" for n in names)


def canonical(e: Any, scope: Scope) -> str:
    """A text that equal elements share, whatever alias rule their fields follow."""

    def norm(x: Any) -> Any:
        if isinstance(x, dict):
            if x.get("type") == "fld":
                return ["fld", *scope.locate(x)]
            return {k: norm(v) for k, v in x.items() if k != "alias"} | ({"function": str(x["function"]).upper()} if "function" in x else {})
        return [norm(y) for y in x] if isinstance(x, list) else x

    return json.dumps(norm(e), sort_keys=True, default=str)


class Builder:
    """Compiles elements in one scope. ``known`` replaces elements that are columns already (grouped ones)."""

    def __init__(self, scope: Scope, subquery: Callable[[dict], Any], known: dict[str, Column] | None = None, missing: Callable[[dict], Column | None] | None = None) -> None:
        self.scope, self.subquery, self.known, self.missing = scope, subquery, known, missing

    def build(self, e: Any) -> Column:
        if not isinstance(e, (dict, list)):
            return F.lit(e)
        if isinstance(e, list):
            if not e or not any(isinstance(x, dict) and "type" in x for x in e):
                if e and not any(isinstance(x, (dict, list)) for x in e):
                    return F.array(*map(F.lit, e))
                raise CompileError(f"Invalid array element structure: {e!r}")
            return F.struct(*(self.build(x) for x in e))
        kind = e.get("type")
        if kind is None:
            raise CompileError(f"Invalid array element structure: {e!r}")
        if self.known is not None and (found := self.known.get(canonical(e, self.scope))) is not None:
            return found
        make = getattr(self, f"_{kind}", None) if kind in ("fld", "fn", "windowfn", "op", "case", "subquery") else None
        if make is None:
            raise CompileError(f"Unsupported element type: {kind}")
        return make(e)

    def _fld(self, e: dict) -> Column:
        if not e.get("field"):
            raise CompileError("Field reference must contain a 'field' key.")
        if self.known is not None:
            found = self.missing(e) if self.missing else None
            if found is not None:
                return found
            if not self.scope.is_outer(e):
                raise CompileError(f"Field '{e['field']}' is neither grouped nor inside an aggregate.")
        return self.scope.column(e)

    def _call(self, e: dict, what: str) -> registry.Call:
        if "function" not in e or not isinstance(e.get("params"), list):
            raise CompileError(what)
        name = str(e["function"]).upper()
        raw = e["params"]
        star = [isinstance(p, dict) and p.get("type") == "fld" and p.get("field") == "*" for p in raw]
        if any(star):
            if name != "COUNT":
                raise CompileError(f"'*' is only allowed in COUNT, not in {name}.")
            return registry.Call(name, [F.lit(1)], [1], False)
        return registry.Call(name, [self.build(p) for p in raw], raw, bool(e.get("distinct")))

    def _fn(self, e: dict) -> Column:
        return registry.call(self._call(e, "Function must have 'function' and 'params'."))

    def _windowfn(self, e: dict) -> Column:
        c = self._call(e, "Window function must have 'function' and 'params'.")
        if c.distinct:
            raise ValidationError("DISTINCT is not supported in a window function.")
        over = e.get("over") or {}
        orders = []
        for o in over.get("order_by") or ():
            by = o.get("expression", o.get("element"))
            if by is None:
                raise CompileError("Each ORDER BY entry must have an 'expression'.")
            orders.append(self.ordered(by, o.get("direction", "ASC")))
        w = Window.partitionBy(*(self.build(p) for p in over.get("partition_by") or ()))
        if orders or c.name in registry.RANKING:
            # Ranking needs an order; without one any will do.
            w = w.orderBy(*(orders or [F.lit(1)]))
        if frame := over.get("frame"):
            lo, hi = (Window.unboundedPreceding if frame.get("start") is None else frame["start"], Window.unboundedFollowing if frame.get("end") is None else frame["end"])
            w = w.rowsBetween(lo, hi) if frame.get("unit", "ROWS").upper() == "ROWS" else w.rangeBetween(lo, hi)
        return registry.window_call(c, bool(orders)).over(w)

    def ordered(self, e: Any, direction: str) -> Column:
        if str(direction).upper() not in ("ASC", "DESC"):
            raise CompileError("ORDER BY direction must be ASC or DESC.")
        col = self.build(e)
        return col.desc() if str(direction).upper() == "DESC" else col.asc()

    def _case(self, e: dict) -> Column:
        cases = e.get("cases")
        if not isinstance(cases, list) or not cases:
            raise CompileError("CASE expression must have a 'cases' array.")
        out: Any = F
        for c in cases:
            if not c.get("when"):
                raise CompileError("CASE entry missing 'when'.")
            out = out.when(self.predicate(c["when"]), self.build(c.get("then")))
        return out.otherwise(self.build(e["else"])) if "else" in e else out

    def predicate(self, e: Any) -> Column:
        col = self.build(e)
        kind = self.scope.type_of(e)
        return col.cast("boolean") if kind is not None and not isinstance(kind, T.BooleanType) else col

    def _subquery(self, e: dict) -> Column:
        return self._inner(e).scalar()

    def _inner(self, e: dict) -> Any:
        if not isinstance(e.get("query"), dict):
            raise CompileError("Subquery must have 'query'.")
        return self.subquery(e["query"])

    def _pair(self, a: Any, b: Any) -> tuple[Column, Column]:
        """Both sides of a comparison; numbers and texts meet as numbers, a text that is none being null."""
        ka, kb = self.scope.type_of(a), self.scope.type_of(b)
        ca, cb = self.build(a), self.build(b)
        for mine, other, value, swap in ((ka, kb, a, False), (kb, ka, b, True)):
            if isinstance(other, NUMERIC) and isinstance(mine, T.StringType):
                if isinstance(value, str) and NUMBER.fullmatch(value.strip()):
                    number = float(value) if any(ch in value for ch in ".eE") else int(value)
                    fixed = F.lit(number)
                else:
                    fixed = (cb if swap else ca).try_cast("double")
                ca, cb = (ca, fixed) if swap else (fixed, cb)
        return ca, cb

    def _number(self, e: Any) -> Column:
        col, kind = self.build(e), self.scope.type_of(e)
        if isinstance(kind, T.BooleanType):
            return col.cast("int")
        return col.try_cast("double") if isinstance(kind, T.StringType) else col

    def _op(self, e: dict) -> Column:
        op, params = " ".join(str(e.get("operator", "")).upper().split()), e.get("params")
        if not isinstance(params, list) or not params:
            raise CompileError(f"Operator '{op}' needs 'params'.")
        if op in ("IS NULL", "IS NOT NULL"):
            col = self.build(params[0])
            return col.isNull() if op == "IS NULL" else col.isNotNull()
        if op in ("BETWEEN", "NOT BETWEEN"):
            if len(params) != 3:
                raise CompileError(f"{op} expects 3 parameters.")
            (x, lo), (y, hi) = self._pair(params[0], params[1]), self._pair(params[0], params[2])
            inside = (x >= lo) & (y <= hi)
            return ~inside if op.startswith("NOT") else inside
        if op in ("IN", "NOT IN"):
            found = self._in(op, params)
            return ~found if op == "NOT IN" else found
        if op in ("EXISTS", "NOT EXISTS"):
            found = self._inner(params[0]).exists()
            return ~found if op == "NOT EXISTS" else found
        if op in ("NOT", "!"):
            return ~self.predicate(params[0])
        if op == "-" and len(params) == 1:
            return -self._number(params[0])
        if op == "~":
            return F.bitwise_not(self.build(params[0]))
        if op in ("AND", "OR", "&&", "||"):
            return reduce((lambda a, b: a & b) if op in ("AND", "&&") else (lambda a, b: a | b), map(self.predicate, params))
        if op == "XOR":
            return reduce(lambda a, b: a != b, map(self.predicate, params))
        if op in COMPARE:
            return COMPARE[op](*self._pair(*params)) if len(params) == 2 else reduce(COMPARE[op], map(self.build, params))
        if op in ARITHMETIC:
            return reduce(ARITHMETIC[op], map(self._number, params))
        if op in ("LIKE", "NOT LIKE", "REGEXP", "NOT REGEXP", "RLIKE", "NOT RLIKE"):
            text, pattern = self.build(params[0]).cast("string"), params[1]
            name = op.removeprefix("NOT ")
            if isinstance(pattern, str):
                found = text.like(pattern) if name == "LIKE" else text.rlike(pattern)
            else:
                found = F.like(text, self.build(pattern)) if name == "LIKE" else F.rlike(text, self.build(pattern))
            return ~found if op.startswith("NOT") else found
        raise CompileError(f"Unsupported operator: {op}")

    def _in(self, op: str, params: list) -> Column:
        if len(params) < 2:
            raise CompileError(f"{op} expects at least 2 parameters.")
        right = params[1:]
        if len(right) == 1 and isinstance(right[0], dict) and right[0].get("type") == "subquery":
            return self.build(params[0]).isin(self._inner(right[0]))
        values = right[0] if len(right) == 1 and isinstance(right[0], list) else right
        if not values:
            return F.lit(False)
        pairs = [self._pair(params[0], v) for v in values]
        if any(isinstance(v, dict) for v in values):
            return reduce(lambda a, b: a | b, (a == b for a, b in pairs))
        return pairs[0][0].isin([b for _, b in pairs])
