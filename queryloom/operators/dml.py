"""INSERT, UPDATE and DELETE over the versioned store.

Writes are copy-on-write and set-based: one job writes the new files, one commit makes
them visible. Rows are named by file and place in it, which reading again does not
change, so a limited or joined write picks each row at most once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryloom.errors import CompileError, ExecutionError
from queryloom.plans import validate
from queryloom.plans.expressions import quoted
from queryloom.plans.joins import Node
from queryloom.plans.scope import Scope
from queryloom.plans.select import Compiler
from queryloom.sources.store import Store


@dataclass
class Written:
    affected_rows: int = 0
    insert_id: int | None = None


ROW = ["_file", "_place"]


class Writer:
    def __init__(self, compiler: Compiler, store: Store) -> None:
        self.compiler, self.store = compiler, store
        self.spark = store.spark

    # Insert.

    def insert(self, q: dict) -> Written:
        validate.insert(q)
        name = q["table"]
        info, schema = self.store.info(name), self.store.schema(name)
        if "values" in q:
            given = q.get("columns") or list(q["values"][0])
            new = self._values(q["values"], given, schema)
        else:
            found = self.compiler.compile(q["from"]).df
            given = q.get("columns") or schema.fieldNames()
            if len(found.columns) != len(given):
                raise ExecutionError("Column count doesn't match value count")
            new = found.toDF(*(f"_c{i}" for i in range(len(given)))).select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(given)))
        for c in given:
            if c not in schema.fieldNames():
                raise ExecutionError(f"Unknown column '{c}' in '{name}'")
        new = new.select(*((self._convert(F.col(quoted(f.name)), f, new.schema[f.name].dataType) if f.name in given else self._default(info, f)).alias(f.name) for f in schema.fields))
        first, changes = None, {}
        # The order in which rows came; files that are read again have none.
        new = new.withColumn("_at", F.monotonically_increasing_id())
        if info["auto"]:
            new, first, after = self._number(new, info)
            changes["next"] = after
        keys = self._keys(info)
        if q.get("on_duplicate"):
            return self._upsert(q, name, info, schema, new, keys, first, changes)
        if q.get("ignore"):
            new = self._without_known(new, name, keys)
        path = self.store.write(new.drop("_at"))  # written once; checks read what was written
        new = self.spark.read.schema(self.store.schema(name)).parquet(path)
        self._required(new, info)
        if not q.get("ignore"):
            self._unique(new, name, keys)
        n = new.count()
        self.store.append(name, path, **changes)
        return Written(n, first)

    def _values(self, rows: list[dict], given: list[str], schema: T.StructType) -> DataFrame:
        """Literal rows; an expression among them is evaluated as a column."""
        if all(not isinstance(r.get(c), dict) for r in rows for c in given):
            texts = [tuple(None if r.get(c) is None else (str(r[c]).lower() if isinstance(r[c], bool) else str(r[c])) for c in given) for r in rows]
            df = self.spark.createDataFrame(texts, T.StructType([T.StructField(c, T.StringType()) for c in given]))
            return df
        one = self.spark.range(1)
        build = self.compiler.builder(_no_fields())
        return reduce(lambda a, b: a.union(b), (one.select(*((build.build(r.get(c))).cast(schema[c].dataType if c in schema.fieldNames() else "string").alias(c) for c in given)) for r in rows))

    @staticmethod
    def _convert(col: Column, f: T.StructField, have: T.DataType) -> Column:
        if isinstance(f.dataType, T.BooleanType) and isinstance(have, T.StringType):
            return F.when(col.isin("1", "true"), True).when(col.isin("0", "false"), False)
        return col.cast(f.dataType)

    @staticmethod
    def _default(info: dict, f: T.StructField) -> Column:
        value = info["defaults"].get(f.name)
        if isinstance(value, str) and value.upper() == "CURRENT_TIMESTAMP":
            return F.date_trunc("second", F.current_timestamp()).cast(f.dataType)
        return F.lit(value).cast(f.dataType)

    def _number(self, new: DataFrame, info: dict) -> tuple[DataFrame, int | None, int]:
        """Numbers for nulls in the auto-increment column: places in a partition after prefix sums of counts."""
        auto, start = info["auto"], int(info["next"])
        names = new.columns
        marked = self.spark.read.schema(new.schema).parquet(self.store.write(new))
        marked = marked.withColumn("_part", F.shiftright("_at", 33).cast("int")).withColumn("_open", F.col(quoted(auto)).isNull().cast("long"))
        counts = sorted((r[0], r[1]) for r in marked.groupBy("_part").agg(F.sum("_open")).collect())
        total = sum(n for _, n in counts)
        new = marked.select(*map(quoted, names))
        if total:
            before = self.spark.createDataFrame(list(zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0))), "_part int, _before long")
            number = F.lit(start - 1) + F.col("_before") + F.sum("_open").over(Window.partitionBy("_part").orderBy("_at"))
            new = marked.join(before, "_part").withColumn(auto, F.coalesce(F.col(quoted(auto)), number.cast(new.schema[auto].dataType))).select(*map(quoted, names))
        given = new.agg(F.max(quoted(auto))).first()[0]
        return new, (start if total else None), max(start + total, int(given or 0) + 1)

    @staticmethod
    def _keys(info: dict) -> list[list[str]]:
        return [k for k in (info["primary_key"], *info["unique"].values()) if k]

    def _required(self, df: DataFrame, info: dict) -> None:
        columns = [c for c in {*info["not_null"], *info["primary_key"]} if c in df.columns]
        if not columns:
            return
        found = df.agg(*(F.count(F.when(F.col(quoted(c)).isNull(), 1)).alias(c) for c in columns)).first()
        for c in columns:
            if found[c]:
                raise ExecutionError(f"Column '{c}' cannot be null")

    @staticmethod
    def _once(df: DataFrame, keys: list[list[str]]) -> None:
        """Refuses rows that share a key; null in one of its columns makes a row unlike any other."""
        for key in keys:
            some = reduce(lambda a, b: a & b, (F.col(quoted(c)).isNotNull() for c in key))
            if not df.where(some).groupBy(*map(quoted, key)).count().where("count > 1").isEmpty():
                raise ExecutionError(f"Duplicate entry for key ({', '.join(key)})")

    def _unique(self, new: DataFrame, name: str, keys: list[list[str]]) -> None:
        self._once(new, keys)
        old = self.store.find(name)
        for key in keys:
            if not new.select(*map(quoted, key)).join(old.select(*map(quoted, key)), key, "left_semi").isEmpty():
                raise ExecutionError(f"Duplicate entry for key ({', '.join(key)})")

    def _without_known(self, new: DataFrame, name: str, keys: list[list[str]]) -> DataFrame:
        """INSERT IGNORE: none whose key is there, and of new rows with one key the first."""
        old = self.store.find(name)
        for key in keys:
            new = new.join(old.select(*map(quoted, key)), key, "left_anti")
        for key in keys:
            some = reduce(lambda a, b: a & b, (F.col(quoted(c)).isNotNull() for c in key))
            first = F.row_number().over(Window.partitionBy(*map(quoted, key)).orderBy("_at"))
            new = new.withColumn("_r", F.when(some, first).otherwise(1)).where("_r = 1").drop("_r")
        return new.select(*map(quoted, old.columns))

    def _upsert(self, q: dict, name: str, info: dict, schema: T.StructType, new: DataFrame, keys: list[list[str]], first: int | None, changes: dict) -> Written:
        """Rows one of whose keys is there (or earlier among the new ones) change the row that has it.

        New rows that meet in one row are folded into it in the order they came.
        """
        if not keys:
            raise ExecutionError("on_duplicate needs a primary or unique key")
        names, old = schema.fieldNames(), self._rows(name)
        known = schema.fieldNames()
        for c in q["on_duplicate"]:
            if c not in known:
                raise ExecutionError(f"Unknown column '{c}' in '{name}'")
        new = new.select("_at", F.struct(*map(quoted, names)).alias("_row"))
        for i, key in enumerate(keys):
            there = old.select(*(F.col(quoted(c)).alias(f"_k{j}") for j, c in enumerate(key)), F.struct(*ROW).alias(f"_hit{i}"))
            on = reduce(lambda a, b: a & b, (F.col("_row")[c] == F.col(f"_k{j}") for j, c in enumerate(key)))
            new = new.join(there, on, "left").drop(*(f"_k{j}" for j in range(len(key))))
        target, mine = F.coalesce(*(F.col(f"_hit{i}") for i in range(len(keys)))), [F.col("_row")[c] for c in keys[0]]
        whole = reduce(lambda a, b: a & b, (c.isNotNull() for c in mine))
        group = F.when(target.isNotNull(), F.to_json(target)).when(whole, F.to_json(F.struct(*(c.alias(f"k{j}") for j, c in enumerate(mine))))).otherwise(F.col("_at").cast("string"))
        met = new.select(group.alias("_group"), target.alias("_target"), "_at", "_row").groupBy("_group").agg(F.first("_target").alias("_target"), F.array_sort(F.collect_list(F.struct("_at", "_row"))).alias("_rows"))
        both = old.select(F.struct(*ROW).alias("_id"), F.struct(*map(quoted, names)).alias("_old")).join(met, F.col("_id") == F.col("_target"), "full_outer")
        values = {c: _given(v) for c, v in q["on_duplicate"].items()}

        def change(row: Column, entry: Column) -> Column:
            build = self.compiler.builder(_InRow(Node(name, name), schema, row, entry["_row"]))
            return F.struct(*((build.build(values[c]) if c in values else row[c]).cast(schema[c].dataType).alias(c) for c in names))

        is_old, is_new, n = F.col("_old").isNotNull(), F.col("_rows").isNotNull(), F.size("_rows")
        start = F.coalesce(F.col("_old"), F.col("_rows")[0]["_row"])
        todo = F.when(is_old, F.col("_rows")).otherwise(F.slice("_rows", F.lit(2), n))
        out = both.select(F.when(is_new, F.aggregate(todo, start, change)).otherwise(F.col("_old")).alias("_out"), F.when(~is_new, 0).when(is_old, 2 * n).otherwise(2 * n - 1).alias("_w"))
        path = self.store.write(out.select("_out.*", "_w"))
        done = self.spark.read.parquet(path)
        written = done.agg(F.sum("_w")).first()[0] or 0
        self._required(done.drop("_w"), info)
        self._once(done, keys)
        self.store.replace(name, path, **changes)
        return Written(int(written), first)

    # Update and delete.

    def _rows(self, name: str) -> DataFrame:
        df = self.store.find(name)
        if not self.store.info(name)["paths"]:
            return df.withColumn("_file", F.lit("")).withColumn("_place", F.lit(0).cast("long"))
        return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))

    def update(self, q: dict) -> Written:
        validate.update(q)
        name, schema, info = q["table"], self.store.schema(q["table"]), self.store.info(q["table"])
        for c in q["set"]:
            if c not in schema.fieldNames():
                raise ExecutionError(f"Unknown column '{c}' in '{name}'")
        elements = [*q["set"].values(), *([q["where"]] if q.get("where") else [])]
        base = Node(name, name)
        df, scope = self.compiler.joined(base, elements, frame=self._rows(name))
        build = self.compiler.builder(scope)
        hit = F.coalesce(build.predicate(q["where"]), F.lit(False)) if q.get("where") else F.lit(True)
        values = {c: build.build(v).cast(schema[c].dataType) for c, v in q["set"].items()}
        if len(scope.schemas) == 1 and q.get("limit") is None:
            out = df.select(*(F.when(hit, values[c]).otherwise(F.col(quoted(name, c))).alias(c) if c in values else F.col(quoted(name, c)).alias(c) for c in schema.fieldNames()), hit.alias("_hit"))
        else:
            fresh = df.where(hit).select(*(F.col(quoted(name, r)) for r in ROW), F.struct(*(v.alias(c) for c, v in values.items())).alias("_new"))
            fresh = fresh.dropDuplicates(ROW)  # a row is written once, however many rows it joins
            if q.get("limit") is not None:
                fresh = fresh.orderBy(*ROW).limit(int(q["limit"]))
            out = self._rows(name).join(fresh, ROW, "left").select(*(F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(quoted(c))).alias(c) if c in values else F.col(quoted(c)) for c in schema.fieldNames()), F.col("_new").isNotNull().alias("_hit"))
        path = self.store.write(out)
        done = self.spark.read.parquet(path)
        n = done.where("_hit").count()
        if any(c in q["set"] for c in {*info["not_null"], *info["primary_key"]}):
            self._required(done, info)
        self._once(done, [key for key in self._keys(info) if set(key) & set(q["set"])])
        self.store.replace(name, path)
        return Written(n)

    def delete(self, q: dict) -> Written:
        validate.delete(q)
        name = q["table"]
        orders = [(o.get("element", o.get("expression")), o.get("direction", "ASC")) for o in q.get("order_by") or ()]
        df, scope = self.compiler.joined(Node(name, name), [q["where"], *(e for e, _ in orders)], frame=self._rows(name))
        build = self.compiler.builder(scope)
        hit = F.coalesce(build.predicate(q["where"]), F.lit(False))
        if q.get("limit") is None and len(scope.schemas) == 1:
            seen = Observation()
            kept = df.observe(seen, F.count_if(hit).alias("n")).where(~hit).select(*(F.col(quoted(name, c)).alias(c) for c in self.store.schema(name).fieldNames()))
            self.store.replace(name, self.store.write(kept))
            return Written(int(seen.get["n"]))
        gone = df.where(hit)
        gone = gone.orderBy(*(build.ordered(e, d) for e, d in orders), *(F.col(quoted(name, r)) for r in ROW))
        gone = gone.select(*(F.col(quoted(name, r)) for r in ROW))
        gone = gone.limit(int(q["limit"])) if q.get("limit") is not None else gone.distinct()
        before = self.store.find(name).count()  # counts come from the files' footers
        path = self.store.write(self._rows(name).join(gone, ROW, "left_anti").drop(*ROW))
        after = self.spark.read.parquet(path).count()
        self.store.replace(name, path)
        return Written(before - after)


def _no_fields() -> Scope:
    return Scope(Node("", ""))


GIVEN = "values()"


def _given(e: Any) -> Any:
    """An element in which VALUES(field) is a field of the row that was to be inserted."""
    if isinstance(e, list):
        return [_given(x) for x in e]
    if not isinstance(e, dict):
        return e
    if e.get("type") == "fn" and str(e.get("function", "")).upper() == "VALUES":
        p = e["params"][0]
        return {"type": "fld", "table": GIVEN, "field": p["field"] if isinstance(p, dict) else p}
    return {k: _given(v) for k, v in e.items()}


class _InRow(Scope):
    """Fields of a row that is there, and of the one that was to be inserted."""

    def __init__(self, base: Node, schema: T.StructType, row: Column, given: Column) -> None:
        super().__init__(base)
        self.row, self.given = row, given
        self.nodes[GIVEN] = Node(GIVEN, GIVEN)
        self.schemas = {base.alias: schema, GIVEN: schema}

    def column(self, f: dict) -> Column:
        alias, name = self.locate(f)
        if name not in self.schemas[self.base.alias].fieldNames():
            raise CompileError(f"Unknown column '{name}'")
        return (self.given if alias == GIVEN else self.row)[name]
