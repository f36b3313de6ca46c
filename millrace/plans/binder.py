"""Binds a SELECT tree to a DataFrame: names, types, aggregates and output names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import BindError
from millrace.functions import registry as r
from millrace.operators.relational import range_rows
from millrace.plans import tree as t


@dataclass
class Source:
    """A table of FROM: its name, rows and, for keyed tables, the key column."""

    name: str | None
    rows: DataFrame
    key: str | None = None


@dataclass
class _Column:
    table: str | None
    name: str
    inner: str
    kind: str
    boolean: bool
    wide: bool

    def typed(self) -> r.Typed:
        column = F.col(self.inner)
        return r.Typed(column.cast("double") if self.kind == "DOUBLE" else column, self.kind, self.name, "row", self.boolean, self.wide)


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.IntegralType, T.BooleanType)):
        return "INT"
    if isinstance(data_type, (T.FractionalType)):
        return "DOUBLE"
    return {T.StringType: "STRING", T.NullType: "NULL"}.get(type(data_type), "OTHER")


def width(node) -> str:
    """How many values an expression has: const, row or one (see Typed)."""
    if isinstance(node, t.Literal):
        return "const"
    if isinstance(node, t.Call):
        if node.name in r.AGGREGATES and not node.operator:
            return "one"
        widths = {width(a) for a in node.args}
        return "row" if "row" in widths else "one" if "one" in widths else "const"
    return "row"


class Binder:
    """lookup: table name -> Source."""

    def __init__(self, spark: SparkSession, lookup: Callable[[str], Source]):
        self.spark, self.lookup = spark, lookup

    def select(self, node: t.Select, ordered: bool = False) -> DataFrame:
        """The result of a SELECT.  ordered: rows of a single keyed table come in the order of its key."""
        rows, columns, key = self._scope(node)
        if node.where is not None:
            rows = rows.where(self.expression(node.where, columns, rows).truth)
        items = [x for item in node.items for x in self._expanded(item, columns)]
        widths = [width(i) for i in items]
        if "one" in widths and "row" not in widths:
            found = [self.expression(i, columns, rows, whole=True) for i in items]
            out = rows.agg(*[x.number.alias(f"c{k}") for k, x in enumerate(found)])
        else:
            found = [self.expression(i, columns, rows) for i in items]
            if ordered and key:
                rows = rows.orderBy(key)
            out = rows.select(*[x.number.alias(f"c{k}") for k, x in enumerate(found)])
        return out.toDF(*[x.name for x in found])

    def condition(self, node, source: Source) -> tuple[DataFrame, object]:
        """The rows of a table, and a condition on them as a column."""
        rows, columns, _ = self._combined([source])
        return rows, self.expression(node, columns, rows).truth

    def values(self, node) -> r.Typed:
        """A literal expression, without any table."""
        if width(node) != "const":
            raise BindError("VALUES takes constants")
        return self.expression(node, [], self.spark.range(1))

    # --- FROM ---

    def _scope(self, node: t.Select) -> tuple[DataFrame, list[_Column], str | None]:
        if node.subquery is not None:
            return self._combined([Source(None, self.select(node.subquery))])
        if node.range is not None:
            return self._combined([Source("range", range_rows(self.spark, *self._range(node.range.args)))])
        if node.tables:
            return self._combined([self.lookup(name) for name in node.tables])
        return self.spark.range(1), [], None

    @staticmethod
    def _range(args: tuple[int, ...]) -> tuple[int, ...]:
        if not 2 <= len(args) <= 3:
            raise BindError(f"range takes a start, a stop and perhaps a step, not {len(args)} values")
        if len(args) == 3 and args[2] == 0:
            raise BindError("a range never ends with step 0")
        return args

    def _combined(self, sources: list[Source]) -> tuple[DataFrame, list[_Column], str | None]:
        rows, columns = None, []
        for k, source in enumerate(sources):
            fields = source.rows.schema.fields
            inner = [f"__{k}_{j}" for j in range(len(fields))]
            for name, f in zip(inner, fields, strict=True):
                columns.append(_Column(source.name, f.name, name, kind_of(f.dataType), isinstance(f.dataType, T.BooleanType), isinstance(f.dataType, T.LongType)))
            renamed = source.rows.toDF(*inner)
            rows = renamed if rows is None else rows.crossJoin(renamed)  # conditions of WHERE make it a join
        key = None
        if len(sources) == 1 and sources[0].key:
            key = next(c.inner for c in columns if c.name == sources[0].key)
        return rows, columns, key

    # --- expressions ---

    @staticmethod
    def _expanded(item, columns: list[_Column]) -> list:
        if not isinstance(item, t.Star):
            return [item]
        if item.table is not None and item.table not in {c.table for c in columns}:
            raise BindError(f"FROM names no table {item.table}")
        chosen = [c for c in columns if item.table in (None, c.table)]
        if not chosen:
            raise BindError("* needs a table")
        return [_Known(c) for c in chosen]

    @staticmethod
    def _resolved(node: t.Name, columns: list[_Column]) -> _Column:
        if node.table is not None and node.table not in {c.table for c in columns}:
            raise BindError(f"FROM names no table {node.table}")
        found = [c for c in columns if c.name == node.column and node.table in (None, c.table)]
        if not found:
            raise BindError(f"no column {node.column} in {node.table or 'FROM'}")
        if len(found) > 1:
            raise BindError(f"column {node.column} is ambiguous")
        return found[0]

    def expression(self, node, columns: list[_Column], rows: DataFrame, whole: bool = False) -> r.Typed:
        """whole: aggregates stand as such, for ``agg``; else each is a scalar subquery over ``rows``."""
        if isinstance(node, _Known):
            return node.column.typed()
        if isinstance(node, t.Name):
            return self._resolved(node, columns).typed()
        if isinstance(node, t.Star):
            raise BindError("* is no value")
        if isinstance(node, t.Literal):
            if node.kind == "NULL":
                return r.Typed(F.lit(None), "NULL", "NULL")
            text = f"{node.value:.6f}" if node.kind == "DOUBLE" else str(node.value)
            value = F.lit(node.value) if node.kind == "STRING" else F.lit(node.value).cast("int" if node.kind == "INT" else "double")
            return r.Typed(value, node.kind, text)
        if node.operator:
            return r.operator(node.name, *[self.expression(a, columns, rows, whole) for a in node.args])
        if node.name in r.AGGREGATES:
            return self._aggregate(node, columns, rows, whole)
        if node.name not in r.SCALARS:
            raise BindError(f"there is no function {node.name}")
        return r.scalar(node.name, [self.expression(a, columns, rows, whole) for a in node.args])

    def _aggregate(self, node: t.Call, columns: list[_Column], rows: DataFrame, whole: bool) -> r.Typed:
        if len(node.args) != 1:
            raise BindError(f"{node.name} takes one argument")
        of_one = width(node.args[0]) == "one"
        found = r.aggregate(node.name, self.expression(node.args[0], columns, rows, whole and of_one))
        if not whole and not of_one:
            found.column = rows.agg(found.column.alias("v")).scalar()
        return found


@dataclass(frozen=True)
class _Known:
    """A column that * stands for."""

    column: _Column
