"""A session: databases of keyed tables, attached Parquet tables, and ``sql``."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from millrace import errors as e
from millrace.functions.registry import Typed
from millrace.operators.relational import one_row
from millrace.plans import tree as t
from millrace.plans.binder import Binder, Source, kind_of
from millrace.plans.parser import parse
from millrace.sources.files import Files
from millrace.sources.keyed import SPARK_TYPES, KeyedTable, versions

_PLAIN = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*\Z")


class Session:
    """root: URI or path of the folder that holds the databases, one folder each."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = Files(root) if root else None
        self.database: str | None = None
        self.attached: dict[str, DataFrame | str] = {}
        self._open: dict[tuple[str, str], KeyedTable] = {}

    def attach(self, name: str, rows: DataFrame) -> Session:
        """Make a DataFrame readable as a table; it keeps its Spark types and can't be written."""
        self.attached[name] = rows
        return self

    def attach_parquet(self, folder: str, *names: str) -> Session:
        """Attach Parquet tables of a folder; a file is opened when a statement first names its table."""
        self.attached |= {name: f"{folder}/{name}.parquet" for name in names}
        return self

    def rows(self, name: str) -> DataFrame:
        """An attached table."""
        found = self.attached[name]
        if isinstance(found, str):
            found = self.attached[name] = self.spark.read.parquet(found)
        return found

    # --- statements ---

    def sql(self, text: str, ordered: bool = False) -> DataFrame | None:
        """Run one statement.

        Rows of SELECT are lazy: Spark raises its errors when they are read (``run`` reads
        them).  INSERT and DELETE give a row with their count, SHOW its names, others None.
        """
        statement = parse(text)
        binder = Binder(self.spark, self._source)
        if isinstance(statement, t.Select):
            return binder.select(statement, ordered)
        return _HANDLERS[type(statement)](self, statement, binder)

    def run(self, text: str) -> tuple[list[str], list[tuple]]:
        """Run one statement to its end: column names and rows; any failure is an EngineError."""
        try:
            found = self.sql(text, ordered=True)
            return (found.columns, [tuple(r) for r in found.collect()]) if found is not None else ([], [])
        except PySparkException as error:
            raise e.ExecutionError(str(error).split("\n")[0]) from error
        except OSError as error:
            raise e.IOError_(str(error)) from error

    # --- catalog ---

    def _folder(self) -> Files:
        if self.root is None:
            raise e.NotChoiceDatabase("the session has no folder for databases")
        return self.root

    def _current(self) -> Files:
        if self.database is None:
            raise e.NotChoiceDatabase("USE a database first")
        return self._folder() / self.database

    def table(self, name: str) -> KeyedTable:
        """A keyed table of the current database, as committed last by any session."""
        folder = self._current()
        known = (self.database, name)
        if known not in self._open:
            self._open[known] = KeyedTable.open(self.spark, folder / name, name)
        return self._open[known].refresh()

    def _source(self, name: str) -> Source:
        if name in self.attached:
            return Source(name, self.rows(name))
        table = self.table(name)
        return Source(name, table.read(), table.manifest.key)

    def _create_database(self, s: t.CreateDatabase, _: Binder) -> None:
        if self._folder().exists(s.name):
            raise e.CreateError(f"there is a database {s.name} already")
        (self._folder() / s.name).make()

    def _create_table(self, s: t.CreateTable, _: Binder) -> None:
        folder = self._current() / s.name
        names = [n for n, _ in s.columns]
        kinds = [k.upper() for _, k in s.columns]
        if versions(folder):
            raise e.CreateError(f"there is a table {s.name} already")
        if unknown := [k for k in kinds if k not in SPARK_TYPES]:
            raise e.CreateError(f"unknown type {unknown[0]}")
        if len(set(names)) < len(names) or not all(map(_PLAIN.match, names)):
            raise e.CreateError("columns need different plain names")
        if s.key is None:
            raise e.CreateError("a table needs a UNIQUE KEY")
        if s.key not in names:
            raise e.CreateError(f"the key {s.key} is none of the columns")
        if kinds[names.index(s.key)] == "DOUBLE":
            raise e.CreateError("a DOUBLE can't be the key")
        made = KeyedTable.create(self.spark, folder, s.name, list(zip(names, kinds, strict=True)), s.key)
        if made is None:  # by another session since
            raise e.CreateError(f"there is a table {s.name} already")
        self._open[self.database, s.name] = made

    def _drop(self, s: t.Drop, _: Binder) -> None:
        if s.what == "DATABASE":
            if not self._folder().exists(s.name):
                raise e.DropError(f"there is no database {s.name}")
            self._folder().delete(s.name)
            self._open = {k: v for k, v in self._open.items() if k[0] != s.name}
            self.database = None if self.database == s.name else self.database
        else:
            if not versions(self._current() / s.name):
                raise e.DropError(f"there is no table {s.name}")
            self._current().delete(s.name)
            self._open.pop((self.database, s.name), None)

    def _use(self, s: t.Use, _: Binder) -> None:
        if not self._folder().exists(s.name):
            raise e.DatabaseNotExists(f"there is no database {s.name}")
        self.database = s.name

    def _show(self, s: t.Show, _: Binder) -> DataFrame:
        folder = self._folder() if s.what == "DATABASES" else self._current()
        return self.spark.createDataFrame([(n,) for n in folder.folders()], f"{s.what.title()} string")

    # --- writing ---

    def _insert(self, s: t.Insert, binder: Binder) -> DataFrame:
        table = self.table(s.table)
        kinds = [k for _, k in table.manifest.columns]
        if s.bulk is not None:
            n = table.put_generated(s.bulk)
        elif s.select is not None:
            rows = binder.select(s.select)
            if len(rows.columns) != len(kinds):
                raise e.InsertError(f"{len(rows.columns)} values for {len(kinds)} columns")
            for kind, field in zip(kinds, rows.schema.fields, strict=True):
                _assignable(kind_of(field.dataType), kind)
            n = table.put(rows.toDF(*[f"c{k}" for k in range(len(kinds))]))
        else:
            n = table.put_rows(self._tuples(s.tuples, table, binder))
        return one_row(self.spark, {"InsertRows": n})

    def _tuples(self, tuples: list[list], table: KeyedTable, binder: Binder) -> list[tuple]:
        kinds, key = [k for _, k in table.manifest.columns], table.names.index(table.manifest.key)
        bound: list[list[Typed | tuple]] = []
        for row in tuples:
            if len(row) != len(kinds):
                raise e.InsertError(f"{len(row)} values for {len(kinds)} columns")
            bound.append([_plain(x) if isinstance(x, t.Literal) else binder.values(x) for x in row])
        for row in bound:
            for kind, x in zip(kinds, row, strict=True):
                _assignable(x.kind if isinstance(x, Typed) else x[0], kind)
        computed = [x.number for row in bound for x in row if isinstance(x, Typed)]
        values = iter(self.spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(computed)]).first() if computed else ())
        out = [tuple(_as(kind, next(values) if isinstance(x, Typed) else x[1]) for kind, x in zip(kinds, row, strict=True)) for row in bound]
        if any(row[key] is None for row in out):
            raise e.InsertError(f"the key {table.manifest.key} is NULL")
        return out

    def _delete(self, s: t.Delete, binder: Binder) -> DataFrame:
        table = self.table(s.table)
        source = Source(s.table, table.read(), table.manifest.key)
        keys = source.rows.select(table.manifest.key)
        if s.where is not None:
            rows, condition = binder.condition(s.where, source)
            keys = rows.where(condition).select(f"__0_{table.names.index(table.manifest.key)}")
        return one_row(self.spark, {"DeleteRows": table.delete(keys)})

    def _flush(self, s: t.Flush, _: Binder) -> None:
        self.table(s.table).flush()

    def _explain(self, s: t.Explain, binder: Binder) -> DataFrame:
        plan = binder.select(s.select)._jdf.queryExecution().toString()
        return self.spark.createDataFrame([(line,) for line in plan.split("\n")], "Plan string")


def _plain(x: t.Literal) -> tuple:
    return x.kind, x.value


def _assignable(kind: str, to: str) -> None:
    if not (kind in (to, "NULL") or {kind, to} == {"INT", "DOUBLE"}):
        raise e.InsertError(f"a {kind} value can't go into a {to} column")


def _as(kind: str, value):
    if value is None:
        return None
    if kind == "INT":
        if not -(1 << 31) <= int(value) < 1 << 31:
            raise e.InsertError(f"{value} is out of the range of INT")
        return int(value)
    return float(value) if kind == "DOUBLE" else value


_HANDLERS: dict[type, Callable] = {
    t.CreateDatabase: Session._create_database,
    t.CreateTable: Session._create_table,
    t.Drop: Session._drop,
    t.Use: Session._use,
    t.Show: Session._show,
    t.Insert: Session._insert,
    t.Delete: Session._delete,
    t.Flush: Session._flush,
    t.Explain: Session._explain,
}
