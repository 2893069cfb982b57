"""A database: tables and maintained views in one folder, and the dialect over them."""

from __future__ import annotations

import csv
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.plans.lower import Lowering, Source, key_bounds, lower
from tidewater.plans.parse import CreateTable, Delete, Insert, Null, Num, Refused, Select, Str, Update, parse
from tidewater.plans.views import View, sealed, unsealed
from tidewater.sources.fs import Folder
from tidewater.sources.store import Store
from tidewater.udf import ColumnFunction, WindowFunction


class Database:
    """One writer, any readers. The writer holds a lock file in the folder; a reader sees what is published when it opens or refreshes."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False, sync: str = "full"):
        """sync: when single rows are safe against the loss of the driver: "full" (when append returns), "group" (within GROUP_MS) or "off" (when they are flushed)."""
        self.spark, self.folder, self.read_only, self.sync = spark, Folder(spark, path), read_only, sync
        self.windows: dict[str, dict] = {}
        self.kernels: dict[str, dict] = {}
        self.folder.make()
        if not read_only:
            try:
                self.folder.claim("writer.lock", json.dumps({"pid": os.getpid()}))
            except FileExistsError:
                raise Refused(f"{path} has a writer already; open it with read_only=True, or remove writer.lock if that writer is gone") from None
        self.tables: dict[str, Store] = {}
        self.views: dict[str, View] = {}
        self.refresh()

    def close(self) -> None:
        if not self.read_only:
            self.flush()
            self.folder.remove("writer.lock")

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def refresh(self) -> None:
        """Takes up what another process has published."""
        for name in self.folder.names("table-"):
            name = name.removeprefix("table-")
            if name in self.tables:
                self.tables[name].refresh()
            else:
                self.tables[name] = Store.open(self.spark, self.folder.at(f"table-{name}"), self.read_only, self.sync)
        for file in self.folder.names("view-"):
            name = file.removeprefix("view-").removesuffix(".json")
            record = unsealed(self.folder.read(file), name)
            mat = Store.open(self.spark, self.folder.at("views", name), self.read_only) if record["stamp"] else None
            self.views[name] = View(self, name, record["sql"], mat, record)

    def names(self) -> list[str]:
        return sorted([*self.tables, *self.views])

    def schema(self, name: str) -> list[tuple[str, str, bool]]:
        return self.table(name).columns

    def table(self, name: str) -> Store:
        if name in self.views:
            raise Refused(f"{name} is a view")
        if name not in self.tables:
            raise Refused(f"no table {name}")
        return self.tables[name]

    # statements
    def create_table(self, sql: str) -> Store:
        s = parse(sql)
        if not isinstance(s, CreateTable):
            raise Refused("a CREATE TABLE statement is expected")
        if s.table in self.tables or s.table in self.views:
            raise Refused(f"{s.table} exists")
        self.tables[s.table] = Store.create(self.spark, self.folder.at(f"table-{s.table}"), s.columns, s.key, self.sync)
        return self.tables[s.table]

    def _source(self, s: Select) -> Callable[[str], Source]:
        def of(name: str) -> Source:
            if name in self.views:
                if s.join is not None:
                    raise Refused(f"{name} is a view: a join is over tables")
                view = self.views[name]
                return view.source(s.as_of, key_bounds(s.where, view.shown_key(), s.alias))
            t = self.table(name)
            keys = key_bounds(s.where, t.key, s.alias) if s.join is None else None  # files with no such key aren't opened
            return Source(t.frame(s.as_of, keys=keys).drop("_rid"), t.key, self.windows.get(name, {}), self.kernels.get(name, {}))

        return of

    def query(self, sql: str) -> DataFrame:
        s = parse(sql)
        if not isinstance(s, Select):
            raise Refused("a SELECT is expected")
        if s.table in self.views and any(getattr(i.expr, "name", None) == "_seq" for i in s.items):
            raise Refused("a view has no _seq")
        return lower(s, self._source(s))

    def query_arrow(self, sql: str):
        return self.query(sql).toArrow()

    def mutate(self, sql: str) -> int:
        """INSERT, UPDATE or DELETE; returns how many rows it touched."""
        s = parse(sql)
        if not isinstance(s, (Insert, Update, Delete)):
            raise Refused("INSERT, UPDATE or DELETE is expected")
        t = self.table(s.table)
        if isinstance(s, Insert):
            names = t.schema.fieldNames()
            columns = s.columns or names
            unknown = [c for c in columns if c not in names]
            if unknown or len(set(columns)) < len(columns):
                raise Refused(f"no column {unknown[0]}" if unknown else "a column is listed twice")
            rows = []
            for r in s.rows:
                if len(r) != len(columns):
                    raise Refused(f"{len(columns)} values are expected, not {len(r)}")
                rows.append(dict(zip(columns, map(value_of, r), strict=True)))
            t.append_rows(rows)
            return len(rows)
        src = Source(t.frame(), t.key)
        low = Lowering(Select(s.table, s.table, []), lambda _: src)
        low.kinds = src.kinds
        where = low.predicate(s.where) if s.where is not None else None
        if isinstance(s, Delete):
            return t.delete(where)
        return t.update({c: value_of(v) for c, v in s.sets}, where)

    def execute(self, sql: str):
        s = parse(sql)
        if isinstance(s, Select):
            return self.query(sql)
        if isinstance(s, CreateTable):
            return self.create_table(sql)
        return self.mutate(sql)

    def append(self, table: str, row) -> int:
        return self.table(table).append(row)

    def append_arrow(self, table: str, batch, order: list[str] | None = None) -> int:
        """Rows of a pyarrow Table, in the order of ``order`` (default: the ordering key)."""
        return self.table(table).append_frame(self.spark.createDataFrame(batch), order)

    def flush(self) -> None:
        for t in self.tables.values():
            t.flush()

    def compact(self, name: str) -> None:
        if name in self.views:
            if self.views[name].mat is not None:
                self.views[name].mat.compact()
            return
        self.table(name).compact()

    def vacuum(self, name: str, keep: int = 1) -> int:
        """Removes files that none of the last ``keep`` versions of a table or view names."""
        store = self.views[name].mat if name in self.views else self.table(name)
        return 0 if store is None else store.vacuum(keep)

    def next_sequence(self, table: str) -> int:
        return self.table(table).next_sequence()

    def reader(self, table: str) -> Callable[[str], DataFrame]:
        """A function for SELECTs on the table as it is now, whatever is written later."""
        t = self.table(table)
        t.flush() if not self.read_only else None
        src = Source(t.frame(manifest=t._copy()).drop("_rid"), t.key, dict(self.windows.get(table, {})), dict(self.kernels.get(table, {})))

        def read(sql: str) -> DataFrame:
            s = parse(sql)
            if not isinstance(s, Select) or s.table != table or s.join or s.as_of is not None:
                raise Refused(f"a reader takes a SELECT from {table}")
            return lower(s, lambda _: src)

        return read

    def import_csv(self, path: str, table: str) -> int:
        """Header names are columns; an empty cell is null; values are read by the column's type, and one that doesn't fit fails the import."""
        t = self.table(table)
        header = self.spark.read.text(path).first()
        names = next(csv.reader([header[0]])) if header else []
        if len(set(names)) < len(names):
            raise Refused("the header names a column twice")
        unknown = [n for n in names if n not in t.schema.fieldNames()]
        if unknown or not names:
            raise Refused(f"no column {unknown[0]}" if unknown else "the file is empty")
        kinds = {f.name: f for f in t.schema.fields}
        schema = type(t.schema)([type(kinds[n])(n, kinds[n].dataType, True) for n in names])
        df = self.spark.read.csv(path, header=True, schema=schema, enforceSchema=False, mode="FAILFAST", nullValue="", emptyValue="")
        return t.append_frame(df, [t.key])

    # views
    def create_materialized_view(self, name: str, sql: str) -> View:
        if name in self.tables or name in self.views:
            raise Refused(f"{name} exists")
        if self.read_only:
            raise Refused("the database is open for reading only")
        view = View(self, name, sql)
        view.fold(None) if view.width else None  # refuses what can't be lowered
        self.views[name] = view
        self.folder.write(f"view-{name}.json", sealed(view.record))
        return view

    def refresh_view(self, name: str, rebuild: bool = False) -> int | None:
        if name not in self.views:
            raise Refused(f"no view {name}")
        return self.views[name].refresh(rebuild)

    # functions
    def register_window(self, table: str, name: str, fn: Callable, arity: int = 1, output: str = "double", frames: bool = False) -> None:
        """frames: fn takes all frames of a run of rows in one call."""
        self.table(table)
        self.windows.setdefault(table, {})[name.lower()] = WindowFunction(fn, arity, output, frames)

    def register_column(self, table: str, name: str, fn: Callable, arity: int = 1, ordered: bool = True, partition: tuple[str, ...] = ()) -> None:
        self.table(table)
        self.kernels.setdefault(table, {})[name.lower()] = ColumnFunction(fn, arity, ordered, tuple(partition))

    def run_script(self, script: Callable[[Database], object]) -> object:
        """A Python function that gets the database; what it appends is flushed at the end."""
        out = script(self)
        self.flush()
        return out


def value_of(e):
    if isinstance(e, Null):
        return None
    if isinstance(e, Str):
        return e.value
    assert isinstance(e, Num)
    return int(e.text) if e.text.lstrip("-").isdigit() else float(e.text)

