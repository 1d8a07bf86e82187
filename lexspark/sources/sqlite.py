"""SQLite files as a Spark data source: schema from the catalogue, parts by key ranges, filters pushed into the queries.

    spark.dataSource.register(SQLite)
    spark.read.format("lexspark_sqlite").option("path", file).option("dbtable", table).option("parts", 8).load()

Every part reads its own range of row ids, or, in a table WITHOUT ROWID, of its primary key; views are one part.  Comparisons and null
tests of typed columns run inside SQLite, which also uses its indexes; Spark keeps all other filters.  A schema given to the reader chooses
columns.  The file is opened for reading only and must be where driver and executors see it.

SQLite keeps any value in any column.  Here a whole number in a real or text column is converted; any other value that is
not of its column's type ends the job with an error that names the column.
"""

from __future__ import annotations

import contextlib
import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

ROWS = 10_000
_COMPARE = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path.removeprefix('file://'))}?mode=ro", uri=True)


def column_type(declared: str) -> T.DataType:
    """By SQLite's rules of affinity; numeric ones are doubles, columns without a type are bytes or text, so text."""
    d = declared.upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")) or not d:
        return T.StringType()
    return T.BinaryType() if "BLOB" in d else T.DoubleType()


@dataclass
class Table:
    columns: list[tuple[str, str]]  # name, declared type
    key: list[str]
    rowid: bool
    view: bool


def table_info(db: sqlite3.Connection, name: str) -> Table:
    found = db.execute("SELECT type, coalesce(sql, '') FROM sqlite_master WHERE name = ? COLLATE NOCASE AND type IN ('table', 'view')", (name,)).fetchone()
    if found is None:
        raise ValueError(f"no such table: {name}")
    rows = db.execute(f"PRAGMA table_info({quoted(name)})").fetchall()
    key = [r[1] for r in sorted((r for r in rows if r[5]), key=lambda r: r[5])]
    listed = db.execute("SELECT wr FROM pragma_table_list WHERE name = ? COLLATE NOCASE AND schema = 'main'", (name,)).fetchone()
    return Table([(r[1], r[2]) for r in rows], key, not (listed and listed[0]) and found[0] == "table", found[0] == "view")


class SQLite(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "lexspark_sqlite"

    def schema(self) -> T.StructType:
        with contextlib.closing(connect(self.options["path"])) as db:
            return T.StructType([T.StructField(n, column_type(d)) for n, d in table_info(db, self.options["dbtable"]).columns])

    def reader(self, schema: T.StructType) -> SQLiteReader:
        return SQLiteReader(self.options["path"], self.options["dbtable"], int(self.options.get("parts", "8")), schema)


@dataclass
class Range(ds.InputPartition):
    """Rows whose key is at least low and below high; None is no bound."""

    column: str | None
    low: object = None
    high: object = None


class SQLiteReader(ds.DataSourceReader):
    def __init__(self, path: str, table: str, parts: int, schema: T.StructType) -> None:
        self.path, self.table, self.parts, self.fields = path, table, max(1, parts), schema
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        with contextlib.closing(connect(self.path)) as db:
            declared = dict(table_info(db, self.table).columns)
        for f in filters:
            test = self._sql(f, declared)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def _sql(self, f: ds.Filter, declared: dict[str, str]) -> tuple[str, tuple] | None:
        inner = f.child if isinstance(f, ds.Not) else f
        path = getattr(inner, "attribute", ())
        if len(path) != 1 or path[0] not in declared:
            return None
        column, kind = quoted(path[0]), column_type(declared[path[0]])
        if isinstance(inner, (ds.IsNull, ds.IsNotNull)):
            sql, values = f"{column} IS {'NOT ' * isinstance(inner, ds.IsNotNull)}NULL", ()
        else:
            values = tuple(inner.value) if isinstance(inner, ds.In) else (getattr(inner, "value", None),)
            wanted = (str,) if isinstance(kind, T.StringType) and declared[path[0]] else (int, float) if isinstance(kind, (T.LongType, T.DoubleType)) else ()
            # Whole numbers beyond 64 bits, NaN and values of another type are left to Spark.
            if not values or not all(isinstance(v, wanted) and not isinstance(v, bool) and v == v and (isinstance(v, (str, float)) or abs(v) < 1 << 63) for v in values):
                return None
            column += " COLLATE BINARY"
            if isinstance(inner, ds.In):
                sql = f"{column} IN ({', '.join('?' * len(values))})"
            elif type(inner) in _COMPARE:
                sql = f"{column} {_COMPARE[type(inner)]} ?"
            else:
                return None
        return (f"NOT ({sql})" if isinstance(f, ds.Not) else sql), values

    def partitions(self) -> list[Range]:
        with contextlib.closing(connect(self.path)) as db:
            info, table = table_info(db, self.table), quoted(self.table)
            if info.view or not (info.rowid or info.key):
                return [Range(None)]
            if info.rowid:
                names = {c.lower() for c, _ in info.columns}
                column = next((c for c in ("rowid", "_rowid_", "oid") if c not in names), None)
                if column is None:  # all names of the row id are columns
                    return [Range(None)]
                low, high = db.execute(f"SELECT min({column}), max({column}) FROM {table}").fetchone()
                if low is None:
                    return [Range(None)]
                step = max(1, -(-(high - low + 1) // self.parts))
                cuts = list(range(low + step, high + 1, step))
            else:
                column = quoted(info.key[0]) + " COLLATE BINARY"
                n = db.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
                at = sorted({k * n // self.parts for k in range(1, self.parts)} - {0})
                found = [db.execute(f"SELECT {quoted(info.key[0])} FROM {table} ORDER BY {column} LIMIT 1 OFFSET ?", (k,)).fetchone()[0] for k in at]
                cuts = list(dict.fromkeys(found))
        return [Range(column, a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        tests = list(self.tests)
        if partition.low is not None:
            tests.append((f"{partition.column} >= ?", (partition.low,)))
        if partition.high is not None:
            tests.append((f"{partition.column} < ?", (partition.high,)))
        where = " AND ".join(f"({sql})" for sql, _ in tests) or "1"
        names, kinds = self.fields.fieldNames(), [f.dataType for f in self.fields.fields]
        arrow = [{T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BinaryType: pa.binary()}.get(type(k), pa.string()) for k in kinds]
        with contextlib.closing(connect(self.path)) as db:
            rows = db.execute(f"SELECT {', '.join(map(quoted, names)) or '1'} FROM {quoted(self.table)} WHERE {where}", [v for _, values in tests for v in values])
            while some := rows.fetchmany(ROWS):
                columns = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([_value(v, k, n) for v in c], a) for c, k, n, a in zip(columns, kinds, names, arrow, strict=False)], names=names)


def _value(v: object, kind: T.DataType, name: str) -> object:
    if v is None or isinstance(kind, T.LongType) and isinstance(v, int) or isinstance(kind, T.BinaryType) and isinstance(v, bytes):
        return v
    if isinstance(kind, T.DoubleType) and isinstance(v, (int, float)):
        return float(v)
    if isinstance(kind, T.StringType) and isinstance(v, (str, int, float)):
        return str(v)
    if isinstance(kind, T.BinaryType) and isinstance(v, str):
        return v.encode()
    raise ValueError(f"column {name} holds {type(v).__name__}, not {kind.simpleString()}")


def read_table(spark: SparkSession, path: str, table: str, parts: int = 8, schema: str | None = None) -> DataFrame:
    """A table or view; filters of typed columns are pushed."""
    spark.dataSource.register(SQLite)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("lexspark_sqlite").option("path", path).option("dbtable", table).option("parts", str(parts))
    return (reader.schema(schema) if schema else reader).load()


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(table, kind, name, detail): columns with types and key positions, references and indexes of every table and view."""
    rows = []
    with contextlib.closing(connect(path)) as db:
        for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name").fetchall():
            for _, column, kind, not_null, _, key in db.execute(f"PRAGMA table_info({quoted(name)})"):
                rows.append((name, "column", column, ", ".join(filter(None, [kind, "not null" * bool(not_null), f"key {key}" * bool(key)]))))
            for _, _, to, column, target, *_ in db.execute(f"PRAGMA foreign_key_list({quoted(name)})"):
                rows.append((name, "reference", column, f"{to}({target})" if target else to))
            for _, index, unique, *_ in db.execute(f"PRAGMA index_list({quoted(name)})").fetchall():
                columns = [r[2] or "expression" for r in db.execute(f"PRAGMA index_info({quoted(index)})")]
                rows.append((name, "unique index" if unique else "index", index, ", ".join(columns)))
    return spark.createDataFrame(rows, "table string, kind string, name string, detail string")
