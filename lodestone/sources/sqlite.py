"""SQLite tables, read in row-id ranges by a Python data source."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.plans.frame import Frame
from lodestone.types import kind_of

RANGE_ROWS = 65_536
_DECLARED = {"bool": "INTEGER", "int64": "INTEGER", "double": "REAL"}


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def _kind(declared: str) -> str:
    """By parts of the declared type, in this order: INT; REAL, FLOAT, DOUBLE, NUMERIC; BOOL; else text."""
    declared = declared.upper()
    if "INT" in declared:
        return "bigint"
    if any(x in declared for x in ("REAL", "FLOAT", "DOUBLE", "NUMERIC")):
        return "double"
    return "boolean" if "BOOL" in declared else "string"


def _open(path: str) -> sqlite3.Connection:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        con.execute("SELECT count(*) FROM sqlite_master")
    except sqlite3.DatabaseError as e:
        raise ValueError(f"not a SQLite database: {path}") from e
    return con


def _columns(path: str, table: str) -> list[tuple[str, str]]:
    con = _open(path)
    try:
        found = con.execute(f"PRAGMA table_info({_name(table)})").fetchall()
    finally:
        con.close()
    if not found:
        raise ValueError(f"table not found: {table}")
    return [(r[1], _kind(r[2] or "")) for r in found]


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, rows: int):
        self.path, self.table, self.rows = path, table, rows
        self.columns = _columns(path, table)

    def partitions(self) -> list[_Range]:
        con = _open(self.path)
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
        finally:
            con.close()
        if low is None:
            return [_Range(0, -1)]
        return [_Range(i, min(i + self.rows - 1, high)) for i in range(low, high + 1, self.rows)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        convert = {"bigint": int, "double": float, "boolean": bool, "string": str}
        made = [convert[kind] for _, kind in self.columns]
        con = _open(self.path)
        try:
            names = ", ".join(_name(n) for n, _ in self.columns)
            sql = f"SELECT {names} FROM {_name(self.table)} WHERE rowid BETWEEN ? AND ? ORDER BY rowid"
            for row in con.execute(sql, (partition.first, partition.last)):
                yield tuple(None if v is None else f(v) for f, v in zip(made, row, strict=True))
        finally:
            con.close()


class SqliteSource(DataSource):
    """options: path, table, rows (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_sqlite"

    def schema(self) -> str:
        return ", ".join(f"`{n}` {k}" for n, k in _columns(self.options["path"], self.options["table"]))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], int(self.options.get("rows", RANGE_ROWS)))


def read_sqlite(spark: SparkSession, path: str, table: str, batch_size: int = RANGE_ROWS) -> Frame:
    """A table of a database file that driver and executors can open."""
    _columns(path, table)
    spark.dataSource.register(SqliteSource)
    df = spark.read.format(SqliteSource.name()).options(path=path, table=table, rows=batch_size).load()
    return Frame.of(df)


def write_sqlite(frame: Frame, path: str, table: str) -> None:
    """A new database file with one table; rows pass through the driver one by one."""
    df = frame.to_df()
    temp = f"{path}.writing"
    if os.path.exists(temp):
        os.remove(temp)
    con = sqlite3.connect(temp)
    try:
        made = ", ".join(f"{_name(f.name)} {_DECLARED.get(kind_of(f.dataType), 'TEXT')}" for f in df.schema.fields)
        con.execute(f"CREATE TABLE {_name(table)} ({made})")
        marks = ", ".join("?" * len(df.columns))
        plain = (int, float, str, bool, type(None))
        rows = (tuple(v if isinstance(v, plain) else str(v) for v in r) for r in df.toLocalIterator(True))
        con.executemany(f"INSERT INTO {_name(table)} VALUES ({marks})", rows)
        con.commit()
    finally:
        con.close()
    os.replace(temp, path)
