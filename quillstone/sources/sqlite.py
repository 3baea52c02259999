"""SQLite as a source and a sink, through the Python data source interface and the standard library."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quillstone.config import FIELDS
from quillstone.errors import DatabaseError
from quillstone.schema import STORED

_KINDS = {"long": "INTEGER", "integer": "INTEGER", "double": "REAL", "string": "TEXT"}


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.path, self.table = options["path"], options.get("table", "invoice_headers")
        self.parts = int(options.get("partitions", 8))

    def partitions(self) -> list[_Range]:
        with sqlite3.connect(self.path) as c:
            low, high = c.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.table}"').fetchone()
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(i, min(i + step - 1, high)) for i in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with sqlite3.connect(self.path) as c:
            yield from c.execute(f'SELECT {", ".join(self.names)} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """``spark.read.format("quillstone_sqlite").option("table", ...).load(path)``; the file must be readable by all workers."""

    @classmethod
    def name(cls) -> str:
        return "quillstone_sqlite"

    def schema(self) -> StructType:
        return STORED

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def read(spark: SparkSession, path: str, table: str = "invoice_headers", schema: StructType = STORED) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("quillstone_sqlite").schema(schema).option("table", table).load(path)


def create(path: str, table: str = "invoice_headers", create_if_not_exists: bool = True) -> None:
    """The store's table, with its uniqueness rule and indexes."""
    columns = ["id INTEGER PRIMARY KEY AUTOINCREMENT"]
    columns += [f"{f.name} {_KINDS[f.dataType.typeName()]}" + (" DEFAULT CURRENT_TIMESTAMP" if f.name == "created_at" else "") for f in STORED if f.name != "id"]
    with sqlite3.connect(path) as c:
        there = c.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone()
        if not there and not create_if_not_exists:
            raise DatabaseError("open", f"no table {table}")
        c.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({", ".join(columns)}, UNIQUE (invoice_number, vendor_name) ON CONFLICT IGNORE)')
        for f in ("invoice_number", "vendor_name"):
            c.execute(f'CREATE INDEX IF NOT EXISTS "idx_{table}_{f}" ON "{table}" ({f})')


def append(rows: DataFrame, path: str, table: str = "invoice_headers", batch: int = 1000) -> int:
    """Streams admitted rows into the table in one transaction; the number that entered."""
    create(path, table)
    names = [f for f in STORED.fieldNames() if f in rows.columns and f != "id"]
    sql = f'INSERT INTO "{table}" ({", ".join(names)}) VALUES ({", ".join("?" * len(names))})'
    held: list[tuple] = []
    try:
        with sqlite3.connect(path) as c:
            before = c.total_changes
            for r in rows.select(*names).toLocalIterator():
                held.append(tuple(r))
                if len(held) >= batch:
                    c.executemany(sql, held)
                    held.clear()
            c.executemany(sql, held)
            return c.total_changes - before
    except sqlite3.Error as e:
        raise DatabaseError("insert", str(e)) from e


def delete(path: str, number: str, table: str = "invoice_headers") -> bool:
    """Whether any row had the number."""
    with sqlite3.connect(path) as c:
        return c.execute(f'DELETE FROM "{table}" WHERE invoice_number = ?', (number,)).rowcount > 0


__all__ = ["FIELDS", "SqliteSource", "append", "create", "delete", "read"]
