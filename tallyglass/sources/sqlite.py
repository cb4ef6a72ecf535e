"""A Spark data source for SQLite files.

    spark.dataSource.register(SQLiteSource)
    spark.read.format("sqlite").options(path=..., table=...).load()

The file must be readable on every executor. It is opened read-only. A table with row ids is read in `partitions`
ranges of them (4 by default). Filters stay with Spark: filters handed to a Python source are remembered by the relation,
so a view that is read with a filter once would be read with it again where another query has none.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from tallyglass.sources.tables import quoted

def _open(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{quote(path.removeprefix('file://'))}?mode=ro", uri=True)
    con.text_factory = lambda raw: raw.decode("utf-8", "ignore")
    return con


def _name(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


def spark_type(declared: str):
    """By the rules of type affinity: INT, then text, blob, real; NUMERIC and others are doubles."""
    d = declared.upper()
    if "INT" in d:
        return LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT", "DATE", "TIME")):
        return StringType()
    if "BLOB" in d:
        return BinaryType()
    return DoubleType()


class Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SQLiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        con = _open(self.options["path"])
        try:
            columns = con.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        finally:
            con.close()
        if not columns:
            raise ValueError(f"no table {self.options['table']!r} in {self.options['path']}")
        return StructType([StructField(c[1], spark_type(c[2])) for c in columns])

    def reader(self, schema: StructType) -> SQLiteReader:
        return SQLiteReader(self.options, schema)


class SQLiteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.count = options["path"], options["table"], int(options.get("partitions", 4))
        self.schema = schema

    def partitions(self) -> list[InputPartition]:
        con = _open(self.path)
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
        except sqlite3.OperationalError:  # no row ids
            low = None
        finally:
            con.close()
        if low is None:
            return [Range(None, None)]
        step = (high - low) // self.count + 1
        return [Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        sql = f"SELECT {', '.join(_name(f.name) for f in self.schema)} FROM {_name(self.table)}" + (" WHERE rowid BETWEEN ? AND ?" if partition.low is not None else "")
        cast = {LongType: int, DoubleType: float, StringType: str, BinaryType: bytes}
        casts = [cast[type(f.dataType)] for f in self.schema]
        con = _open(self.path)
        try:
            for row in con.execute(sql, () if partition.low is None else (partition.low, partition.high)):
                yield tuple(None if v is None else _cast(kind, v) for kind, v in zip(casts, row, strict=True))
        finally:
            con.close()


def _cast(kind, value):
    """SQLite types are per value: what does not fit the declared type becomes null."""
    try:
        if isinstance(value, kind):
            return value
        return value.encode() if kind is bytes and isinstance(value, str) else kind(value) if kind is not int or value == int(value) else None
    except (TypeError, ValueError):
        return None


def register_database(spark, path: str, names: list[str] | None = None) -> list[str]:
    """All tables of a SQLite file (views and internal tables apart) as temporary views."""
    spark.dataSource.register(SQLiteSource)
    con = _open(path)
    try:
        found = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
    finally:
        con.close()
    for name in names or found:
        spark.read.format("sqlite").options(path=path, table=name).load().createOrReplaceTempView(quoted(name))
    return names or found
