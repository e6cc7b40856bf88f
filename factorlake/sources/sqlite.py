"""A Spark data source for SQLite files (there is no JDBC driver for it here).

spark.dataSource.register(SqliteSource)
spark.read.format("sqlite").option("path", p).option("table", t)
     .option("columns", "a,b").option("where", "market = ?").option("params", '["US"]').schema(...).load()

The rows of the table are cut into ranges of rowid, one per partition. Columns
and the condition go into the query, so that only what is wanted leaves the file.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_KINDS = {"INT": T.LongType(), "REAL": T.DoubleType(), "FLOA": T.DoubleType(), "DOUB": T.DoubleType(), "NUME": T.DoubleType()}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Rowids(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[Rowids]:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.options['table'])}").fetchone()
        if low is None:
            return [Rowids(0, 0)]
        n = max(1, int(self.options.get("numpartitions", 8)))
        step = max(1, -(-(high - low + 1) // n))
        return [Rowids(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: Rowids) -> Iterator[tuple]:
        names = ", ".join(_quoted(f.name) for f in self.schema.fields)
        extra = f" AND ({self.options['where']})" if self.options.get("where") else ""
        sql = f"SELECT {names} FROM {_quoted(self.options['table'])} WHERE rowid BETWEEN ? AND ?{extra}"
        kinds = [float if isinstance(f.dataType, T.DoubleType) else int if isinstance(f.dataType, T.LongType) else str for f in self.schema.fields]
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            for row in db.execute(sql, [partition.low, partition.high, *json.loads(self.options.get("params", "[]"))]):
                yield tuple(None if v is None or v == "" and k is not str else k(v) for v, k in zip(row, kinds))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            found = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        kinds = {name: _KINDS.get((kind or "").upper()[:4].rstrip("("), _KINDS.get((kind or "").upper()[:3], T.StringType())) for _, name, kind, *_ in found}
        return T.StructType([T.StructField(c, kinds[c]) for c in (wanted or kinds)])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))


def read_sqlite(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, where: str | None = None, params: list | None = None, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").option("path", path).option("table", table).option("numpartitions", partitions)
    if columns:
        reader = reader.option("columns", ",".join(columns))
    if where:
        reader = reader.option("where", where).option("params", json.dumps(params or []))
    return reader.load()
