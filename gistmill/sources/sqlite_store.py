"""Stores that are SQLite files, read in parallel: a batch Python data source whose partitions are ranges of row ids.

    spark.dataSource.register(SqliteTable)
    spark.read.format("sqlite_table").option("path", file).option("table", "memories").load()

The file must be seen by the driver and all executors under one path, and is opened read-only.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

ROWS = 100_000
#: Tables of the older store; fixed values.
TABLES = ("sessions", "messages", "judge_runs", "memories", "memory_revisions", "memory_sources", "memory_evidence", "retrieval_feedback")


def _opened(path: str) -> sqlite3.Connection:
    from urllib.parse import quote

    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _named(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Rows(InputPartition):
    """Row ids from low up to and without high; all rows where low is None."""

    low: int | None
    high: int | None


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        kinds = {"INT": LongType(), "REA": DoubleType(), "FLO": DoubleType(), "DOU": DoubleType(), "BLO": BinaryType()}
        con = _opened(self.options["path"])
        try:
            columns = con.execute(f"PRAGMA table_info({_named(self.options['table'])})").fetchall()
        finally:
            con.close()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return StructType([StructField(c[1], kinds.get(str(c[2]).upper()[:3], StringType())) for c in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], schema, int(self.options.get("rows", ROWS)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, rows: int):
        self.path, self.table, self.schema, self.rows = path, table, schema, rows

    def partitions(self) -> list[InputPartition]:
        con = _opened(self.path)
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_named(self.table)}").fetchone()
        except sqlite3.OperationalError:  # a table without row ids
            return [Rows(None, None)]
        finally:
            con.close()
        if low is None:
            return [Rows(0, 0)]
        parts = max(1, -(-(high - low + 1) // self.rows))
        step = -(-(high - low + 1) // min(parts, 10_000))  # row ids may be far apart
        return [Rows(at, min(at + step, high + 1)) for at in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        con = _opened(self.path)
        try:
            where = "" if partition.low is None else f" WHERE rowid >= {partition.low} AND rowid < {partition.high}"
            casts = [str if isinstance(f.dataType, StringType) else float if isinstance(f.dataType, DoubleType) else None for f in self.schema]
            names = ", ".join(_named(f.name) for f in self.schema)
            for row in con.execute(f"SELECT {names} FROM {_named(self.table)}{where}"):
                # columns of SQLite may hold values of any type
                yield tuple(cast(v) if cast and v is not None and not isinstance(v, bytes) else v for cast, v in zip(casts, row, strict=True))
        finally:
            con.close()


def tables(spark: SparkSession, path: str, rows: int = ROWS) -> dict[str, DataFrame]:
    """The tables of an older store."""
    spark.dataSource.register(SqliteTable)
    return {t: spark.read.format("sqlite_table").option("path", path).option("table", t).option("rows", rows).load() for t in TABLES}


def imported(old: dict[str, DataFrame], user_id: Column, scope_id: Column, held: dict[str, DataFrame] | None = None, pending: bool = False) -> dict[str, DataFrame]:
    """The rows of an older store as one user's, in their own scope; those whose ids ``held`` has already are left out, so that an import may be repeated.

    Memories count as confirmed unless they are to be reviewed; their history stays confirmed.
    """
    keys = {"memory_revisions": ["memory_id", "revision"], "memory_sources": ["memory_id", "message_id"], "memory_evidence": ["memory_id", "message_id", "start_char", "end_char"]}
    out = {}
    for name, rows in old.items():
        key = keys.get(name, ["id"])
        if name in ("sessions", "messages", "judge_runs"):
            rows = rows.withColumn("user_id", user_id)
        if name in ("sessions", "memories", "memory_revisions"):
            rows = rows.withColumn("scope_id", scope_id)
        if name in ("memories", "memory_revisions"):
            rows = rows.withColumn("author_id", user_id).withColumn("review_status", F.lit("pending" if pending and name == "memories" else "confirmed"))
        if held and name in held:
            rows = rows.join(held[name].select(*key).distinct(), key, "left_anti")
        out[name] = rows
    return out
