"""Tables in versions: one small file pins a version of every table, and is put in place whole.

A version of a table is a folder of Parquet files that nobody changes.  A commit writes the new folders, then the next manifest, which names a folder for
each table; readers take the latest manifest, so they see all tables of one commit or none of it.  Of two writers that start from one manifest the second
one fails.  A stream commits under the number of its batch: a batch that is repeated after a restart finds its number in the manifest and writes nothing.

Receipts of erasures lie beside the tables and outlive them: a table that is restored from an older version is read through them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECEIPT = "user_id long, scope_id string, at timestamp"


class Conflict(RuntimeError):
    """Another commit came between."""


class Catalog:
    """The tables under a path, in any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- manifests: small JSON files, by number

    def numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/_manifests")
        found = self._store.listStatus(folder) if self._store.exists(folder) else []
        return sorted(int(x.getPath().getName().removesuffix(".json")) for x in found if x.getPath().getName()[0].isdigit())

    def manifest(self, number: int | None = None) -> dict:
        """number, tables (name to folder) and batches (stream to its last batch)."""
        have = self.numbers()
        if not have:
            return {"number": 0, "tables": {}, "batches": {}}
        number = have[-1] if number is None else number
        line = self.spark.read.text(f"{self.path}/_manifests/{number:09d}.json", wholetext=True).first()[0]
        return json.loads(line)

    def _put(self, manifest: dict) -> None:
        """Writes a manifest under its number: beside its place first, then moved, which one writer can do."""
        final = self._path(f"{self.path}/_manifests/{manifest['number']:09d}.json")
        draft = self._path(f"{self.path}/_manifests/_{uuid.uuid4().hex}")
        out = self._store.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._store.exists(final) or not self._store.rename(draft, final):
            self._store.delete(draft, False)
            raise Conflict(f"version {manifest['number']} is there already")

    # --- tables

    def tables(self, number: int | None = None) -> dict[str, DataFrame]:
        """All tables of one commit; later commits don't change what these frames read."""
        return {name: self.spark.read.parquet(f"{self.path}/{folder}") for name, folder in self.manifest(number)["tables"].items()}

    def commit(self, changed: dict[str, DataFrame], since: dict | None = None, batch: tuple[str, int] | None = None) -> int:
        """Writes new versions of some tables over the manifest ``since`` (the latest); gives the commit's number.

        With ``batch``, a stream's name and batch number, a batch that has been committed is passed over.
        """
        before = self.manifest() if since is None else since
        if batch and before["batches"].get(batch[0], -1) >= batch[1]:
            return before["number"]
        folders = {}
        for name, rows in changed.items():
            folders[name] = f"{name}/{before['number'] + 1:09d}-{uuid.uuid4().hex[:8]}"
            rows.write.parquet(f"{self.path}/{folders[name]}")
        after = {"number": before["number"] + 1, "tables": before["tables"] | folders, "batches": before["batches"] | ({batch[0]: batch[1]} if batch else {})}
        self._put(after)
        return after["number"]

    def restore(self, number: int) -> int:
        """Makes the tables of an older commit the latest ones; the streams' batches stay as they are."""
        old, now = self.manifest(number), self.manifest()
        self._put({"number": now["number"] + 1, "tables": old["tables"], "batches": now["batches"]})
        return now["number"] + 1

    # --- receipts

    def receipts(self) -> DataFrame:
        """user_id, scope_id, at of all erasures; a scope that is null stands for the user's rows everywhere."""
        path = f"{self.path}/_receipts"
        return self.spark.read.schema(RECEIPT).parquet(path) if self._store.exists(self._path(path)) else self.spark.createDataFrame([], RECEIPT)

    def erase(self, receipts: DataFrame, owners: dict[str, Callable[[DataFrame, DataFrame], DataFrame]]) -> int:
        """Appends the receipts first, then commits the tables of ``owners`` without what they name; a crash between the two leaves the erasure to ``replayed``."""
        receipts.select("user_id", "scope_id", "at").write.mode("append").parquet(f"{self.path}/_receipts")
        since = self.manifest()
        return self.commit(self._without(self.tables(since["number"]), owners), since)

    def replayed(self, owners: dict[str, Callable[[DataFrame, DataFrame], DataFrame]]) -> dict[str, DataFrame]:
        """All tables of the latest commit without what any receipt names, whatever version they come from."""
        now = self.tables()
        return now | self._without(now, owners)

    def _without(self, tables: dict[str, DataFrame], owners: dict[str, Callable[[DataFrame, DataFrame], DataFrame]]) -> dict[str, DataFrame]:
        said = self.receipts()
        return {name: owned(tables[name], said) for name, owned in owners.items() if name in tables}


def of_user(column: str = "user_id") -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Rows whose ``column`` names no user of a receipt."""
    return lambda rows, receipts: rows.join(receipts.select(F.col("user_id").alias(column)).distinct(), column, "left_anti").select(*rows.columns)


def of_scope(column: str = "scope_id") -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Rows that lie in no scope of a receipt."""
    return lambda rows, receipts: rows.join(receipts.filter("scope_id IS NOT NULL").select(F.col("scope_id").alias(column)).distinct(), column, "left_anti").select(*rows.columns)
