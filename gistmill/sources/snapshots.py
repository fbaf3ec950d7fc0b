"""Snapshots of a set of tables: written as Parquet with a manifest, listed, and verified against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _digest(rows: DataFrame) -> DataFrame:
    """rows and digest: a count and an order-free sum of hashes, both partial before the shuffle."""
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*[F.to_json(F.struct(c)) for c in sorted(rows.columns)]).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def create(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each table and then the manifest (name, rows, digest), whose presence says that the snapshot is whole."""
    manifest = None
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{path}/{name}")
        line = _digest(rows.sparkSession.read.parquet(f"{path}/{name}")).select(F.lit(name).alias("name"), "rows", "digest")
        manifest = line if manifest is None else manifest.unionAll(line)
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{path}/_manifest_")
    return manifest


def verified(spark: SparkSession, path: str) -> DataFrame:
    """name, rows, whole: whether each table of a snapshot still is what its manifest says."""
    said = spark.read.parquet(f"{path}/_manifest_")
    out = None
    for r in said.collect():  # a row for each table
        now = _digest(spark.read.parquet(f"{path}/{r['name']}")).select(F.lit(r["name"]).alias("name"), "rows", ((F.col("rows") == r["rows"]) & (F.col("digest") == r["digest"])).alias("whole"))
        out = now if out is None else out.unionAll(now)
    return out
