"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.lineage import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: each node that an edge joins to another one, with the smallest node that it reaches.

    In a large star every node links its larger neighbours to its smallest one, in a small
    star its smaller ones; no node ever gathers its neighbours in one row.  Each round is
    written to the shared folder.  Self-loops, repeated edges and edges with a null end say nothing.
    """
    x, y = F.col(a), F.col(b)
    now = written(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).filter(x.isNotNull() & y.isNotNull() & (x != y)).distinct())
    seen = _state(now)
    while seen[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = written(small.select("e.u", "e.v").filter("u != v").distinct())
        if seen == (seen := _state(now)):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Count and hash of a table of distinct edges."""
    x = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return x.n, x.h
