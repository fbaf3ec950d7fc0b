"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

A Misra-Gries sketch (Spark's ``approx_top_k``, which keeps a fixed number of
counters) names the digests that may be frequent.  Their exact counts and keepers are
then verified over all rows, and this table of at most ``counters`` rows is broadcast,
so that the rows of hot groups are decided where they are read.  The digests that
remain are aggregated with partial sums and joined back.

Defined results: null text counts as empty; texts are equal after each run of ASCII
white space becomes one space; of equal texts the smallest doc_id stays (rows that
repeat the keeper's doc_id stay with it; a null doc_id stays only where all are null);
texts of any length are hashed whole; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.lineage import written

#: Digests that are broadcast at most, and counters of the sketch.
HEAVY, COUNTERS = 256, 8192
#: A sketched digest with fewer rows than this is left to the shuffle.
LEAST_HEAVY = 64


def normalised(text) -> F.Column:
    """Runs of ASCII white space become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = written(digests(docs, id_col, text_col))
    heavy = (
        rows.select(F.expr(f"explode(approx_top_k(text_sha256, {HEAVY}, {COUNTERS}))").alias("x"))
        .select(F.col("x.item").alias("text_sha256"), F.col("x.count").alias("n"))
        .filter(F.col("n") >= LEAST_HEAVY)
        .select("text_sha256")
    )
    # at most HEAVY rows by the sketch's own bound
    winners = written(
        rows.join(F.broadcast(heavy), "text_sha256", "left_semi").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    hot = rows.join(F.broadcast(winners), "text_sha256")
    # beyond HEAVY large groups: partial sums before the shuffle, and a join back that AQE splits where a digest is skewed
    rest = rows.join(F.broadcast(winners), "text_sha256", "left_anti")
    rest = rest.join(rest.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "text_sha256")
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return hot.select(*columns).unionAll(rest.select(*columns))
