"""A number for each row of a table whose ids may repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmill.lineage import written

KEY = "__key"
#: Rows of one id get so many bits of its key, where ids leave room for them; so many repeated ids are broadcast at most.
BITS, BROADCAST_IDS = 20, 1_000_000


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows with a long ``KEY``, unique and in the order of the ids; null where the id is.

    Where no id repeats, which a count of ids alone tells, it is the id.  Otherwise rows with one id are documents of their own, in the order of a hash of their
    text: they alone are sorted and numbered, behind their id's place, and the others stay where they are.  Only where ids or repeats are too large for that are all
    rows sorted by id.
    """
    own = F.col(id_col).cast("long")
    again = docs.select(own.alias("k")).filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    if not again.head(1):
        return docs.withColumn(KEY, own)
    again = written(again)
    ids, most = again.agg(F.count("*"), F.max("n")).first()
    low, high = docs.agg(F.min(own), F.max(own)).first()
    # the place breaks ties, so that equal rows are numbered too
    placed = docs.withColumn("__place", F.monotonically_increasing_id())
    if ids <= BROADCAST_IDS and most < 1 << BITS and -(1 << 62 - BITS) < low and high < 1 << 62 - BITS:
        repeated = F.broadcast(again.select(F.col("k").alias("__again")))
        apart = Window.partitionBy(own).orderBy(F.xxhash64(text_col), "__place")
        scaled = F.shiftleft(own, BITS)
        sorted_rows = placed.join(repeated, own == F.col("__again"), "left_semi").withColumn(KEY, scaled + F.row_number().over(apart)).drop("__place")
        return docs.join(repeated, own == F.col("__again"), "left_anti").withColumn(KEY, scaled).unionByName(written(sorted_rows))
    order = placed.orderBy(own.asc_nulls_first(), F.xxhash64(text_col), "__place").drop("__place")
    return written(order.withColumn(KEY, F.when(own.isNotNull(), F.monotonically_increasing_id())))
