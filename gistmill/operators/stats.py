"""Statistics and the long-form series that dashboards draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.lineage import written


def by_day(rows: DataFrame, at: str, key: Column | str) -> DataFrame:
    """day, key, value: rows a day (UTC) and key."""
    key = F.col(key) if isinstance(key, str) else key
    return rows.groupBy(F.to_date(at).alias("day"), key.cast("string").alias("key")).agg(F.count("*").alias("value"))


def nearest_rank(value: Column | str, share: float) -> Column:
    """The smallest value with at least this share of all at or below it."""
    name = value if isinstance(value, str) else value._jc.toString()
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {name})")


def latencies(rows: DataFrame, *by: Column | str) -> DataFrame:
    """Searches: an interpolated median, a nearest-rank 95th percentile, counts and abstention."""
    return rows.groupBy(*by).agg(
        F.round(F.percentile("total_ms", 0.5), 1).alias("p50"),
        F.round(nearest_rank("total_ms", 0.95), 1).alias("p95"),
        F.count("*").alias("searches"),
        F.round(F.avg(F.col("abstained").cast("double")), 4).alias("abstention"),
    )


def pivoted(series: DataFrame, keys: list[str]) -> DataFrame:
    """One row a day with a column for each key; repeated (day, key) add up."""
    return series.groupBy("day").pivot("key", keys).agg(F.sum("value")).na.fill(0, keys)


def densified(wide: DataFrame, first: Column, last: Column, keys: list[str], most_days: int = 400) -> DataFrame:
    """A row for each day of a range, with 0 where there was none."""
    days = wide.sparkSession.range(1).select(F.explode(F.slice(F.sequence(first, last), 1, most_days)).alias("day"))
    return days.join(wide, "day", "left").na.fill(0, keys)


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with ``nth``, their place in an order: sorted by ranges, counted within each, and moved on by what stands before."""
    parts = rows.orderBy(*order).withColumn("__part", F.spark_partition_id())
    parts = written(parts.withColumn("__in", F.monotonically_increasing_id()))
    counts = parts.groupBy("__part").agg(F.count("*").alias("n"), F.min("__in").alias("first"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("__part", (before - F.col("first") + 1).alias("__shift")))
    return parts.join(starts, "__part").withColumn("nth", F.col("__in") + F.col("__shift")).drop("__part", "__in", "__shift")


def totals(series: DataFrame) -> DataFrame:
    """key, total, nth: the largest first, ties by name."""
    return ranked(series.groupBy("key").agg(F.sum("value").alias("total")), [F.desc("total"), F.asc("key")])


def element_at_share(rows: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """by, value: the element at round-half-even of share * (n - 1) of each group's values in order.

    Equal values are counted first, so that what a window holds are distinct values.
    """
    counts = rows.groupBy(by, value).agg(F.count("*").alias("c"))
    up_to = F.sum("c").over(Window.partitionBy(by).orderBy(value))
    of = counts.groupBy(by).agg(F.sum("c").alias("n"))
    placed = counts.withColumn("up_to", up_to).join(of, by)
    wanted = F.bround(F.lit(share) * (F.col("n") - 1), 0) + 1
    return placed.filter((F.col("up_to") >= wanted) & (F.col("up_to") - F.col("c") < wanted)).select(by, F.col(value).alias("value"))


def extraction_report(memories: DataFrame, messages: DataFrame, columns: dict[str, str], size: int = 10) -> DataFrame:
    """what, key, n: active claims by each of the named columns, and sessions, messages and windows of ``size`` turns, rounded for each session."""
    out = None
    for name, column in columns.items():
        part = memories.groupBy(F.lit(name).alias("what"), F.col(column).cast("string").alias("key")).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionAll(part)
    s = messages.groupBy("session_id").agg(F.count("*").alias("n"))
    t = s.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"), F.coalesce(F.sum(F.ceil(F.col("n") / size)), F.lit(0)).alias("windows"))
    return out.unionAll(t.select(F.lit("total"), F.stack(F.lit(3), *[x for name in ("sessions", "messages", "windows") for x in (F.lit(name), F.col(name))])))


def share(part: Column, whole: Column) -> Column:
    """Null over nothing."""
    return F.when(whole != 0, part / whole)


def heat_level(value: Column, peak: Column) -> Column:
    return F.when((peak <= 0) | (value <= 0), 0).otherwise(F.ceil(F.least(value, peak) / peak * 4)).cast("int")
