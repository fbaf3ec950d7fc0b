"""Changes of an index delivered with retries: what is due is tried, what fails waits longer each time, and is given up after ``MOST`` attempts.

The pending changes are a table of a catalog, one row for each entity: its latest change, the attempts made and when the next one is due.  A batch of the stream merges
its changes, tries all that is due, and commits the next version under its number, so that a batch which is repeated after a failure changes nothing twice.
A later change of an entity replaces a waiting one, which is obsolete and never delivered; one that is older than what is delivered already is obsolete, too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gistmill.lineage import written
from gistmill.sources.catalog import Catalog

# Attempts that are made, and the seconds between them: powers of two up to a most.
MOST, LONGEST, POWERS = 8, 300, 8
KEY = ["collection", "entity_id"]
PENDING = "collection string, entity_id long, id long, operation string, payload string, attempts int, due timestamp"
DELIVERED = "collection string, entity_id long, id long"
DEAD = "collection string, entity_id long, id long, attempts int"


def delay(attempts: Column) -> Column:
    """Seconds to wait after so many attempts."""
    return F.least(F.lit(LONGEST), F.pow(F.lit(2), F.least(attempts, F.lit(POWERS))).cast("int"))


def merged(pending: DataFrame, changes: DataFrame, delivered: DataFrame, now: Column) -> DataFrame:
    """The pending changes with new ones (collection, entity_id, id, operation, payload), the latest of each entity only, none older than what is delivered."""
    new = changes.select(*KEY, "id", "operation", "payload", F.lit(0).alias("attempts"), now.alias("due"))
    fields = ["id", "operation", "payload", "attempts", "due"]
    latest = pending.unionByName(new).groupBy(*KEY).agg(F.max_by(F.struct(*fields), F.struct("id", "attempts")).alias("x")).select(*KEY, *[f"x.{c}" for c in fields])  # a repeated change keeps its attempts
    had = delivered.select(*KEY, F.col("id").alias("had"))
    return latest.join(had, KEY, "left").filter("had IS NULL OR id > had").drop("had")


def step(tables: dict[str, DataFrame], changes: DataFrame, deliver: Callable[[DataFrame], DataFrame], now: Column) -> dict[str, DataFrame]:
    """The next pending, delivered and dead tables.  ``deliver`` gets the due changes and gives those (collection, entity_id) that failed; it may get one again after a crash."""
    waiting = written(merged(tables["pending"], changes, tables["delivered"], now))
    due = waiting.filter(F.col("due") <= now)
    failed = written(deliver(due.drop("attempts", "due")).select(*KEY).distinct()).withColumn("failed", F.lit(True))
    tried = due.join(failed, KEY, "left").withColumn("attempts", F.col("attempts") + 1)
    again = tried.filter("failed").drop("failed")
    left = again.filter(F.col("attempts") < MOST).withColumn("due", now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), delay(F.col("attempts"))))
    done = tried.filter("failed IS NULL").select(*KEY, "id")
    known = tables["delivered"].unionByName(done).groupBy(*KEY).agg(F.max("id").alias("id"))
    dead = tables["dead"].unionByName(again.filter(F.col("attempts") >= MOST).select(*KEY, "id", "attempts"))
    return {"pending": waiting.filter(F.col("due") > now).unionByName(left), "delivered": known, "dead": dead}


def tables_of(catalog: Catalog, since: dict) -> dict[str, DataFrame]:
    """The three tables of a commit; empty where there is none yet."""
    found = catalog.tables(since["number"]) if since["number"] else {}
    return {name: found[name] if name in found else catalog.spark.createDataFrame([], schema) for name, schema in (("pending", PENDING), ("delivered", DELIVERED), ("dead", DEAD))}


def deliver_stream(changes: DataFrame, catalog: Catalog, deliver: Callable[[DataFrame], DataFrame], checkpoint: str, now: Callable[[], Column] = F.current_timestamp, stream: str = "deliveries", **trigger) -> StreamingQuery:
    """Delivers a stream of changes; with a processing-time trigger, batches without new changes try what has become due."""

    def batch(rows: DataFrame, number: int) -> None:
        since = catalog.manifest()
        if since["batches"].get(stream, -1) < number:
            catalog.commit(step(tables_of(catalog, since), rows, deliver, now()), since, (stream, number))

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def retry(catalog: Catalog, deliver: Callable[[DataFrame], DataFrame], now: Column) -> int:
    """Tries what has become due, between batches; gives the commit's number."""
    since = catalog.manifest()
    none = catalog.spark.createDataFrame([], "collection string, entity_id long, id long, operation string, payload string")
    return catalog.commit(step(tables_of(catalog, since), none, deliver, now), since)
