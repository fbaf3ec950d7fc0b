"""Changes folded in order: what a key's second change meets is what its first one left.

Each fold gives one row for each target: its last state, and what became of every change.  Changes that cannot matter any more are answered
before they are collected: those that name a revision older than the stored one, as revisions only grow, and those behind a change
that certainly ends their target.  What is left of one target's changes is a row's array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.operators import curation

#: Fields of a memory that operations change.
FIELDS = {"kind": "string", "text": "string", "status": "string", "review_status": "string", "revision": "bigint", "document_date": "timestamp", "superseded_by": "string", "valid_until": "timestamp"}
_ROW = f"struct<{','.join(f'{k}:{v}' for k, v in FIELDS.items())}>"
_BORN = f"struct<id:string,{','.join(f'{k}:{v}' for k, v in FIELDS.items())}>"
#: What may become of an operation; fixed values.
ADDED, UPDATED, DELETED, SUPERSEDED, SKIPPED, CONFLICT = "added", "updated", "deleted", "superseded", "skipped", "conflict"


def in_order(rows: DataFrame, changes: DataFrame, start: Column, step: Callable[[Column, Column], Column], order: str = "nth") -> DataFrame:
    """The rows with ``state``: what the changes of their id leave of ``start`` (a struct of the row's columns), taken by ``order``; ties by the other columns."""
    columns = [order, *[c for c in changes.columns if c not in (order, "id")]]
    of_one = changes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("__changes"))
    joined = rows.join(of_one, "id", "left")
    return joined.withColumn("state", F.when(F.col("__changes").isNull(), start).otherwise(F.aggregate("__changes", start, step))).drop("__changes")


def _set(state: Column, **new: Column) -> Column:
    """The row with some fields changed."""
    return F.struct(*[new.get(k, state[k]).cast(kind).alias(k) for k, kind in FIELDS.items()])


def _operation(s: Column, x: Column, now: Column) -> Column:
    """One step: the row, the outcomes, the rows that are born and the revisions that are written."""
    row = s["row"]
    said = F.coalesce(x["said"], now)
    supersedes = F.coalesce(x["change"] == "supersede", F.lit(False))
    backwards = F.coalesce(x["said"] < row["document_date"], F.lit(False))
    stale = F.coalesce(x["expected_revision"] != row["revision"], F.lit(False))
    outcome = (
        F.when(~F.coalesce(row["status"] == "active", F.lit(False)), SKIPPED).when(stale, CONFLICT).when(x["op"] == "DELETE", DELETED).when(supersedes, SUPERSEDED).otherwise(UPDATED)
    )
    following = row["revision"] + 1
    archived = _set(row, status=F.lit("archived"), revision=following)
    rewritten = _set(
        row, kind=F.coalesce(x["kind"], row["kind"]), text=F.coalesce(x["text"], row["text"]), review_status=F.lit("pending"), revision=following,
        document_date=F.coalesce(x["said"], row["document_date"]), valid_until=F.coalesce(x["valid_until"], row["valid_until"]),
    )
    replaced = _set(row, status=F.lit("superseded"), superseded_by=x["new_id"], revision=following, valid_until=F.least(said, row["valid_until"]))
    new = F.when(outcome == DELETED, archived).when(outcome == UPDATED, rewritten).when((outcome == SUPERSEDED) & ~backwards, replaced).otherwise(row)
    born = F.struct(
        x["new_id"].alias("id"), F.coalesce(x["kind"], row["kind"]).alias("kind"), F.coalesce(x["text"], row["text"]).alias("text"), F.when(backwards, "superseded").otherwise("active").alias("status"),
        F.lit("pending").alias("review_status"), F.when(backwards, 2).otherwise(1).cast("bigint").alias("revision"), said.alias("document_date"), F.when(backwards, s["id"]).alias("superseded_by"),
        F.when(backwards, F.least(row["document_date"], x["valid_until"])).otherwise(x["valid_until"]).alias("valid_until"),
    )
    changed = new["revision"] != row["revision"]
    return F.struct(
        s["id"].alias("id"), new.alias("row"), F.array_append(s["out"], F.struct(x["nth"].cast("bigint").alias("nth"), outcome.alias("outcome"))).alias("out"),
        F.when(outcome == SUPERSEDED, F.array_append(s["born"], born)).otherwise(s["born"]).alias("born"), F.when(changed, F.array_append(s["versions"], new)).otherwise(s["versions"]).alias("versions"),
    )


def operations(rows: DataFrame, ops: DataFrame, now: Column) -> DataFrame:
    """id and ``state`` of each row: row, out (nth, outcome), born (rows) and versions (rows as they were after each change).

    ``rows`` has id and ``FIELDS``; ``ops`` nth, op, id, new_id, text, kind, change, said, valid_until, expected_revision (null: any), reason (null: accepted).
    An operation meets what those before it have left.  A target that is not active is skipped, one of another revision than expected is a
    conflict.  An update is the next revision, up for review, said when the update was; one that supersedes adds a row, and the older of the two by when it was said becomes the
    other's history, valid until then; a deletion archives.
    """
    edits = ops.filter("reason IS NULL AND op != 'ADD'").select("id", "nth", "op", "change", "kind", "text", "said", "new_id", "valid_until", "expected_revision")
    ended = edits.filter("op = 'DELETE' AND expected_revision IS NULL").groupBy("id").agg(F.min("nth").alias("ended"))
    live = edits.join(ended, "id", "left").filter("ended IS NULL OR nth <= ended").drop("ended")
    own = F.struct(*[F.col(k).cast(kind).alias(k) for k, kind in FIELDS.items()])
    start = F.struct(
        F.col("id").alias("id"), own.alias("row"), F.array().cast("array<struct<nth:bigint,outcome:string>>").alias("out"), F.array().cast(f"array<{_BORN}>").alias("born"), F.array().cast(f"array<{_ROW}>").alias("versions"),
    )
    return in_order(rows, live, start, lambda s, x: _operation(s, x, now)).select("id", "state")


def next_rows(folded: DataFrame, ops: DataFrame, now: Column) -> DataFrame:
    """id and ``FIELDS``: the next version of the table, from what ``operations`` gives."""
    old = folded.select("id", *[F.col(f"state.row.{k}").alias(k) for k in FIELDS])
    born = folded.select(F.explode("state.born").alias("x")).select("x.*")
    new = {
        "kind": F.coalesce("kind", F.lit("fact")), "text": F.col("text"), "status": F.lit("active"), "review_status": F.lit("pending"), "revision": F.lit(1), "document_date": F.coalesce("said", now),
        "superseded_by": F.lit(None), "valid_until": F.col("valid_until"),
    }
    added = ops.filter("reason IS NULL AND op = 'ADD'").select(F.col("new_id").alias("id"), *[new[k].cast(kind).alias(k) for k, kind in FIELDS.items()])
    return old.unionByName(born).unionByName(added)


def new_revisions(folded: DataFrame) -> DataFrame:
    """memory_id and ``FIELDS`` of every revision that the operations wrote of rows that were there."""
    return folded.select(F.col("id").alias("memory_id"), F.explode("state.versions").alias("x")).select("memory_id", "x.*")


def outcomes(folded: DataFrame, ops: DataFrame) -> DataFrame:
    """The ops' nth and outcome; the reason of those that were refused, skipped where the target is not there or has ended."""
    said = folded.select(F.explode("state.out").alias("x")).select("x.nth", F.col("x.outcome").alias("__outcome"))
    o = ops.select("nth", "op", "reason").join(said, "nth", "left")
    return o.select("nth", F.coalesce("reason", F.when(F.col("op") == "ADD", ADDED), "__outcome", F.lit(SKIPPED)).alias("outcome"))


def status_changes(rows: DataFrame, changes: DataFrame, revisions: DataFrame, longest: int) -> DataFrame:
    """The changed rows' id, status, valid_until, forget_reason, revision, conflicts and restored.

    ``changes`` has id, nth, to_status, expected_revision (null: any) and reason.  A superseded row that becomes active gets the validity back that its last
    revision before had which was not superseded, be it stored or left by a change before; ``restored`` tells, and edges that replace the row fall away.
    """
    before = curation.last_good(revisions, rows.select(F.col("id").alias("memory_id"), F.col("revision").alias("current"))).select(F.col("memory_id").alias("id"), F.col("valid_until").alias("__good"))
    held = rows.join(changes.select("id").distinct(), "id", "left_semi").join(before, "id", "left")
    start = F.struct(
        F.col("status").alias("status"), F.col("valid_until").alias("valid_until"), F.col("__good").alias("good"), F.lit(None).cast("string").alias("why"), F.col("revision").cast("bigint").alias("revision"),
        F.lit(0).alias("conflicts"), F.lit(False).alias("restored"),
    )

    def step(s: Column, x: Column) -> Column:
        stale = F.coalesce(x["expected_revision"] != s["revision"], F.lit(False))
        back = ~stale & (x["to_status"] == "active") & (s["status"] == "superseded")
        why = F.when(x["to_status"] != "active", F.nullif(F.substring(F.trim(x["reason"]), 1, longest), F.lit("")))
        keep = lambda new, name: F.when(stale, s[name]).otherwise(new).alias(name)
        return F.struct(
            keep(x["to_status"], "status"), F.when(back, s["good"]).otherwise(s["valid_until"]).alias("valid_until"), keep(F.when(s["status"] != "superseded", s["valid_until"]).otherwise(s["good"]), "good"), keep(why, "why"),
            keep(s["revision"] + 1, "revision"), (s["conflicts"] + stale.cast("int")).alias("conflicts"), (s["restored"] | back).alias("restored"),
        )

    done = in_order(held, changes.select("id", "nth", "to_status", "expected_revision", "reason"), start, step)
    return done.select("id", "state.status", "state.valid_until", F.col("state.why").alias("forget_reason"), "state.revision", "state.conflicts", "state.restored")


def versions(rows: DataFrame, changes: DataFrame, *columns: str, sticky: list[str] | None = None) -> DataFrame:
    """The rows after changes that each name the revision which they change, with ``conflicts``: how many named another one.

    ``changes`` has id, nth, expected_revision, the ``columns`` and the ``sticky`` ones; null in a sticky column says nothing on it.
    """
    sticky = sticky or []
    all_columns = [*columns, *sticky]
    stored = rows.select("id", F.col("revision").alias("__stored"))
    known = changes.select("id", "nth", "expected_revision", *all_columns).join(stored, "id")
    stale = known.filter("expected_revision < __stored").groupBy("id").agg(F.count("*").alias("__stale"))  # they can name no later one
    start = F.struct(*[F.col(c).alias(c) for c in all_columns], F.col("revision").cast("bigint").alias("revision"), F.lit(0).cast("bigint").alias("conflicts"))

    def step(s: Column, x: Column) -> Column:
        hit = F.coalesce(x["expected_revision"] == s["revision"], F.lit(False))
        new = [F.when(hit, F.coalesce(x[c], s[c]) if c in sticky else x[c]).otherwise(s[c]).alias(c) for c in all_columns]
        return F.struct(*new, (s["revision"] + hit.cast("bigint")).alias("revision"), (s["conflicts"] + (~hit).cast("bigint")).alias("conflicts"))

    done = in_order(rows, known.filter("NOT coalesce(expected_revision < __stored, false)").drop("__stored"), start, step).join(stale, "id", "left")
    rest = [c for c in rows.columns if c not in all_columns and c != "revision"]
    return done.select(*rest, *[F.col(f"state.{c}").alias(c) for c in all_columns], "state.revision", (F.col("state.conflicts") + F.coalesce("__stale", F.lit(0))).alias("conflicts"))
