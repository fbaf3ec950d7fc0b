"""Writes as transforms: each takes tables and returns the rows of their next version, or a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions import text
from gistmill.operators.graph import nearest_to, similar_pairs

# Source roles from the strongest to the weakest evidence, and the order in which a merge takes the least trusted.
AUTHORITY = ["user", "tool", "assistant", "agent", "inference"]
WEAKEST_FIRST = ["agent", "assistant", "inference", "manual", "tool", "user"]
TRUSTED = ("user", "manual", "tool")


def first_of(roles: Column, order: list[str], default: str = "manual") -> Column:
    """The first role of an order that a set of roles holds."""
    out = F.lit(default)
    for role in reversed(order):
        out = F.when(F.array_contains(roles, role), F.lit(role)).otherwise(out)
    return out


def may_write(op: Column, roles: Column) -> Column:
    """False where all evidence is the assistant's own words; deletions and claims without evidence pass."""
    own = F.size(F.array_except(roles, F.array(F.lit("assistant"), F.lit("agent")))) == 0
    return (op == "DELETE") | (F.size(roles) == 0) | ~own


def first_seen(rows: DataFrame, *key: str, by: str) -> DataFrame:
    """Of rows with equal keys the first one; a repeated delivery changes nothing."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(by))
    return rows.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")


def windows(messages: DataFrame, size: int = 10) -> DataFrame:
    """session_id, window, n, first_id, last_id: each session's turns in order, so many to a window."""
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("id"))
    cut = messages.withColumn("window", F.ceil(nth / size).cast("int"))
    return cut.groupBy("session_id", "window").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def gate(messages: DataFrame, least: int = 10, closed: DataFrame | None = None) -> DataFrame:
    """session_id, ready: enough turns wait, someone asked to remember, or the session is closed."""
    out = messages.groupBy("session_id").agg(((F.count("*") >= least) | F.bool_or(urgent(F.col("content")))).alias("ready"))
    if closed is None:
        return out
    return out.join(closed.select("session_id", F.lit(True).alias("closed")), "session_id", "left").select("session_id", (F.col("ready") | F.coalesce("closed", F.lit(False))).alias("ready"))


def exact_groups(rows: DataFrame, *identity: str) -> DataFrame:
    """group_hash, survivor, members: live rows of one identity and one normalised text; the newest survives."""
    g = rows.groupBy(*identity, text.content_hash(F.col("text")).alias("group_hash"))
    return g.agg(F.max(F.struct("updated_at", F.col("id"))).alias("x"), F.count("*").alias("members")).filter("members > 1").select(*identity, "group_hash", F.col("x.id").alias("survivor"), "members")


def merged_fields(rows: DataFrame, *identity: str) -> DataFrame:
    """What a merged row holds: the least confidence, the earliest date, any static mark, the least trusted role, the newest text."""
    return rows.groupBy(*identity).agg(
        F.max_by("id", F.struct("updated_at", "id")).alias("id"), F.min("confidence").alias("confidence"), F.min("document_date").alias("document_date"),
        F.bool_or("is_static").alias("is_static"), first_of(F.collect_set("source_role"), WEAKEST_FIRST).alias("source_role"), F.max("source_count").alias("source_count"),
        *([F.array_sort(F.array_distinct(F.flatten(F.collect_set("event_dates")))).alias("event_dates")] if "event_dates" in rows.columns else []),
    )


def identity() -> Column:
    """What two claims must agree in before they can be one: scope, subject, kind, context in order of its keys, validity, role."""
    context = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("context"))))
    until = F.coalesce(F.date_format("valid_until", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    return F.concat_ws("|", "scope_id", F.coalesce(F.col("subject_id").cast("string"), F.lit("")), "kind", context, until, "source_role")


def restated(rows: DataFrame) -> DataFrame:
    """id, first: claims that an older one of the same identity and wording makes already."""
    keyed = rows.select("id", "created_at", identity().alias("__identity"), text.content_hash(F.col("text")).alias("__hash"))
    first = keyed.groupBy("__identity", "__hash").agg(F.min(F.struct("created_at", "id")).alias("x"))
    return keyed.join(first, ["__identity", "__hash"]).filter("id != x.id").select("id", F.col("x.id").alias("first"))


def stated_before(rows: DataFrame, cosine: float = 0.9) -> DataFrame:
    """id: claims (id, no, scope_id, status, h, v) whose wording, or nearly whose vector, an older active claim of the scope has."""
    first = rows.filter("status = 'active'").groupBy("scope_id", "h").agg(F.min("no").alias("first"))
    said = rows.join(first, ["scope_id", "h"]).filter("first < no").select("id")
    pairs = similar_pairs(rows.select("id", "scope_id", "v"), cosine, "scope_id")
    side = rows.select("id", "no", "status")
    both = pairs.join(side.select(F.col("id").alias("a"), F.struct("no", "status").alias("x")), "a").join(side.select(F.col("id").alias("b"), F.struct("no", "status").alias("y")), "b")
    forward = both.select(F.col("b").alias("id"), F.col("x.no").alias("old"), F.col("x.status").alias("status"), F.col("y.no").alias("new"))
    back = both.select(F.col("a").alias("id"), F.col("y.no").alias("old"), F.col("y.status").alias("status"), F.col("x.no").alias("new"))
    return said.unionAll(forward.unionAll(back).filter("status = 'active' AND old < new").select("id")).distinct()


def last_good(revisions: DataFrame, current: DataFrame) -> DataFrame:
    """memory_id, revision, valid_until: the last revision before the current one (memory_id, current) that was not superseded."""
    past = revisions.filter("status != 'superseded'").join(current, "memory_id").filter("revision < current")
    x = past.groupBy("memory_id").agg(F.max(F.struct("revision", "valid_until")).alias("x"))
    return x.select("memory_id", "x.revision", "x.valid_until")


def candidates(sessions: DataFrame, rows: DataFrame, key: str, recent: int = 6, most: int = 10) -> DataFrame:
    """key, id, nth, arm: for each session the newest rows of its scope and language, then those nearest to its vector q in its scope, ``most`` in all.

    The recent arm ranks a scope's rows once, and sessions take the first ones; the dense arm goes through pairs of blocks of sessions and rows.
    """
    newest = Window.partitionBy("scope_id", "lang").orderBy(F.desc("updated_at"), "id")
    top = rows.withColumn("nth", F.row_number().over(newest)).filter(F.col("nth") <= recent).select("scope_id", "lang", "id", "nth")
    first = sessions.join(top, ["scope_id", "lang"]).select(key, "id", "nth", F.lit("recent").alias("arm"))
    held = first.groupBy(F.col(key).cast("string").alias("asked")).agg(F.count("*").alias("held"), F.collect_set("id").alias("own"))  # at most ``recent`` of each
    near = nearest_to(sessions.select("scope_id", F.col(key).alias("id"), F.col("q").alias("v")), rows.select("scope_id", "id", "v"), recent + most, "scope_id").join(held, "asked", "left")
    near = near.filter(~F.coalesce(F.array_contains("own", F.col("other")), F.lit(False)))
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("cosine"), "other")) + F.coalesce("held", F.lit(0))
    kind = sessions.schema[key].dataType
    return first.unionAll(near.withColumn("nth", place.cast("int")).filter(F.col("nth") <= most).select(F.col("asked").cast(kind), "other", "nth", F.lit("dense")))


def numbered_entities(offered: DataFrame, most: int) -> DataFrame:
    """user_id, id, label, nth: of the entities offered to each speaker (user_id, id, place, label) each once, at its first place."""
    once = offered.groupBy("user_id", "id").agg(F.min(F.struct("place", "label")).alias("x"))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("x.place", "id"))
    return once.withColumn("nth", nth).filter(F.col("nth") <= most).select("user_id", "id", F.col("x.label").alias("label"), "nth")


def expired(rows: DataFrame, now: Column) -> DataFrame:
    return rows.filter((F.col("status") == "active") & (F.col("valid_until") <= now))


def demoted(rows: DataFrame, now: Column, idle_days: int = 90, step: float = 0.1, floor: float = 0.3) -> DataFrame:
    """Idle rows above the floor with the importance that they fall to; all in single precision, so that the floor itself is no change."""
    idle = (F.col("updated_at") <= now - F.make_dt_interval(F.lit(idle_days))) & (F.col("created_at") <= now - F.make_dt_interval(F.lit(idle_days)))
    low = F.lit(floor).cast("float")
    out = rows.filter((F.col("status") == "active") & (F.col("importance") > low) & idle)
    return out.withColumn("new_importance", F.greatest(low, (F.col("importance") - F.lit(step)).cast("float")))


def closed_validity(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """id, superseded_by, valid_until, late: a replaced claim ends when its replacement was said, or before by its own end.

    A replacement said before the claim that it replaces is itself history: ``late``.
    """
    new = rows.select(F.col("id").alias("from_id"), F.col("document_date").alias("new_date"))
    old = rows.select(F.col("id").alias("to_id"), F.col("document_date").alias("old_date"), "valid_until")
    e = edges.filter("relation = 'updates'").join(new, "from_id").join(old, "to_id")
    late = F.col("new_date") < F.col("old_date")
    ends = F.least(F.when(late, F.col("old_date")).otherwise(F.col("new_date")), "valid_until")
    return e.select(F.when(late, F.col("from_id")).otherwise(F.col("to_id")).alias("id"), F.when(late, F.col("to_id")).otherwise(F.col("from_id")).alias("superseded_by"), ends.alias("valid_until"), late.alias("late"))


def outcomes(ops: DataFrame) -> DataFrame:
    """The ops with ``reason``: the first ground of refusal in a fixed order, or null.

    ``ops`` has op, roles (array), evidence_ok, context_ok, entity_known, scope_writable, target_known, target_scope_ok, target_context_ok.
    """
    edits = F.col("op").isin("UPDATE", "DELETE")
    reason = (
        F.when(edits & ~F.col("target_known"), "unknown_candidate").when(~F.col("evidence_ok"), "evidence_invalid").when(~may_write(F.col("op"), F.col("roles")), "assistant_only_source")
        .when(~F.col("context_ok"), "context_mismatch").when(~F.col("entity_known"), "unknown_entity").when(~F.col("scope_writable"), "scope_not_allowed")
        .when(edits & ~F.col("target_scope_ok"), "target_scope_mismatch").when(edits & ~F.col("target_context_ok"), "target_context_mismatch")
    )
    return ops.withColumn("reason", reason)


def kept_backups(snapshots: DataFrame, keep: dict[str, int]) -> DataFrame:
    """Snapshots to drop: beyond the newest of each kind, and not protected."""
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("created_at"), "id"))
    most = F.create_map(*[F.lit(x) for pair in keep.items() for x in pair])
    return snapshots.withColumn("nth", nth).filter(~F.col("protected") & (F.col("nth") > F.coalesce(F.element_at(most, F.col("kind")), F.lit(0)))).drop("nth")


def session_conflicts(events: DataFrame, arrived: str = "id") -> DataFrame:
    """The events with reason: what is other than the session's first event says, by order of arrival, then id; null where all agrees."""
    first = events.groupBy("session_id").agg(F.min_by(F.struct("user_id", "agent"), F.struct(arrived, "id")).alias("x"))
    reason = F.when(F.col("user_id") != F.col("x.user_id"), "other_user").when(F.col("agent") != F.col("x.agent"), "other_agent")
    return events.join(first, "session_id").withColumn("reason", reason).drop("x")


#: Messages of a window and windows of a job; words that ask for a window at once; fixed values.
WINDOW, JOB = 10, 25
_URGENT = r"(?iU)(запомн|не\s+забудь|запиши\s+себе|remember\s+(that|this)|don'?t\s+forget|keep\s+in\s+mind|note\s+that\s+i)"


def urgent(said: Column) -> Column:
    """Whether a message asks for being remembered."""
    return F.coalesce(said.rlike(_URGENT), F.lit(False))


def window_jobs(events: DataFrame, size: int = WINDOW, most: int = JOB) -> DataFrame:
    """queue, session_id, win, n, first_id, last_id, done, reason, job: windows that are done, ``most`` to a job within each queue, in the order in which they were done.

    ``events`` has queue, session_id, id, closes (no message, but the end of the session), urgent.  A window is full with ``size`` messages, ends behind an urgent one, and when
    its session closes; what is open stays for later.  ``done`` is the id of the event that ended it.  A stretch between two such ends is cut into windows by itself.
    """
    of_session = Window.partitionBy("queue", "session_id")
    ends = (F.col("closes") | F.col("urgent")).cast("long")
    e = events.withColumn("seg", F.coalesce(F.sum(ends).over(of_session.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    key = ["queue", "session_id", "seg"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy("id")) - 1
    said = e.filter(~F.col("closes")).withColumn("sub", F.floor(place / size))
    w = said.groupBy(*key, "sub").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max_by("urgent", "id").alias("urgent"))
    w = w.join(e.filter("closes").select(*key, F.col("id").alias("closed")), key, "left")
    reason = F.when(F.col("n") == size, "full").when(F.col("urgent"), "remember").when(F.col("closed").isNotNull(), "closed")
    due = w.withColumn("reason", reason).filter("reason IS NOT NULL")
    due = due.withColumn("done", F.when(F.col("reason") == "closed", F.col("closed")).otherwise(F.col("last_id"))).withColumn("win", (F.row_number().over(of_session.orderBy("seg", "sub")) - 1).cast("long"))
    k = F.row_number().over(Window.partitionBy("queue").orderBy("done", "session_id", "win")) - 1
    return due.select("queue", "session_id", "win", "n", "first_id", "last_id", "done", "reason", F.floor(k / most).alias("job"))


def progress(rows: DataFrame) -> DataFrame:
    """scope_id, seen_at, id: the last row of each scope, in order of (updated_at, id), before the first that failed."""
    at = F.struct("updated_at", "id")
    stop = rows.filter("failed").groupBy("scope_id").agg(F.min(at).alias("stop"))
    done = rows.join(stop, "scope_id", "left").filter(F.col("stop").isNull() | (at < F.col("stop")))
    return done.groupBy("scope_id").agg(F.max(at).alias("x")).select("scope_id", F.col("x.updated_at").alias("seen_at"), F.col("x.id").alias("id"))
