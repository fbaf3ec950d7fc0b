"""Writes of a memory as transforms: each takes tables and what is to be written, and gives the rows of the next version with what became of each request."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions import dates, text
from gistmill.lineage import written
from gistmill.operators import curation, filters

MESSAGE_CHARS, CLAIM_CHARS, INFERENCE_CHARS, KIND_CHARS, REASON_CHARS = 100_000, 2_000, 200, 64, 500
ROLES = ("user", "assistant", "tool")
#: Least characters of a user's turn that is indexed.
INDEXED = 20


def add_messages(events: DataFrame, stored: DataFrame) -> DataFrame:
    """The events with outcome, content (redacted), redacted and indexed.

    An external id names a delivery of one user and source; of repeated deliveries, also within the events, the first one stays.
    """
    said = text.stripped(F.col("content"))
    key = ["user_id", "external_source", "external_id"]
    known = stored.filter("external_id IS NOT NULL").select(*[F.col(k).alias(f"known_{k}") for k in key]).distinct()
    same = [events[k].eqNullSafe(known[f"known_{k}"]) for k in key]
    nth = F.row_number().over(Window.partitionBy(*key, F.when(F.col("external_id").isNull(), F.col("id"))).orderBy("id"))
    e = events.join(known, same, "left").withColumn("nth", nth)
    again = F.col("external_id").isNotNull() & (F.col("known_external_id").isNotNull() | (F.col("nth") > 1))
    outcome = (
        F.when(said == "", "blank").when(F.length(said) > MESSAGE_CHARS, "too_long").when(~F.col("role").isin(*ROLES), "invalid_role").when(again, "duplicate").otherwise("stored")
    )
    clean = text.redact(said)
    e = e.withColumns({"outcome": outcome, "redacted": text.redactions(said) > 0, "clean": clean})
    indexed = (F.col("outcome") == "stored") & (F.col("role") == "user") & (F.length("clean") >= INDEXED)
    return e.select(*[c for c in events.columns if c != "content"], F.col("clean").alias("content"), "outcome", "redacted", indexed.alias("indexed"))


def add_claims(claims: DataFrame, now: Column) -> DataFrame:
    """The claims with reason (null: written), their redacted text and its hash, the interval of their event dates, and revision 1.

    ``claims`` has text, kind, event_dates (array), document_date and source_count.
    """
    said, kind = text.stripped(F.col("text")), text.stripped(F.col("kind"))
    reason = F.when(said == "", "blank").when(F.length(said) > CLAIM_CHARS, "too_long").when((kind == "") | (F.length(kind) > KIND_CHARS), "invalid_kind")
    out = claims.withColumns({"reason": reason, "text": text.redact(said), "redacted": text.redactions(said) > 0, "kind": kind, "event_dates": dates.event_dates(F.col("event_dates"))})
    span = dates.interval(F.col("event_dates"))
    return out.withColumns(
        {
            "content_hash": text.content_hash(F.col("text")), "event_start": span["start"], "event_end": span["end"], "revision": F.when(F.col("reason").isNull(), 1),
            "document_date": F.coalesce("document_date", now), "source_count": F.greatest(F.lit(1), "source_count"),
        }
    )


def revision_evidence(revisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """memory_id, revision, message_id: the citations of the first wording, carried on as long as the wording stays."""
    order = Window.partitionBy("memory_id").orderBy("revision")
    same = F.coalesce(F.col("text") == F.lag("text").over(order), F.lit(True))
    r = revisions.withColumn("same", same).withColumn("kept", F.min("same").over(order)).filter("kept")
    return r.select("memory_id", "revision").join(evidence.select("memory_id", "message_id"), "memory_id")


def edges_after(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """The edges without those by which a restored row was replaced."""
    gone = changed.filter("restored").select(F.col("id").alias("to_id"), F.lit("updates").alias("relation"))
    return edges.join(gone, ["to_id", "relation"], "left_anti").select(*edges.columns)


def resolved_scopes(requests: DataFrame, entities: DataFrame, memberships: DataFrame, team: str | None, write: bool = False) -> DataFrame:
    """The requests (user_id, own_scope, scope) with scope_id and outcome: ok, unknown or forbidden.

    No scope and ``private`` mean the own one; reading takes a membership of any role or what the team sees, writing an owner or member.
    """
    roles = memberships.filter(F.col("role").isin("owner", "member")) if write else memberships
    mine = roles.select("user_id", F.col("entity_id").alias("wanted"), F.lit(True).alias("mine")).distinct()
    known = entities.select(F.col("id").alias("wanted"), "archived", F.col("visibility").alias("seen"))
    wanted = F.when(F.col("scope").isNull() | F.col("scope").isin("", "private"), F.col("own_scope")).when(F.col("scope") == "team", F.lit(team)).otherwise(F.col("scope"))
    r = requests.withColumn("wanted", wanted).join(known, "wanted", "left").join(mine, ["user_id", "wanted"], "left")
    own = F.col("wanted") == F.col("own_scope")
    allowed = F.col("mine").isNotNull() if write else F.col("mine").isNotNull() | (F.col("seen") == "team")
    outcome = F.when(own, "ok").when(F.col("archived").isNull(), "unknown").when(allowed & ~F.col("archived"), "ok").otherwise("forbidden")
    r = r.withColumn("outcome", outcome)
    return r.select(*requests.columns, F.when(F.col("outcome") == "ok", F.col("wanted")).alias("scope_id"), "outcome")


def resolved_subjects(requests: DataFrame, entities: DataFrame, memberships: DataFrame) -> DataFrame:
    """The requests (user_id, subject) with subject_id and outcome; any person may be named, other entities by those who can see them; no subject is ok."""
    known = entities.select(F.col("id").alias("subject"), "kind", "visibility")
    mine = memberships.select("user_id", F.col("entity_id").alias("subject"), F.lit(True).alias("mine")).distinct()
    r = requests.join(known, "subject", "left").join(mine, ["user_id", "subject"], "left")
    none = F.col("subject").isNull() | (F.col("subject") == "")
    seen = (F.col("kind") == "user") | F.col("mine").isNotNull() | (F.col("visibility") == "team")
    outcome = F.when(none, "ok").when(F.col("kind").isNull(), "unknown").when(seen, "ok").otherwise("forbidden")
    r = r.withColumn("outcome", outcome)
    return r.select(*requests.columns, F.when(~none & (F.col("outcome") == "ok"), F.col("subject")).alias("subject_id"), "outcome")


def routed(ops: DataFrame, listed: DataFrame, aliases: DataFrame, writable: DataFrame, team: str | None) -> DataFrame:
    """The ops with to_scope, to_subject, unresolved and reason: where each is written and whom it is about.

    ``ops`` has subject, subject_name, scope, session_scope, own_scope, user_id; ``listed`` (id) are the entities that a speaker was shown,
    ``aliases`` (alias_norm, id) names, ``writable`` (user_id, entity_id) scopes.  What is said of someone else goes to the team; a name that
    is nobody's keeps a claim private, and is given back; a scope that is named but not listed, or may not be written, is refused.
    """
    side = lambda name: listed.select(F.col("id").alias(name), F.lit(True).alias(f"{name}_listed"))
    o = ops.join(side("subject"), "subject", "left").join(side("scope"), "scope", "left").withColumn("alias_norm", text.normalised(F.col("subject_name")))
    o = o.join(aliases.select("alias_norm", F.col("id").alias("alias_id")), "alias_norm", "left")
    by_ref = F.when(F.col("subject_listed"), F.col("subject"))
    named = F.nullif(F.col("subject_name"), F.lit("")).isNotNull()
    subject = F.coalesce(by_ref, F.when(named, F.col("alias_id")))
    unresolved = F.when(by_ref.isNull() & named & F.col("alias_id").isNull(), text.stripped(F.col("subject_name")))
    o = o.withColumns({"found": subject, "unresolved": unresolved})
    elsewhere = F.col("found").isNotNull() & (F.col("found") != F.col("own_scope")) & F.lit(team is not None)
    scope = F.when(F.col("unresolved").isNotNull(), F.col("own_scope")).when(F.col("scope").isNotNull(), F.col("scope")).when(elsewhere, F.lit(team)).otherwise(F.col("session_scope"))
    o = o.withColumns({"to_scope": scope, "to_subject": F.when(F.col("unresolved").isNull(), F.col("found"))})
    w = writable.select("user_id", F.col("entity_id").alias("to_scope"), F.lit(True).alias("may")).distinct()
    o = o.join(w, ["user_id", "to_scope"], "left")
    reason = F.when(F.col("scope").isNotNull() & F.col("scope_listed").isNull(), "unknown_entity").when(F.col("may").isNull() & (F.col("to_scope") != F.col("own_scope")), "scope_not_allowed")
    o = o.withColumn("reason", reason)
    ok = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return o.select(*ops.columns, ok("to_scope"), ok("to_subject"), ok("unresolved"), "reason")


def links(answers: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """cluster, nth, from_id, to_id, relation, reason (null: written) of links that a cluster's answer proposes.

    ``answers`` has cluster, nth, from_id, to_id, relation; ``rows`` id, scope_id, subject_id, context, source_role, document_date and what tells live rows.
    A replacement is said no earlier, of the same subject in the same context, by a trusted role.  Links are taken in order: what one has replaced
    is no longer live for later ones.  A cluster has a bounded number of links.
    """
    ends = rows.select("id", F.struct(filters.live(now).alias("live"), "document_date", "subject_id", "context", "source_role").alias("x"))
    a = answers.join(ends.select(F.col("id").alias("from_id"), F.col("x").alias("new")), "from_id", "left").join(ends.select(F.col("id").alias("to_id"), F.col("x").alias("old")), "to_id", "left")
    wrong = F.col("from_id").isNull() | F.col("to_id").isNull() | (F.col("from_id") == F.col("to_id")) | ~F.col("relation").isin("updates", "extends") | F.col("relation").isNull()
    dead = ~F.coalesce(F.col("new.live"), F.lit(False)) | ~F.coalesce(F.col("old.live"), F.lit(False))
    same = F.col("new.subject_id").eqNullSafe(F.col("old.subject_id")) & (F.col("new.context") == F.col("old.context"))
    forward = (F.col("new.document_date") >= F.col("old.document_date")) & same & F.col("new.source_role").isin(*curation.TRUSTED)
    own = F.when(wrong, "invalid_link").when(dead, "link_target_changed").when((F.col("relation") == "updates") & ~F.coalesce(forward, F.lit(False)), "update_not_forward")
    item = F.struct("nth", "from_id", "to_id", "relation", own.alias("reason"))
    start = F.struct(F.array().cast("array<string>").alias("gone"), F.array().cast("array<struct<nth:int,from_id:string,to_id:string,relation:string,reason:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        lost = F.array_contains(s["gone"], x["from_id"]) | F.array_contains(s["gone"], x["to_id"])
        reason = F.when((x["reason"].isNull() | (x["reason"] == "update_not_forward")) & lost, F.lit("link_target_changed")).otherwise(x["reason"])
        taken = reason.isNull() & (x["relation"] == "updates")
        row = F.struct(x["nth"].cast("int").alias("nth"), x["from_id"].alias("from_id"), x["to_id"].alias("to_id"), x["relation"].alias("relation"), reason.alias("reason"))
        return F.struct(F.when(taken, F.array_append(s["gone"], x["to_id"])).otherwise(s["gone"]).alias("gone"), F.array_append(s["out"], row).alias("out"))

    folded = a.groupBy("cluster").agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step, lambda s: s["out"]).alias("out"))
    return folded.select("cluster", F.explode("out").alias("x")).select("cluster", "x.*")


def inferences(answers: DataFrame, rows: DataFrame, stated: DataFrame, now: Column, most: int = 2, least_confidence: float = 0.7, replaced: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """cluster, nth, reason (null: written), importance, document_date, subject_id of the inferences that the answers of a pass propose.

    ``answers`` has cluster, nth, scope_id, text, confidence, premises (array of ids); ``stated`` scope_id and content_hash of what is said already, and ``near`` cluster and nth of
    those whose vector says nearly what an active claim of the scope says.  ``replaced`` (cluster, id) are claims that links of the same answer have replaced: they are premises no more.
    Clusters are taken in order, so what one has written is said already for the next ones of its scope; once ``most`` of a cluster are written, later ones are ``beyond``.
    A cluster has a bounded number of inferences, a scope any number of clusters.
    """
    said = text.stripped(F.coalesce("text", F.lit("")))
    a = answers.withColumns({"premises": F.array_distinct(F.array_compact("premises")), "said": said, "h": text.content_hash(said)})
    live = rows.filter(filters.live(now)).select(F.col("id").alias("premise"), F.col("importance").cast("double").alias("importance"), "document_date", "subject_id")
    each = a.select("cluster", "nth", F.explode_outer("premises").alias("premise"))
    if replaced is not None:
        gone = replaced.select("cluster", F.col("id").alias("premise"), F.lit(True).alias("gone")).distinct()
        each = each.join(gone, ["cluster", "premise"], "left")
    else:
        each = each.withColumn("gone", F.lit(None).cast("boolean"))
    each = each.join(live, "premise", "left")
    p = each.groupBy("cluster", "nth").agg(
        F.count_if(F.col("document_date").isNull() | F.col("gone").isNotNull()).alias("lost"), F.max("importance").alias("importance"), F.max("document_date").alias("document_date"),
        F.when((F.count_distinct("subject_id") == 1) & (F.count("subject_id") == F.count("premise")), F.min("subject_id")).alias("subject_id"),
    )
    known = stated.select("scope_id", F.col("content_hash").alias("h"), F.lit(True).alias("known")).distinct()
    a = a.join(p, ["cluster", "nth"]).join(known, ["scope_id", "h"], "left")
    a = a.join(near.select("cluster", "nth", F.lit(True).alias("near")).distinct(), ["cluster", "nth"], "left") if near is not None else a.withColumn("near", F.lit(None).cast("boolean"))
    sure = F.coalesce(F.nanvl("confidence", F.lit(0.0)), F.lit(0.0))
    reason = (
        F.when((F.col("said") == "") | (F.length("said") > INFERENCE_CHARS) | (F.size("premises") < 2), "invalid_inference").when(sure < least_confidence, "low_confidence")
        .when(F.col("lost") > 0, "premise_changed").when(F.col("known").isNotNull() | F.col("near").isNotNull(), "already_stated")
    )
    a = written(a.select("scope_id", "cluster", "nth", "h", reason.alias("own"), "importance", "document_date", "subject_id"))
    inside = Window.partitionBy("scope_id", "cluster").orderBy("nth", "own", "h")  # of one cluster
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    first = a.filter("own IS NULL").groupBy("scope_id", "cluster", "h").agg(F.min("nth").alias("nth"))
    said_by = _written_ones(first, most).select("scope_id", "cluster", "nth", "h", F.lit(True).alias("writes"))
    # the first of equal wordings in an answer, should some share a place too
    copy = F.row_number().over(Window.partitionBy("scope_id", "cluster", "nth", "h").orderBy(F.col("own").isNotNull()))
    told = a.withColumn("copy", copy).join(said_by, _null_safe(a, said_by, "scope_id", "cluster", "nth", "h"), "left").select(*[a[c] for c in a.columns], (F.col("writes").isNotNull() & F.col("own").isNull() & (F.col("copy") == 1)).alias("writes"))
    had = F.coalesce(F.count_if("writes").over(before), F.lit(0))
    why = F.when(had >= most, "beyond").when(~F.col("writes") & F.col("own").isNull(), "already_stated").otherwise(F.col("own"))
    ok = F.col("reason").isNull()
    return told.withColumn("reason", why).select(
        "cluster", "nth", "reason", F.when(ok, F.least(F.lit(0.6), "importance")).alias("importance"), F.when(ok, F.col("document_date")).alias("document_date"), F.when(ok, F.col("subject_id")).alias("subject_id")
    )


def _null_safe(x: DataFrame, y: DataFrame, *columns: str) -> Column:
    return functools.reduce(operator.and_, [x[c].eqNullSafe(y[c]) for c in columns])


def _written_ones(first: DataFrame, most: int) -> DataFrame:
    """Of the wordings that clusters propose (scope_id, cluster, nth, h, each once in a cluster), those that are written: at most ``most`` of a cluster, and none that an earlier cluster of the scope has written.

    Whether one is written hangs on earlier ones, but mostly on few: each round tells from what is known which are ``out``, since an earlier cluster has written their wording for sure, and which
    are ``free``, since none can have.  A round settles at least the first open one of every scope, and all that hang on nothing else; there are as many rounds as the longest chain of
    wordings that hang on each other.  No scope and no wording is brought together in one task, but for the few values that tell its state.
    """
    inside = Window.partitionBy("scope_id", "cluster").orderBy("nth", "h")
    state = written(first.withColumns({"out": F.lit(False), "free": F.lit(False)}))
    while True:
        # the place in the cluster if all that are open before are out, and if none is
        low = F.count_if("free").over(inside.rowsBetween(Window.unboundedPreceding, -1)) + 1
        high = F.count_if(~F.col("out")).over(inside.rowsBetween(Window.unboundedPreceding, -1)) + 1
        placed = state.withColumns({"low": low, "high": high})
        can, must = ~F.col("out") & (F.col("low") <= most), ~F.col("out") & (F.col("high") <= most)
        known = placed.groupBy(F.col("scope_id").alias("s"), F.col("h").alias("w")).agg(F.min(F.when(can, F.col("cluster"))).alias("earliest"), F.min(F.when(must, F.col("cluster"))).alias("sure"))
        j = placed.join(known, F.col("scope_id").eqNullSafe(F.col("s")) & (F.col("h") == F.col("w")))
        out = F.col("out") | F.coalesce(F.col("cluster") > F.col("sure"), F.lit(False))
        free = ~out & F.coalesce(F.col("cluster") <= F.col("earliest"), F.lit(True))
        state = written(j.select("scope_id", "cluster", "nth", "h", out.alias("out"), (F.col("free") | free).alias("free")))
        if state.filter("NOT out AND NOT free").isEmpty():
            break
    return state.filter("free").withColumn("place", F.row_number().over(inside)).filter(F.col("place") <= most)


def consolidation(rows: DataFrame, now: Column, cosine: float) -> DataFrame:
    """action, id, survivor of what a pass would do to live rows (with identity columns and v): expired, demoted, duplicate, merge, oversized."""
    from gistmill.operators import graph

    gone = curation.expired(rows, now).select(F.lit("expired").alias("action"), "id", F.lit(None).cast("string").alias("survivor"))
    idle = curation.demoted(rows, now).select(F.lit("demoted"), "id", F.lit(None).cast("string"))
    live = rows.filter(filters.live(now)).withColumns({"identity": curation.identity(), "wording": text.normalised(F.col("text"))})
    groups = live.groupBy("identity", "wording").agg(F.max_by("id", F.struct("updated_at", "id")).alias("survivor"), F.count("*").alias("n")).filter("n > 1")
    same = live.join(groups, ["identity", "wording"]).filter("id != survivor").select(F.lit("duplicate"), "id", "survivor")
    near = graph.semantic_groups(graph.similar_pairs(live.select("id", "v", "identity"), cosine, "identity"), live.select("id", "wording"))
    newest = near.join(live.select(F.col("id").alias("node"), "updated_at"), "node").groupBy("cluster").agg(F.max_by("node", F.struct("updated_at", "node")).alias("survivor"))
    merge = near.join(newest, "cluster").select(F.when(F.col("oversized"), "oversized").otherwise("merge"), F.col("node"), F.when(~F.col("oversized"), F.col("survivor")))
    return gone.unionAll(idle).unionAll(same).unionAll(merge)


def forgotten(candidates: DataFrame, rows: DataFrame, scopes: DataFrame, most: int, threshold: float | None = None, verdicts: DataFrame | None = None, dry_run: bool = True) -> DataFrame:
    """id, score, verified, forgotten: what a request to forget finds, best first, ``most`` rows at most, and whether it goes.

    ``candidates`` are the ids named (id), or rows that a search found (id, score), of which those of at least ``threshold`` count.  Only active rows in ``scopes`` (scope_id) that may be written are
    found.  With ``verdicts`` (id) of a judge, none but the rows that it names stay.  A dry run changes nothing; its ids, named in a second request, are what was reviewed.
    """
    score = F.col("score") if "score" in candidates.columns else F.lit(1.0)
    named = candidates.select("id", score.alias("score")).groupBy("id").agg(F.max("score").alias("score"))
    found = named if threshold is None else named.filter(F.col("score") >= threshold)
    found = found.join(rows.filter("status = 'active'").join(scopes.select("scope_id").distinct(), "scope_id", "left_semi").select("id", "updated_at"), "id")
    if verdicts is not None:
        found = found.join(verdicts.select("id").distinct(), "id", "left_semi")
    top = found.orderBy(F.desc("score"), F.desc("updated_at"), "id").limit(most)
    return top.select("id", "score", F.lit(verdicts is not None).alias("verified"), F.lit(not dry_run).alias("forgotten"))


def patched_users(users: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """The users (user_id, display_name, role, disabled_at) after patches (user_id, display_name, role, disabled), at most one for each.

    Null says nothing, as does a name of white space or a role that there is not; who is disabled again stays so since the first time.
    """
    name, role = F.nullif(text.stripped(F.col("p.display_name")), F.lit("")), F.when(F.col("p.role").isin("admin", "member"), F.col("p.role"))
    disabled = F.when(F.col("p.disabled").isNull(), F.col("disabled_at")).when(F.col("p.disabled"), F.coalesce("disabled_at", now))
    j = users.join(patches.select("user_id", F.struct("display_name", "role", "disabled").alias("p")), "user_id", "left")
    return j.select("user_id", F.coalesce(name, "display_name").alias("display_name"), F.coalesce(role, "role").alias("role"), disabled.alias("disabled_at"))


def erased(rows: DataFrame, evidence: DataFrame, messages: DataFrame, user_id: int, own_scope: str) -> DataFrame:
    """The rows that an erasure leaves, with subject_id and superseded_by cleared where they named the user or what is gone, the next revision where that, and mentions counted anew.

    Gone are the user's own scope and inferences made for them elsewhere; the user's messages no longer count as mentions.
    """
    gone = rows.filter((F.col("scope_id") == own_scope) | ((F.col("author_id") == user_id) & (F.col("source_role") == "inference"))).select(F.col("id").alias("superseded_by"), F.lit(True).alias("lost"))
    left = rows.filter((F.col("scope_id") != own_scope) & ~((F.col("author_id") == user_id) & (F.col("source_role") == "inference"))).join(gone, "superseded_by", "left")
    about = F.coalesce(F.col("subject_id") == user_id, F.lit(False))
    touched = about | F.col("lost").isNotNull()
    theirs = messages.filter(F.col("user_id") == user_id).select(F.col("id").alias("message_id"))
    sessions = messages.select(F.col("id").alias("message_id"), "session_id")
    cited = evidence.join(theirs, "message_id", "left_semi").select(F.col("memory_id").alias("id"), F.lit(True).alias("recount")).distinct()
    kept = evidence.join(theirs, "message_id", "left_anti").join(sessions, "message_id").groupBy(F.col("memory_id").alias("id")).agg(F.count_distinct("session_id").alias("n"))
    out = left.join(cited, "id", "left").join(kept, "id", "left")
    return out.select(
        "id", F.when(~about, F.col("subject_id")).alias("subject_id"), F.when(F.col("lost").isNull(), F.col("superseded_by")).alias("superseded_by"), (F.col("revision") + touched.cast("int")).alias("revision"),
        F.when(F.col("recount"), F.greatest(F.lit(1), F.coalesce("n", F.lit(0)))).otherwise(F.col("source_count")).alias("source_count"),
    )


def erased_tables(tables: dict[str, DataFrame], user_id: int, own_scope: str, own_entity: str) -> dict[str, DataFrame]:
    """The next version of every table once a user is erased: what is theirs goes, with all that hangs on it; what others have said stays, without naming them.

    ``tables`` are those of ``lineage_sets.export``, with outbox where there is one.  Work for an index goes where its row is gone, and a row that
    stays and has changed is due there again.
    """
    memories, messages = tables["memories"], tables["messages"]
    gone = memories.filter((F.col("scope_id") == own_scope) | ((F.col("author_id") == user_id) & (F.col("source_role") == "inference"))).select("id")
    theirs = messages.filter(F.col("user_id") == user_id).select("id")
    runs = tables["runs"].filter(F.col("user_id") == user_id).select("id")
    without = lambda rows, column, ids: rows.join(ids.select(F.col("id").alias(column)), column, "left_anti").select(*rows.columns)
    others = lambda name: tables[name].filter(~F.col("user_id").eqNullSafe(user_id))
    cited = lambda name: without(without(tables[name], "memory_id", gone), "message_id", theirs)
    out = {
        "memories": erased(memories, tables["evidence"], messages, user_id, own_scope), "revisions": without(tables["revisions"], "memory_id", gone), "sources": cited("sources"), "evidence": cited("evidence"),
        "relations": without(without(tables["relations"], "from_id", gone), "to_id", gone), "feedback": without(without(tables["feedback"], "memory_id", gone), "run_id", runs),
        "entities": tables["entities"].filter(F.col("id") != own_entity), "memberships": others("memberships").filter(F.col("entity_id") != own_entity),
    }
    out |= {name: others(name) for name in ("users", "api_keys", "messages", "attention", "runs", "calls")}
    if "outbox" in tables:
        left = tables["outbox"]
        lost = gone.select(F.lit("memories").alias("collection"), F.col("id").cast("string").alias("entity_id")).unionAll(theirs.select(F.lit("raw"), F.col("id").cast("string")))
        out["outbox"] = left.join(lost, ["collection", "entity_id"], "left_anti").select(*left.columns)
    return out


def index_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, operation: what an index of the rows (id, revision) has to do between two versions of a table."""
    old, new = before.select("id", F.col("revision").alias("had")), after.select("id", F.col("revision").alias("has"))
    both = old.join(new, "id", "full")
    return both.filter(~F.col("had").eqNullSafe(F.col("has"))).select("id", F.when(F.col("has").isNull(), "delete").otherwise("upsert").alias("operation"))
