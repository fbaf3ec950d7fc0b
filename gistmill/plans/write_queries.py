"""Queries on writes: messages, claims, revisions, routing, operations, consolidation, links and inferences, erasure."""

from __future__ import annotations

from pyspark.sql import functions as F

from gistmill.functions import text
from gistmill.lineage import written
from gistmill.operators import curation, folds, graph, merging, writes
from gistmill.plans.registry import query
from gistmill.sources import fixtures as fx

NOW = f"TIMESTAMP '{fx.NOW}'"
LIVE = f"status = 'active' AND (valid_until IS NULL OR valid_until > {NOW})"
_STRIPPED = text.stripped_sql("content")
_CLEAN, _COUNT = text.redacted_sql("said")
_NORM = text.normalised_sql("text")

_EVENTS = "SELECT id, user_id, role, CASE WHEN id % 97 = 0 THEN ' \t ' ELSE content END AS content, 'chat' AS external_source, CASE WHEN turn % 5 <> 4 THEN sha256(content) END AS external_id, session_id FROM messages"


@query("add_messages", f"""WITH e AS ({_EVENTS}), k AS (SELECT DISTINCT user_id, external_source, external_id FROM e WHERE session_id % 3 = 0 AND external_id IS NOT NULL),
 n AS (SELECT e.*, {_STRIPPED} AS said, k.external_id IS NOT NULL AS known, row_number() OVER (PARTITION BY e.user_id, e.external_id, CASE WHEN e.external_id IS NULL THEN id END ORDER BY id) AS nth FROM e LEFT JOIN k ON k.user_id = e.user_id AND k.external_id = e.external_id WHERE session_id % 3 <> 0),
 o AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN length(said) > 100000 THEN 'too_long' WHEN role NOT IN ('user', 'assistant', 'tool') THEN 'invalid_role' WHEN external_id IS NOT NULL AND (known OR nth > 1) THEN 'duplicate' ELSE 'stored' END AS outcome, {_CLEAN} AS clean, {_COUNT} > 0 AS redacted FROM n)
 SELECT id, outcome, redacted, outcome = 'stored' AND role = 'user' AND length(clean) >= 20 AS indexed FROM o""")
def add_messages(spark, sf):
    """Deliveries of two thirds of the sessions, to a store that holds the others."""
    g = fx.messages(spark, sf)
    content = F.when(F.col("id") % 97 == 0, F.lit(" \t ")).otherwise(F.col("content"))
    g = g.select("id", "user_id", "role", content.alias("content"), F.lit("chat").alias("external_source"), F.when(F.col("turn") % 5 != 4, F.sha2(F.col("content").cast("binary"), 256)).alias("external_id"), "session_id")
    out = writes.add_messages(g.filter("session_id % 3 != 0"), g.filter("session_id % 3 = 0"))
    return out.select("id", "outcome", "redacted", "indexed")


@query("add_claims", f"""WITH c AS (SELECT no, {text.stripped_sql('text')} AS said, CASE WHEN no % 50 = 9 THEN ' ' ELSE kind END AS kind, CASE no % 3 WHEN 0 THEN '2023-0' || CAST(no % 9 + 1 AS VARCHAR) WHEN 1 THEN 'soon' ELSE '2024' END AS p, CASE WHEN no % 2 = 0 THEN document_date END AS document_date, source_count - 3 AS source_count FROM memories),
 d AS (SELECT *, {_CLEAN} AS clean, {_COUNT} > 0 AS redacted, CASE WHEN length(p) = 4 AND p <> 'soon' THEN make_date(2024, 1, 1) WHEN length(p) = 7 THEN CAST(p || '-01' AS DATE) END AS a FROM c)
 SELECT no, CASE WHEN said = '' THEN 'blank' WHEN length(said) > 2000 THEN 'too_long' WHEN trim(kind) = '' THEN 'invalid_kind' END AS reason, redacted, sha256({text.normalised_sql('clean')}) AS content_hash, CAST(a AS TIMESTAMP) AS event_start,
 CAST(CASE WHEN p = '2024' THEN make_date(2024, 12, 31) ELSE last_day(a) END AS TIMESTAMP) + to_seconds(86399) AS event_end, CASE WHEN NOT (said = '' OR length(said) > 2000 OR trim(kind) = '') THEN 1 END AS revision, coalesce(document_date, {NOW}) AS document_date, greatest(1, source_count) AS source_count FROM d""")
def add_claims(spark, sf):
    n = F.col("no")
    p = F.when(n % 3 == 0, F.concat(F.lit("2023-0"), (n % 9 + 1).cast("string"))).when(n % 3 == 1, "soon").otherwise("2024")
    c = fx.memories(spark, sf).select("no", "text", F.when(n % 50 == 9, " ").otherwise(F.col("kind")).alias("kind"), F.array(p).alias("event_dates"), F.when(n % 2 == 0, F.col("document_date")).alias("document_date"), (F.col("source_count") - 3).alias("source_count"))
    return writes.add_claims(c, fx.now()).select("no", "reason", "redacted", "content_hash", "event_start", "event_end", "revision", "document_date", "source_count")


@query("revision_evidence", """WITH r AS (SELECT *, coalesce(text = lag(text) OVER (PARTITION BY memory_id ORDER BY revision), true) AS same FROM revisions), k AS (SELECT *, bool_and(same) OVER (PARTITION BY memory_id ORDER BY revision) AS kept FROM r)
 SELECT k.memory_id, revision, message_id FROM k JOIN evidence e ON e.memory_id = k.memory_id WHERE kept""")
def revision_evidence(spark, sf):
    return writes.revision_evidence(fx.revisions(spark, sf), fx.evidence(spark, sf))


_CHANGES = "SELECT id, k, CASE (no + k) % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'archived' ELSE 'superseded' END AS to_status, CASE WHEN no % 10 = 7 AND k = 0 THEN revision + 1 WHEN no % 2 = 0 THEN revision + k END AS expected, ' why ' AS reason FROM (SELECT *, unnest(range(0, 1 + no % 4)) AS k FROM memories)"
_STATUS = f"""c AS ({_CHANGES}), b AS (SELECT r.memory_id, arg_max(struct_pack(v := r.valid_until), r.revision).v AS before FROM revisions r JOIN memories m ON m.id = r.memory_id WHERE r.status <> 'superseded' AND r.revision < m.revision GROUP BY r.memory_id),
 f AS (SELECT id, CAST(-1 AS BIGINT) AS k, status, valid_until, before AS good, CAST(NULL AS VARCHAR) AS why, CAST(revision AS BIGINT) AS revision, CAST(0 AS BIGINT) AS conflicts, false AS restored FROM memories LEFT JOIN b ON b.memory_id = id
 UNION ALL SELECT id, k, CASE WHEN stale THEN status ELSE to_status END, CASE WHEN back THEN good ELSE valid_until END, CASE WHEN NOT stale AND status <> 'superseded' THEN valid_until ELSE good END, CASE WHEN stale THEN why WHEN to_status <> 'active' THEN 'why' END,
  revision + CASE WHEN stale THEN 0 ELSE 1 END, conflicts + CASE WHEN stale THEN 1 ELSE 0 END, restored OR back
  FROM (SELECT f.*EXCLUDE (k), c.k, to_status, coalesce(expected <> revision, false) AS stale, NOT coalesce(expected <> revision, false) AND to_status = 'active' AND status = 'superseded' AS back FROM f JOIN c ON c.id = f.id AND c.k = f.k + 1)),
 z AS (SELECT id, arg_max(status, k) AS status, arg_max(struct_pack(v := valid_until), k).v AS valid_until, arg_max(struct_pack(v := why), k).v AS forget_reason, max(revision) AS revision, max(conflicts) AS conflicts, bool_or(restored) AS restored FROM f GROUP BY id)"""


@query("set_status", f"WITH RECURSIVE {_STATUS} SELECT * FROM z")
def set_status(spark, sf):
    """Up to four changes of one memory's status, in order."""
    m, n, k = fx.memories(spark, sf), F.col("no"), F.col("k")
    to = F.when((n + k) % 3 == 0, "active").when((n + k) % 3 == 1, "archived").otherwise("superseded")
    expected = F.when((n % 10 == 7) & (k == 0), F.col("revision") + 1).when(n % 2 == 0, F.col("revision") + k)
    changes = m.withColumn("k", F.explode(F.sequence(F.lit(0), (n % 4).cast("int")))).select("id", k.alias("nth"), to.alias("to_status"), expected.alias("expected_revision"), F.lit(" why ").alias("reason"))
    return folds.status_changes(m.select("id", "status", "valid_until", "revision"), changes, fx.revisions(spark, sf), writes.REASON_CHARS)


@query("restored_edges", f"WITH RECURSIVE {_STATUS} SELECT from_id, to_id, relation FROM relations r WHERE NOT (relation = 'updates' AND to_id IN (SELECT id FROM z WHERE restored))")
def restored_edges(spark, sf):
    return writes.edges_after(fx.relations(spark, sf), set_status(spark, sf))


_WANTED = "CASE no % 6 WHEN 0 THEN 'private' WHEN 1 THEN 'team' WHEN 2 THEN scope_id WHEN 3 THEN 'nowhere' WHEN 4 THEN NULL ELSE 'src19' END"
_MINE = "SELECT DISTINCT user_id, entity_id FROM memberships"


def _requests(spark, sf):
    n = F.col("no")
    wanted = F.when(n % 6 == 0, "private").when(n % 6 == 1, "team").when(n % 6 == 2, F.col("scope_id")).when(n % 6 == 3, "nowhere").when(n % 6 == 5, "src19")
    return fx.memories(spark, sf).select("id", F.col("author_id").alias("user_id"), F.concat(F.lit("user"), F.col("author_id").cast("string")).alias("own_scope"), wanted.alias("scope"))


for _name, _write in (("read", False), ("write", True)):

    @query(f"resolve_scopes_{_name}", f"""WITH r AS (SELECT id, author_id AS user_id, 'user' || CAST(author_id AS VARCHAR) AS own, {_WANTED} AS scope FROM memories), w AS (SELECT *, CASE WHEN scope IS NULL OR scope = 'private' THEN own WHEN scope = 'team' THEN 'src0' ELSE scope END AS wanted FROM r),
     m AS ({_MINE}{" WHERE role IN ('owner', 'member')" if _write else ""}), o AS (SELECT w.*, CASE WHEN wanted = own THEN 'ok' WHEN e.id IS NULL THEN 'unknown' WHEN (m.user_id IS NOT NULL{"" if _write else " OR e.visibility = 'team'"}) AND NOT e.archived THEN 'ok' ELSE 'forbidden' END AS outcome
     FROM w LEFT JOIN entities e ON e.id = w.wanted LEFT JOIN m ON m.user_id = w.user_id AND m.entity_id = w.wanted) SELECT id, scope, CASE WHEN outcome = 'ok' THEN wanted END AS scope_id, outcome FROM o""")
    def resolve_scopes(spark, sf, write=_write):
        return writes.resolved_scopes(_requests(spark, sf), fx.entities(spark, sf), fx.memberships(spark, sf), "src0", write).select("id", "scope", "scope_id", "outcome")


@query("resolve_subjects", f"""WITH r AS (SELECT id, author_id AS user_id, CASE no % 5 WHEN 0 THEN 'user' || CAST(no % 400 AS VARCHAR) WHEN 1 THEN scope_id WHEN 2 THEN '' WHEN 3 THEN 'nobody' END AS subject FROM memories),
 o AS (SELECT r.*, CASE WHEN subject IS NULL OR subject = '' THEN 'ok' WHEN e.id IS NULL THEN 'unknown' WHEN e.kind = 'user' OR m.user_id IS NOT NULL OR e.visibility = 'team' THEN 'ok' ELSE 'forbidden' END AS outcome FROM r LEFT JOIN entities e ON e.id = r.subject LEFT JOIN ({_MINE}) m ON m.user_id = r.user_id AND m.entity_id = r.subject)
 SELECT id, CASE WHEN outcome = 'ok' THEN nullif(subject, '') END AS subject_id, outcome FROM o""")
def resolve_subjects(spark, sf):
    n = F.col("no")
    subject = F.when(n % 5 == 0, F.concat(F.lit("user"), (n % 400).cast("string"))).when(n % 5 == 1, F.col("scope_id")).when(n % 5 == 2, "").when(n % 5 == 3, "nobody")
    r = fx.memories(spark, sf).select("id", F.col("author_id").alias("user_id"), subject.alias("subject"))
    return writes.resolved_subjects(r, fx.entities(spark, sf), fx.memberships(spark, sf)).select("id", "subject_id", "outcome")


_ROUTES = """SELECT id, author_id AS user_id, 'user' || CAST(author_id AS VARCHAR) AS own, scope_id AS session, CASE no % 5 WHEN 1 THEN 'user' || CAST(no % 400 + 1 AS VARCHAR) END AS subject, CASE no % 5 WHEN 2 THEN ' Customer#' || lpad(CAST(no % 50 + 1 AS VARCHAR), 9, '0') WHEN 3 THEN 'Nobody Known' END AS name,
 CASE no % 7 WHEN 1 THEN 'src' || CAST(no % 20 AS VARCHAR) WHEN 2 THEN 'srcX' END AS scope FROM memories"""


@query("route_ops", f"""WITH r AS ({_ROUTES}), a AS (SELECT {text.normalised_sql('c_name')} AS alias, 'user' || CAST(c_custkey AS VARCHAR) AS id FROM customer),
 f AS (SELECT r.*, CASE WHEN e.id IS NOT NULL THEN subject ELSE a.id END AS found, CASE WHEN e.id IS NULL AND name IS NOT NULL AND a.id IS NULL THEN trim(name) END AS unresolved, z.id IS NOT NULL AS listed FROM r LEFT JOIN entities e ON e.id = r.subject LEFT JOIN a ON a.alias = {text.normalised_sql('name')} LEFT JOIN entities z ON z.id = r.scope),
 t AS (SELECT *, CASE WHEN unresolved IS NOT NULL THEN own WHEN scope IS NOT NULL THEN scope WHEN found IS NOT NULL AND found <> own THEN 'src0' ELSE session END AS to_scope FROM f),
 o AS (SELECT t.*, CASE WHEN scope IS NOT NULL AND NOT listed THEN 'unknown_entity' WHEN w.user_id IS NULL AND to_scope <> own THEN 'scope_not_allowed' END AS reason FROM t LEFT JOIN ({_MINE} WHERE role IN ('owner', 'member')) w ON w.user_id = t.user_id AND w.entity_id = t.to_scope)
 SELECT id, CASE WHEN reason IS NULL THEN to_scope END AS to_scope, CASE WHEN reason IS NULL AND unresolved IS NULL THEN found END AS to_subject, CASE WHEN reason IS NULL THEN unresolved END AS unresolved, reason FROM o""")
def route_ops(spark, sf):
    n = F.col("no")
    ops = fx.memories(spark, sf).select(
        "id", F.col("author_id").alias("user_id"), F.concat(F.lit("user"), F.col("author_id").cast("string")).alias("own_scope"), F.col("scope_id").alias("session_scope"), F.when(n % 5 == 1, F.concat(F.lit("user"), (n % 400 + 1).cast("string"))).alias("subject"),
        F.when(n % 5 == 2, F.concat(F.lit(" Customer#"), F.lpad((n % 50 + 1).cast("string"), 9, "0"))).when(n % 5 == 3, "Nobody Known").alias("subject_name"), F.when(n % 7 == 1, F.concat(F.lit("src"), (n % 20).cast("string"))).when(n % 7 == 2, "srcX").alias("scope"),
    )
    aliases = fx.table(spark, sf, "customer").select(text.normalised(F.col("c_name")).alias("alias_norm"), F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("id"))
    writable = fx.memberships(spark, sf).filter(F.col("role").isin("owner", "member"))
    return writes.routed(ops, fx.entities(spark, sf), aliases, writable, "src0").select("id", "to_scope", "to_subject", "unresolved", "reason")


_MANY_OPS = """SELECT id, k, no * 10 + k AS nth, CASE (no + k) % 5 WHEN 0 THEN 'ADD' WHEN 3 THEN 'DELETE' ELSE 'UPDATE' END AS op, CASE WHEN (no + k) % 5 = 2 THEN 'supersede' END AS change, 'n' || id || '-' || CAST(k AS VARCHAR) AS new_id, CASE WHEN no % 3 <> 1 THEN 'edit' || CAST(k AS VARCHAR) END AS new_kind,
 CASE WHEN no % 7 <> 6 THEN document_date + to_days(CAST(k * 4 - 5 AS INTEGER)) END AS said, CASE WHEN no % 4 = 1 THEN TIMESTAMP '2024-06-01' END AS until, CASE WHEN (no + k) % 5 = 4 THEN revision + k % 2 END AS expected, CASE WHEN no % 9 = 5 AND k = 0 THEN 'evidence_invalid' END AS reason FROM (SELECT *, unnest(range(0, 1 + no % 4)) AS k FROM memories)"""
_FOLDED = f"""o AS ({_MANY_OPS}), f AS (SELECT id, CAST(-1 AS BIGINT) AS k, kind, status, review_status, CAST(revision AS BIGINT) AS revision, document_date, CAST(NULL AS VARCHAR) AS superseded_by, valid_until, CAST(NULL AS VARCHAR) AS outcome, document_date AS was, kind AS had FROM memories
 UNION ALL SELECT id, k, CASE WHEN outcome = 'updated' THEN coalesce(new_kind, kind) ELSE kind END, CASE WHEN outcome = 'deleted' THEN 'archived' WHEN forward THEN 'superseded' ELSE status END, CASE WHEN outcome = 'updated' THEN 'pending' ELSE review_status END,
  revision + CASE WHEN outcome IN ('deleted', 'updated') OR forward THEN 1 ELSE 0 END, CASE WHEN outcome = 'updated' THEN coalesce(said, document_date) ELSE document_date END, CASE WHEN forward THEN new_id ELSE superseded_by END,
  CASE WHEN outcome = 'updated' THEN coalesce(until, valid_until) WHEN forward THEN least(coalesce(said, {NOW}), valid_until) ELSE valid_until END, outcome, document_date, kind
  FROM (SELECT *, outcome = 'superseded' AND NOT coalesce(said < document_date, false) AS forward FROM (SELECT f.*EXCLUDE (k, outcome), o.*EXCLUDE (id), CASE WHEN reason IS NOT NULL THEN reason WHEN op = 'ADD' THEN 'added' WHEN status <> 'active' THEN 'skipped' WHEN coalesce(expected <> revision, false) THEN 'conflict' WHEN op = 'DELETE' THEN 'deleted' WHEN change IS NOT NULL THEN 'superseded' ELSE 'updated' END AS outcome FROM f JOIN o ON o.id = f.id AND o.k = f.k + 1)))"""


def _folded(spark, sf):
    """Up to four operations on one memory, one after the other; and the operations."""
    m, n, k = fx.memories(spark, sf), F.col("no"), F.col("k")
    rows = m.select("id", "kind", "text", "status", "review_status", "revision", "document_date", F.lit(None).cast("string").alias("superseded_by"), "valid_until")
    at = (n + k) % 5
    ops = m.withColumn("k", F.explode(F.sequence(F.lit(0), (n % 4).cast("int")))).select(
        (n * 10 + k).alias("nth"), F.when(at == 0, "ADD").when(at == 3, "DELETE").otherwise("UPDATE").alias("op"), "id", F.concat(F.lit("n"), "id", F.lit("-"), k.cast("string")).alias("new_id"), F.lit("new").alias("text"),
        F.when(n % 3 != 1, F.concat(F.lit("edit"), k.cast("string"))).alias("kind"), F.when(at == 2, "supersede").alias("change"), F.when(n % 7 != 6, F.col("document_date") + F.make_dt_interval(k * 4 - 5)).alias("said"),
        F.when(n % 4 == 1, F.lit("2024-06-01").cast("timestamp")).alias("valid_until"), F.when(at == 4, F.col("revision") + k % 2).alias("expected_revision"), F.when((n % 9 == 5) & (k == 0), "evidence_invalid").alias("reason"),
    )
    return folds.operations(rows, ops, fx.now()), ops


@query("applied_ops", f"""WITH RECURSIVE {_FOLDED}, s AS (SELECT f.*, o.new_id, o.new_kind, o.said, o.until, coalesce(o.said < was, false) AS late FROM f JOIN o ON o.id = f.id AND o.k = f.k)
 SELECT id, arg_max(kind, k) AS kind, arg_max(status, k) AS status, arg_max(review_status, k) AS review_status, max(revision) AS revision, arg_max(document_date, k) AS document_date, arg_max(struct_pack(v := superseded_by), k).v AS superseded_by, arg_max(struct_pack(v := valid_until), k).v AS valid_until FROM f GROUP BY id
 UNION ALL SELECT new_id, coalesce(new_kind, had), CASE WHEN late THEN 'superseded' ELSE 'active' END, 'pending', CASE WHEN late THEN 2 ELSE 1 END, coalesce(said, {NOW}), CASE WHEN late THEN id END, CASE WHEN late THEN least(was, until) ELSE until END FROM s WHERE outcome = 'superseded'
 UNION ALL SELECT new_id, coalesce(new_kind, 'fact'), 'active', 'pending', 1, coalesce(said, {NOW}), NULL, until FROM s WHERE outcome = 'added'""")
def applied_ops(spark, sf):
    folded, ops = _folded(spark, sf)
    return folds.next_rows(folded, ops, fx.now()).drop("text")


@query("op_outcomes", f"WITH RECURSIVE {_FOLDED} SELECT nth, outcome FROM f JOIN o ON o.id = f.id AND o.k = f.k")
def op_outcomes(spark, sf):
    """What became of each operation: later ones meet what earlier ones left."""
    return folds.outcomes(*_folded(spark, sf))


@query("op_revisions", f"WITH RECURSIVE {_FOLDED}, r AS (SELECT *, lag(revision) OVER (PARTITION BY id ORDER BY k) AS old FROM f) SELECT id AS memory_id, revision, kind, status, document_date, valid_until FROM r WHERE old < revision")
def op_revisions(spark, sf):
    return folds.new_revisions(_folded(spark, sf)[0]).select("memory_id", "revision", "kind", "status", "document_date", "valid_until")


_PASS = 0.4


@query("consolidate_plan", f"""WITH RECURSIVE l AS (SELECT m.*, v.v, {_NORM} AS wording, concat_ws('|', scope_id, coalesce(CAST(subject_id AS VARCHAR), ''), kind, lang, coalesce(CAST(valid_until AS VARCHAR), ''), source_role) AS same FROM memories m LEFT JOIN vectors v ON v.id = m.id WHERE {LIVE}),
 g AS (SELECT same, wording, arg_max(id, (updated_at, id)) AS survivor FROM l GROUP BY same, wording HAVING count(*) > 1), e AS (SELECT a.id AS a, b.id AS b FROM l a JOIN l b ON a.same = b.same AND a.id <> b.id WHERE list_dot_product(a.v, b.v) >= {_PASS}),
 r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a), c AS (SELECT node, min(root) AS cluster FROM r GROUP BY node),
 z AS (SELECT cluster, count(*) AS size, arg_max(node, (updated_at, node)) AS survivor FROM c JOIN l ON l.id = c.node GROUP BY cluster HAVING count(DISTINCT wording) > 1)
 SELECT 'expired' AS action, id, NULL AS survivor FROM memories WHERE status = 'active' AND valid_until <= {NOW}
 UNION ALL SELECT 'demoted', id, NULL FROM memories WHERE status = 'active' AND importance > CAST(0.3 AS FLOAT) AND updated_at <= {NOW} - to_days(90) AND created_at <= {NOW} - to_days(90)
 UNION ALL SELECT 'duplicate', id, survivor FROM l JOIN g ON g.same = l.same AND g.wording = l.wording WHERE id <> survivor
 UNION ALL SELECT CASE WHEN size > 6 THEN 'oversized' ELSE 'merge' END, node, CASE WHEN size <= 6 THEN survivor END FROM c JOIN z ON z.cluster = c.cluster""")
def consolidate_plan(spark, sf):
    rows = fx.memories(spark, sf).withColumn("context", F.create_map(F.lit("lang"), "lang")).join(fx.vectors(spark, sf).select("id", "v"), "id", "left")
    return writes.consolidation(rows, fx.now(), _PASS)


_MERGES = f"""m AS (SELECT *, concat_ws('|', scope_id, coalesce(CAST(subject_id AS VARCHAR), ''), kind, lang, coalesce(CAST(valid_until AS VARCHAR), ''), source_role) AS same FROM memories),
 p AS (SELECT same, min(id) AS cluster, count(*) AS planned FROM m WHERE status = 'active' OR no % 31 = 0 GROUP BY same HAVING count(*) BETWEEN 2 AND 6), g AS (SELECT cluster, planned, m.*, revision + CASE WHEN no % 23 = 5 THEN 1 ELSE 0 END AS then_ FROM p JOIN m ON m.same = p.same WHERE status = 'active' OR no % 31 = 0),
 c AS (SELECT cluster, any_value(planned) AS planned, count(*) FILTER (status = 'active') AS held, count(*) FILTER (status = 'active' AND then_ <> revision) AS moved, row_number() OVER (ORDER BY cluster) AS nth FROM g GROUP BY cluster),
 v AS (SELECT *, CASE WHEN CAST(cluster AS INTEGER) % 7 = 3 THEN ' ' WHEN CAST(cluster AS INTEGER) % 7 = 4 THEN repeat('long ', 50) ELSE ' merged ' || cluster END AS said, CASE WHEN CAST(cluster AS INTEGER) % 3 = 0 THEN 1.7 END AS importance, CASE WHEN CAST(cluster AS INTEGER) % 7 = 5 THEN 'Timeout: x' END AS error FROM c),
 t AS (SELECT *, CASE WHEN nth > 40 THEN 'merge_cap' WHEN held < 2 THEN 'members_no_longer_active' WHEN held <> planned OR moved > 0 THEN 'members_changed' WHEN error IS NOT NULL THEN error WHEN trim(said) = '' THEN 'null_merge' WHEN length(trim(said)) > 200 THEN 'merged_text_too_long' END AS reason FROM v)"""


def _merges(spark, sf):
    """Claims that agree in all that a merge keeps, as planned a while ago; and what a model answered."""
    n = F.col("no")
    rows = fx.memories(spark, sf).withColumn("context", F.create_map(F.lit("lang"), "lang"))
    named = rows.filter((F.col("status") == "active") | (n % 31 == 0)).withColumn("same", curation.identity()).select("same", "id", (F.col("revision") + F.when(n % 23 == 5, 1).otherwise(0)).alias("revision"))
    planned = named.groupBy("same").agg(F.min("id").alias("cluster"), F.count("*").alias("n")).filter("n BETWEEN 2 AND 6")
    groups = written(named.join(planned, "same").select("cluster", "id", "revision"))
    k = F.col("cluster").cast("int")
    answers = groups.select("cluster").distinct().select(
        "cluster", F.when(k % 7 == 3, " ").when(k % 7 == 4, F.repeat(F.lit("long "), 50)).otherwise(F.concat(F.lit(" merged "), "cluster")).alias("text"), F.when(k % 3 == 0, 1.7).alias("importance"), F.when(k % 7 == 5, "Timeout: x").alias("error"),
    )
    return rows, groups, written(merging.verdicts(groups, rows, answers, fx.now(), 40))


@query("merge_verdicts", f"WITH {_MERGES} SELECT cluster, reason FROM t")
def merge_verdicts(spark, sf):
    """Which planned merges are carried out, and why the others are not."""
    return _merges(spark, sf)[2].select("cluster", "reason")


@query("merged_tables", f"""WITH {_MERGES}, w AS (SELECT g.*, 'merged-' || t.cluster AS survivor, t.importance AS told FROM g JOIN t ON t.cluster = g.cluster WHERE reason IS NULL),
 e AS (SELECT survivor, count(DISTINCT x.session_id) AS n FROM w JOIN evidence v ON v.memory_id = w.id JOIN messages x ON x.id = v.message_id GROUP BY survivor)
 SELECT m.id, CASE WHEN w.id IS NULL THEN m.status ELSE 'superseded' END AS status, CAST(m.importance AS DOUBLE) AS importance, m.confidence, m.document_date, m.is_static, m.source_role, m.source_count, m.review_status, m.revision + CASE WHEN w.id IS NULL THEN 0 ELSE 1 END AS revision, w.survivor AS superseded_by FROM m LEFT JOIN w ON w.id = m.id
 UNION ALL SELECT w.survivor, 'active', coalesce(greatest(0, least(1, any_value(told))), CAST(max(importance) AS DOUBLE)), min(confidence), min(document_date), bool_or(is_static), any_value(source_role), greatest(1, coalesce(any_value(e.n), 0)), 'pending', 1, NULL FROM w LEFT JOIN e ON e.survivor = w.survivor GROUP BY w.survivor""")
def merged_tables(spark, sf):
    """Memories after the merges: survivors with what their members share, members as history."""
    rows, groups, told = _merges(spark, sf)
    return merging.applied(rows, groups, told, fx.evidence(spark, sf), fx.messages(spark, sf))["memories"].drop("text")


_RELATION = "CASE no % 4 WHEN 0 THEN 'updates' WHEN 1 THEN 'extends' WHEN 2 THEN 'causes' ELSE 'updates' END"


@query("dream_links", f"""WITH a AS (SELECT no // 60 AS cluster, CAST(no % 60 AS INTEGER) AS nth, id AS from_id, CASE WHEN no % 25 = 3 THEN id ELSE lpad(CAST(no - 20 AS VARCHAR), 8, '0') END AS to_id, {_RELATION} AS relation FROM memories WHERE no >= 20),
 m AS (SELECT *, {LIVE} AS live FROM memories)
 SELECT cluster, nth, from_id, to_id, relation, CASE WHEN from_id = to_id OR relation = 'causes' THEN 'invalid_link' WHEN NOT coalesce(x.live, false) OR NOT coalesce(y.live, false) THEN 'link_target_changed'
 WHEN relation = 'updates' AND NOT (x.document_date >= y.document_date AND x.subject_id IS NOT DISTINCT FROM y.subject_id AND x.lang = y.lang AND x.source_role IN ('user', 'manual', 'tool')) THEN 'update_not_forward' END AS reason FROM a LEFT JOIN m x ON x.id = from_id LEFT JOIN m y ON y.id = to_id""")
def dream_links(spark, sf):
    """Links of clusters in order; as each goes to an older claim, none meets a claim that one before it has replaced."""
    m, n = fx.memories(spark, sf).withColumn("context", F.col("lang")), F.col("no")
    to = F.when(n % 25 == 3, F.col("id")).otherwise(F.lpad((n - 20).cast("string"), 8, "0"))
    relation = F.when(n % 4 == 1, "extends").when(n % 4 == 2, "causes").otherwise("updates")
    answers = m.filter("no >= 20").select(F.floor(n / 60).alias("cluster"), (n % 60).cast("int").alias("nth"), F.col("id").alias("from_id"), to.alias("to_id"), relation.alias("relation"))
    return writes.links(answers, m, fx.now())


@query("dream_inferences", f"""WITH RECURSIVE a AS (SELECT scope_id || '-' || CAST(no // 200 AS VARCHAR) AS cluster, no % 200 AS nth, no, scope_id, CASE WHEN no % 10 = 4 THEN text WHEN no % 10 = 5 THEN '  ' WHEN no % 10 = 8 THEN 'The same  for all' ELSE 'inferred ' || id END AS said, CASE WHEN no % 10 = 6 THEN 0.5 ELSE 0.9 END AS confidence, id AS p1, CASE WHEN no % 10 <> 7 THEN lpad(CAST(no + 20 AS VARCHAR), 8, '0') END AS p2 FROM memories WHERE no % 4 <> 1),
 m AS (SELECT * FROM memories WHERE {LIVE}), k AS (SELECT DISTINCT scope_id, {_NORM} AS w FROM memories WHERE status = 'active'),
 near AS (SELECT DISTINCT a.no FROM a JOIN vectors v ON v.no = a.no + 3 JOIN memories o ON o.scope_id = a.scope_id AND o.status = 'active' JOIN vectors w ON w.id = o.id WHERE list_dot_product(v.v, w.v) >= 0.45),
 r AS (SELECT a.*, {text.normalised_sql('said')} AS h, CASE WHEN trim(said) = '' OR length({text.stripped_sql('said')}) > 200 OR p2 IS NULL THEN 'invalid_inference' WHEN a.confidence < 0.7 THEN 'low_confidence' WHEN x.id IS NULL OR y.id IS NULL OR a.no % 37 = 2 OR (a.no + 20) % 37 = 2 AND a.no % 4 <> 1 AND (a.no + 20) // 200 = a.no // 200 AND y.scope_id = a.scope_id THEN 'premise_changed' WHEN k.w IS NOT NULL OR near.no IS NOT NULL THEN 'already_stated' END AS own,
  least(0.6, greatest(CAST(x.importance AS DOUBLE), CAST(y.importance AS DOUBLE))) AS importance, greatest(x.document_date, y.document_date) AS document_date, CASE WHEN x.subject_id = y.subject_id THEN x.subject_id END AS subject_id
  FROM a LEFT JOIN m x ON x.id = p1 LEFT JOIN m y ON y.id = p2 LEFT JOIN k ON k.scope_id = a.scope_id AND k.w = {text.normalised_sql('said')} LEFT JOIN near ON near.no = a.no),
 i AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY cluster, nth) AS k FROM r),
 f AS (SELECT DISTINCT scope_id, CAST(0 AS BIGINT) AS k, '' AS cluster, CAST(0 AS BIGINT) AS written, CAST([] AS VARCHAR[]) AS hashes, CAST(NULL AS VARCHAR) AS reason FROM i
 UNION ALL SELECT scope_id, k, cluster, had + CASE WHEN why IS NULL THEN 1 ELSE 0 END, CASE WHEN why IS NULL THEN list_append(hashes, h) ELSE hashes END, why FROM (SELECT *, CASE WHEN had >= 2 THEN 'beyond' WHEN own IS NULL AND list_contains(hashes, h) THEN 'already_stated' ELSE own END AS why
  FROM (SELECT i.scope_id, i.k, i.cluster, i.h, i.own, f.hashes, CASE WHEN f.cluster = i.cluster THEN f.written ELSE 0 END AS had FROM f JOIN i ON i.scope_id = f.scope_id AND i.k = f.k + 1)))
 SELECT i.cluster, i.nth, f.reason, round(CASE WHEN f.reason IS NULL THEN importance END, 4) AS importance, CASE WHEN f.reason IS NULL THEN document_date END AS document_date, CASE WHEN f.reason IS NULL THEN subject_id END AS subject_id FROM i JOIN f ON f.scope_id = i.scope_id AND f.k = i.k""")
def dream_inferences(spark, sf):
    """What a pass over clusters of each scope infers: without premises that links of the answer replace, and without what is said already, by wording or by vector."""
    m, n = fx.memories(spark, sf), F.col("no")
    said = F.when(n % 10 == 4, F.col("text")).when(n % 10 == 5, "  ").when(n % 10 == 8, "The same  for all").otherwise(F.concat(F.lit("inferred "), "id"))
    answers = m.filter(n % 4 != 1).select(
        F.concat("scope_id", F.lit("-"), F.floor(n / 200).cast("string")).alias("cluster"), (n % 200).alias("nth"), "no", "id", "scope_id", said.alias("text"), F.when(n % 10 == 6, 0.5).otherwise(0.9).alias("confidence"),
        F.array("id", F.when(n % 10 != 7, F.lpad((n + 20).cast("string"), 8, "0"))).alias("premises"),
    )
    active = m.filter("status = 'active'")
    stated = active.select("scope_id", text.content_hash(F.col("text")).alias("content_hash"))
    v = fx.vectors(spark, sf)
    asking = answers.join(v.select((F.col("no") - 3).alias("no"), "v"), "no").select("scope_id", "id", "v")
    found = graph.nearest_to(asking, active.select("scope_id", "id").join(v.select("id", "v"), "id"), 1, "scope_id", floor=0.45).select(F.col("asked").alias("id")).distinct()
    near = answers.join(found, "id").select("cluster", "nth")
    replaced = answers.filter(n % 37 == 2).select("cluster", "id")
    return writes.inferences(answers, m, stated, fx.now(), replaced=replaced, near=near).withColumn("importance", F.round("importance", 4))


@query("erase_tables", """WITH m AS (SELECT *, CASE WHEN status = 'superseded' THEN lpad(CAST(no + 20 AS VARCHAR), 8, '0') END AS superseded_by FROM memories), g AS (SELECT id FROM m WHERE scope_id = 'src7' OR author_id = 7 AND source_role = 'inference'),
 c AS (SELECT DISTINCT e.memory_id FROM evidence e JOIN messages x ON x.id = e.message_id WHERE x.user_id = 7), k AS (SELECT e.memory_id, count(DISTINCT x.session_id) AS n FROM evidence e JOIN messages x ON x.id = e.message_id WHERE x.user_id <> 7 GROUP BY e.memory_id)
 SELECT m.id, CASE WHEN subject_id = 7 THEN NULL ELSE subject_id END AS subject_id, CASE WHEN g.id IS NULL THEN superseded_by END AS superseded_by, revision + CASE WHEN coalesce(subject_id = 7, false) OR g.id IS NOT NULL THEN 1 ELSE 0 END AS revision,
 CASE WHEN c.memory_id IS NOT NULL THEN greatest(1, coalesce(k.n, 0)) ELSE source_count END AS source_count FROM m LEFT JOIN g ON g.id = superseded_by LEFT JOIN c ON c.memory_id = m.id LEFT JOIN k ON k.memory_id = m.id WHERE m.id NOT IN (SELECT id FROM g)""")
def erase_tables(spark, sf):
    m = fx.memories(spark, sf).withColumn("superseded_by", F.when(F.col("status") == "superseded", F.lpad((F.col("no") + 20).cast("string"), 8, "0")))
    return writes.erased(m, fx.evidence(spark, sf), fx.messages(spark, sf), 7, "src7")


_ERASED = """m AS (SELECT *, CASE WHEN status = 'superseded' THEN lpad(CAST(no + 20 AS VARCHAR), 8, '0') END AS superseded_by FROM memories), g AS (SELECT id FROM m WHERE scope_id = 'src7' OR author_id = 7 AND source_role = 'inference'), w AS (SELECT id FROM messages WHERE user_id = 7), runs AS (SELECT id FROM searches WHERE user_id = 7),
 o AS (SELECT *, CASE WHEN collection = 'raw' THEN CAST(entity_id AS VARCHAR) ELSE lpad(CAST(entity_id AS VARCHAR), 8, '0') END AS entity FROM outbox)"""
_GONE = "memory_id NOT IN (SELECT id FROM g)"
_LEFT = {
    "memories": "SELECT 1 FROM m WHERE id NOT IN (SELECT id FROM g)", "revisions": f"SELECT 1 FROM revisions WHERE {_GONE}", "sources": f"SELECT DISTINCT memory_id, message_id FROM evidence WHERE {_GONE} AND message_id NOT IN (SELECT id FROM w)",
    "evidence": f"SELECT 1 FROM evidence WHERE {_GONE} AND message_id NOT IN (SELECT id FROM w)", "relations": "SELECT 1 FROM relations WHERE from_id NOT IN (SELECT id FROM g) AND to_id NOT IN (SELECT id FROM g)",
    "feedback": f"SELECT 1 FROM feedback WHERE {_GONE} AND run_id NOT IN (SELECT id FROM runs)", "entities": "SELECT 1 FROM entities WHERE id <> 'user7'", "memberships": "SELECT 1 FROM memberships WHERE user_id <> 7 AND entity_id <> 'user7'", "users": "SELECT 1 FROM customer WHERE c_custkey <> 7",
    "api_keys": "SELECT 1 FROM orders WHERE o_custkey <> 7", "messages": "SELECT 1 FROM messages WHERE user_id <> 7", "attention": "SELECT 1 FROM orders WHERE o_custkey <> 7 AND o_orderpriority = '1-URGENT'", "runs": "SELECT 1 FROM searches WHERE user_id <> 7", "calls": "SELECT 1 FROM calls WHERE user_id <> 7",
    "outbox": "SELECT 1 FROM o WHERE NOT (collection = 'memories' AND entity IN (SELECT id FROM g)) AND NOT (collection = 'raw' AND entity IN (SELECT CAST(id AS VARCHAR) FROM w))",
}


def _erased(spark, sf):
    from gistmill.plans.context_queries import _store

    tables = _store(spark, sf)
    tables["memories"] = tables["memories"].withColumn("superseded_by", F.when(F.col("status") == "superseded", F.lpad((F.col("no") + 20).cast("string"), 8, "0")))
    entity = F.when(F.col("collection") == "raw", F.col("entity_id").cast("string")).otherwise(F.lpad(F.col("entity_id").cast("string"), 8, "0"))
    tables["outbox"] = fx.outbox(spark, sf).withColumn("entity_id", entity)
    return tables, writes.erased_tables(tables, 7, "src7", "user7")


@query("erased_counts", f"WITH {_ERASED} " + " UNION ALL ".join(f"SELECT '{name}' AS part, count(*) AS n FROM ({sql})" for name, sql in _LEFT.items()))
def erased_counts(spark, sf):
    """How many rows each table holds once a user is erased."""
    out = None
    for name, rows in _erased(spark, sf)[1].items():
        n = rows.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = n if out is None else out.unionAll(n)
    return out


@query("erased_index", f"WITH {_ERASED} SELECT m.id, CASE WHEN g.id IS NOT NULL THEN 'delete' ELSE 'upsert' END AS operation FROM m LEFT JOIN g ON g.id = m.id LEFT JOIN g h ON h.id = m.superseded_by WHERE g.id IS NOT NULL OR coalesce(subject_id = 7, false) OR h.id IS NOT NULL")
def erased_index(spark, sf):
    """What an index has to do after an erasure: rows that go, and rows that stay without naming the user."""
    before, after = _erased(spark, sf)
    return writes.index_changes(before["memories"], after["memories"])
