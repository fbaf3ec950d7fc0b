"""Queries on joins, evidence, ingestion, writes, consolidation and profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gistmill.functions import scores, text
from gistmill.operators import curation, filters, folds, graph, profiles, retrieval, writes
from gistmill.plans.registry import query
from gistmill.sources import fixtures as fx

NOW = f"TIMESTAMP '{fx.NOW}'"
LIVE = f"status = 'active' AND (valid_until IS NULL OR valid_until > {NOW})"
TOKENS = r"greatest(1, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')))"


@query("memory_scopes", "SELECT m.id, e.kind AS scope_kind, s.c_name AS subject, a.c_custkey AS author FROM memories m JOIN entities e ON e.id = m.scope_id LEFT JOIN customer s ON s.c_custkey = m.subject_id LEFT JOIN (SELECT c_custkey FROM customer) a ON a.c_custkey = m.author_id")
def memory_scopes(spark, sf):
    c = fx.table(spark, sf, "customer").select("c_custkey", "c_name")
    m = fx.memories(spark, sf).select("id", "scope_id", "subject_id", "author_id")
    e = fx.entities(spark, sf).select(F.col("id").alias("scope_id"), F.col("kind").alias("scope_kind"))
    out = m.join(e, "scope_id").join(c.select(F.col("c_custkey").alias("subject_id"), F.col("c_name").alias("subject")), "subject_id", "left")
    return out.join(c.select(F.col("c_custkey").alias("author_id"), F.col("c_custkey").alias("author")), "author_id", "left").select("id", "scope_kind", "subject", "author")


@query("visible_scopes", "SELECT user_id, entity_id FROM (SELECT DISTINCT c_custkey AS user_id, e.id AS entity_id FROM customer CROSS JOIN (SELECT * FROM entities) e LEFT JOIN memberships m ON m.entity_id = e.id WHERE NOT e.archived AND e.kind <> 'user' AND (e.visibility = 'team' OR m.user_id = c_custkey))")
def visible_scopes(spark, sf):
    """Own memberships, and what the team may see: two equi joins instead of one condition with OR."""
    users = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    e = fx.entities(spark, sf).filter("NOT archived AND kind != 'user'").select(F.col("id").alias("entity_id"), "visibility")
    own = fx.memberships(spark, sf).join(users, "user_id").join(e, "entity_id").select("user_id", "entity_id")
    shared = users.join(e.filter("visibility = 'team'").select("entity_id"), F.lit(True))  # each user sees each team scope; the planner picks the smaller side
    return own.unionAll(shared).distinct()


@query("writable_scopes", "SELECT DISTINCT user_id, entity_id FROM memberships m JOIN entities e ON e.id = m.entity_id WHERE m.role IN ('owner', 'member') AND NOT e.archived")
def writable_scopes(spark, sf):
    e = fx.entities(spark, sf).filter("NOT archived").select(F.col("id").alias("entity_id"))
    return fx.memberships(spark, sf).filter(F.col("role").isin("owner", "member")).join(e, "entity_id", "left_semi").select("user_id", "entity_id").distinct()


@query("teammates", "SELECT DISTINCT a.user_id, b.user_id AS mate FROM memberships a JOIN memberships b ON a.entity_id = b.entity_id AND a.user_id <> b.user_id WHERE a.role = 'owner' AND b.role = 'owner'")
def teammates(spark, sf):
    o = fx.memberships(spark, sf).filter("role = 'owner'").select("entity_id", "user_id")
    return o.join(o.withColumnRenamed("user_id", "mate"), "entity_id").filter("user_id != mate").select("user_id", "mate").distinct()


@query("alias_owner", f"SELECT alias_norm, min(c_custkey) AS owner FROM (SELECT c_custkey, {text.normalised_sql('c_mktsegment')} AS alias_norm FROM customer) GROUP BY alias_norm")
def alias_owner(spark, sf):
    a = fx.table(spark, sf, "customer").select("c_custkey", text.normalised(F.col("c_mktsegment")).alias("alias_norm"))
    return curation.first_seen(a, "alias_norm", by="c_custkey").select("alias_norm", F.col("c_custkey").alias("owner"))


@query("workspace_scope", "SELECT id, coalesce(w.entity_id, 'private') AS scope FROM (SELECT id, author_id, scope_id FROM memories) m LEFT JOIN (SELECT DISTINCT user_id, entity_id FROM memberships WHERE role <> 'viewer') w ON w.user_id = m.author_id AND w.entity_id = m.scope_id")
def workspace_scope(spark, sf):
    w = fx.memberships(spark, sf).filter("role != 'viewer'").select(F.col("user_id").alias("author_id"), F.col("entity_id").alias("scope_id"), F.col("entity_id").alias("found")).distinct()
    return fx.memories(spark, sf).select("id", "author_id", "scope_id").join(w, ["author_id", "scope_id"], "left").select("id", F.coalesce("found", F.lit("private")).alias("scope"))


@query("message_sessions", "SELECT session_id, count(DISTINCT g.id) AS n, min(created_at) AS started, max(created_at) AS ended, count(DISTINCT memory_id) AS memories FROM messages g LEFT JOIN evidence e ON e.message_id = g.id GROUP BY session_id")
def message_sessions(spark, sf):
    g = fx.messages(spark, sf)
    said = g.groupBy("session_id").agg(F.count("*").alias("n"), F.min("created_at").alias("started"), F.max("created_at").alias("ended"))
    made = fx.evidence(spark, sf).join(g.select(F.col("id").alias("message_id"), "session_id"), "message_id").groupBy("session_id").agg(F.count_distinct("memory_id").alias("memories"))
    return said.join(made, "session_id", "left").na.fill(0, ["memories"])


@query("evidence_lineage", """SELECT e.memory_id, e.message_id, g.session_id, m.scope_id, count(r.revision) AS revisions, min(r.at) AS first_at FROM evidence e JOIN messages g ON g.id = e.message_id JOIN memories m ON m.id = e.memory_id
 LEFT JOIN revisions r ON r.memory_id = m.id AND r.status = 'active' GROUP BY ALL""")
def evidence_lineage(spark, sf):
    e = fx.evidence(spark, sf).select("memory_id", "message_id")
    g = fx.messages(spark, sf).select(F.col("id").alias("message_id"), "session_id")
    m = fx.memories(spark, sf).select(F.col("id").alias("memory_id"), "scope_id")
    r = fx.revisions(spark, sf).filter("status = 'active'").groupBy("memory_id").agg(F.count("*").alias("revisions"), F.min("at").alias("first_at"))
    return e.join(g, "message_id").join(m, "memory_id").join(r, "memory_id", "left").na.fill(0, ["revisions"]).select("memory_id", "message_id", "session_id", "scope_id", "revisions", "first_at")


@query("prev_revision", "SELECT a.memory_id, a.revision, length(a.text) - length(b.text) AS grown FROM revisions a LEFT JOIN revisions b ON b.memory_id = a.memory_id AND b.revision = a.revision - 1")
def prev_revision(spark, sf):
    before = F.lag(F.length("text")).over(Window.partitionBy("memory_id").orderBy("revision"))
    return fx.revisions(spark, sf).select("memory_id", "revision", (F.length("text") - before).cast("bigint").alias("grown"))


@query("last_good_revision", "SELECT r.memory_id, max(r.revision) AS revision, arg_max(r.valid_until, r.revision) AS valid_until FROM revisions r JOIN memories m ON m.id = r.memory_id WHERE r.status <> 'superseded' AND r.revision < m.revision GROUP BY r.memory_id")
def last_good_revision(spark, sf):
    """The last revision before the current one that was not superseded, with its validity."""
    return curation.last_good(fx.revisions(spark, sf), fx.memories(spark, sf).select(F.col("id").alias("memory_id"), F.col("revision").alias("current")))


@query("top_excerpts", "SELECT memory_id, message_id, nth FROM (SELECT e.memory_id, e.message_id, row_number() OVER (PARTITION BY e.memory_id ORDER BY e.message_id DESC, start_char) AS nth FROM evidence e JOIN messages g ON g.id = e.message_id WHERE sha256(substr(content, start_char + 1, end_char - start_char)) = sha) WHERE nth <= 3")
def top_excerpts(spark, sf):
    g = fx.messages(spark, sf).select(F.col("id").alias("message_id"), "content")
    e = fx.evidence(spark, sf).join(g, "message_id").filter(text.span_holds(F.col("content"), F.col("start_char"), F.col("end_char"), F.col("sha")))
    return e.withColumn("nth", F.row_number().over(Window.partitionBy("memory_id").orderBy(F.desc("message_id"), "start_char"))).filter("nth <= 3").select("memory_id", "message_id", "nth")


@query("extraction_windows", "SELECT session_id, CAST(ceil(nth / 3.0) AS INTEGER) AS win, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS nth FROM messages WHERE role <> 'system') GROUP BY ALL")
def extraction_windows(spark, sf):
    return curation.windows(fx.messages(spark, sf).filter("role != 'system'"), 3).withColumnRenamed("window", "win")


@query("extraction_gate", r"SELECT session_id, count(*) >= 6 OR bool_or(regexp_matches(content, '(?i)(запомн|не\s+забудь|запиши\s+себе|remember\s+(that|this)|don''?t\s+forget|keep\s+in\s+mind|note\s+that\s+i)')) OR session_id % 9 = 2 AS ready FROM messages GROUP BY session_id")
def extraction_gate(spark, sf):
    """Sessions with enough turns, one that asks to be remembered, or an end."""
    g = fx.messages(spark, sf)
    return curation.gate(g, 6, g.filter("session_id % 9 = 2").select("session_id").distinct())


@query("dedup_ingest", "SELECT user_id, min(id) AS id FROM (SELECT id, user_id, sha256(content) AS ext FROM messages) GROUP BY user_id, ext")
def dedup_ingest(spark, sf):
    """One message of each user and delivery; the delivery's name is the digest of all that it says."""
    rows = fx.messages(spark, sf).select("id", "user_id", F.sha2(F.col("content").cast("binary"), 256).alias("ext"))
    return curation.first_seen(rows, "user_id", "ext", by="id").select("user_id", "id")


@query("turn_index", "SELECT id, role = 'user' AND length(content) >= 20 AS indexed FROM messages WHERE role IN ('user', 'assistant')")
def turn_index(spark, sf):
    return fx.messages(spark, sf).filter(F.col("role").isin("user", "assistant")).select("id", ((F.col("role") == "user") & (F.length("content") >= 20)).alias("indexed"))


@query("source_roles", "SELECT scope_id, CASE WHEN bool_or(source_role = 'user') THEN 'user' WHEN bool_or(source_role = 'assistant') THEN 'assistant' ELSE 'inference' END AS strongest, CASE WHEN bool_or(source_role = 'assistant') THEN 'assistant' WHEN bool_or(source_role = 'inference') THEN 'inference' ELSE 'user' END AS weakest FROM memories GROUP BY scope_id")
def source_roles(spark, sf):
    r = fx.memories(spark, sf).groupBy("scope_id").agg(F.collect_set("source_role").alias("roles"))
    return r.select("scope_id", curation.first_of(F.col("roles"), curation.AUTHORITY).alias("strongest"), curation.first_of(F.col("roles"), curation.WEAKEST_FIRST).alias("weakest"))


@query("mention_recount", "SELECT m.id, greatest(1, count(DISTINCT g.session_id)) AS mentions, min(g.created_at) AS said FROM memories m LEFT JOIN evidence e ON e.memory_id = m.id LEFT JOIN messages g ON g.id = e.message_id GROUP BY m.id")
def mention_recount(spark, sf):
    g = fx.messages(spark, sf).select(F.col("id").alias("message_id"), "session_id", "created_at")
    c = fx.evidence(spark, sf).join(g, "message_id").groupBy(F.col("memory_id").alias("id")).agg(F.count_distinct("session_id").alias("n"), F.min("created_at").alias("said"))
    return fx.memories(spark, sf).select("id").join(c, "id", "left").select("id", F.greatest(F.lit(1), F.coalesce("n", F.lit(0))).alias("mentions"), "said")


@query("reinforce", "SELECT memory_id, count(DISTINCT session_id) AS fresh FROM (SELECT f.memory_id, g.session_id FROM feedback f JOIN messages g ON g.id = f.run_id) n WHERE NOT EXISTS (SELECT 1 FROM evidence e JOIN messages g ON g.id = e.message_id WHERE e.memory_id = n.memory_id AND g.session_id = n.session_id) GROUP BY memory_id")
def reinforce(spark, sf):
    g = fx.messages(spark, sf).select("id", "session_id")
    new = fx.feedback(spark, sf).join(g, F.col("run_id") == g["id"]).select("memory_id", "session_id")
    cited = fx.evidence(spark, sf).join(g, F.col("message_id") == g["id"]).select("memory_id", "session_id")
    return new.join(cited, ["memory_id", "session_id"], "left_anti").groupBy("memory_id").agg(F.count_distinct("session_id").alias("fresh"))


_NORM = text.normalised_sql("text")
_DUP = f"SELECT lang, sha256({_NORM}) AS group_hash, arg_max(id, (updated_at, id)) AS survivor, count(*) AS members FROM memories WHERE {LIVE} GROUP BY ALL HAVING count(*) > 1"


@query("exact_duplicates", _DUP)
def exact_duplicates(spark, sf):
    return curation.exact_groups(fx.memories(spark, sf).filter(filters.live(fx.now())), "lang")


_IDENTITY = "scope_id, subject_id, kind, lang, valid_until, source_role"


@query("find_duplicate", f"SELECT id, first FROM (SELECT id, arg_min(id, (created_at, id)) OVER (PARTITION BY {_IDENTITY}, sha256({_NORM})) AS first FROM memories WHERE {LIVE}) WHERE id <> first")
def find_duplicate(spark, sf):
    """Live claims that say exactly what an older one of the same identity says."""
    rows = fx.memories(spark, sf).filter(filters.live(fx.now())).withColumn("context", F.create_map(F.lit("lang"), "lang"))
    return curation.restated(rows)


@query("identity", f"SELECT id, scope_id || '|' || coalesce(CAST(subject_id AS VARCHAR), '') || '|' || kind || '|{{\"lang\":\"' || lang || '\"}}|' || coalesce(strftime(valid_until, '%Y-%m-%dT%H:%M:%SZ'), '') || '|' || source_role AS identity FROM memories")
def identity(spark, sf):
    rows = fx.memories(spark, sf).withColumn("context", F.create_map(F.lit("lang"), "lang"))
    return rows.select("id", curation.identity().alias("identity"))


@query("merge_survivor", "SELECT lang, kind, arg_max(id, (updated_at, id)) AS id, min(confidence) AS confidence, min(document_date) AS document_date, bool_or(is_static) AS is_static, CASE WHEN bool_or(source_role = 'assistant') THEN 'assistant' WHEN bool_or(source_role = 'inference') THEN 'inference' ELSE 'user' END AS source_role, max(source_count) AS source_count, coalesce(string_agg(DISTINCT strftime(event_start, '%Y-%m-%d'), ',' ORDER BY strftime(event_start, '%Y-%m-%d')), '') AS event_dates FROM memories GROUP BY ALL")
def merge_survivor(spark, sf):
    rows = fx.memories(spark, sf).withColumn("event_dates", F.array_compact(F.array(F.date_format("event_start", "yyyy-MM-dd"))))
    return curation.merged_fields(rows, "lang", "kind").withColumn("event_dates", F.array_join("event_dates", ","))


@query("expiry_sweep", f"SELECT id FROM memories WHERE status = 'active' AND valid_until <= {NOW}")
def expiry_sweep(spark, sf):
    return curation.expired(fx.memories(spark, sf), fx.now()).select("id")


@query("idle_demotion", f"SELECT id, round(CAST(greatest(CAST(0.3 AS FLOAT), CAST(importance - 0.1 AS FLOAT)) AS DOUBLE), 4) AS new_importance FROM memories WHERE status = 'active' AND importance > CAST(0.3 AS FLOAT) AND updated_at <= {NOW} - to_days(90) AND created_at <= {NOW} - to_days(90)")
def idle_demotion(spark, sf):
    return curation.demoted(fx.memories(spark, sf), fx.now()).select("id", F.round(F.col("new_importance").cast("double"), 4).alias("new_importance"))


@query("supersede_close", "SELECT CASE WHEN late THEN from_id ELSE to_id END AS id, CASE WHEN late THEN to_id ELSE from_id END AS superseded_by, least(CASE WHEN late THEN od ELSE nd END, valid_until) AS valid_until, late FROM (SELECT from_id, to_id, n.document_date AS nd, o.document_date AS od, o.valid_until, n.document_date < o.document_date AS late FROM relations r JOIN memories n ON n.id = from_id JOIN memories o ON o.id = to_id WHERE relation = 'updates')")
def supersede_close(spark, sf):
    return curation.closed_validity(fx.relations(spark, sf), fx.memories(spark, sf))


_OPS = """SELECT no, CASE no % 3 WHEN 0 THEN 'ADD' WHEN 1 THEN 'UPDATE' ELSE 'DELETE' END AS op, source_role AS role, no % 23 <> 0 AS evidence_ok, lang <> 'es' AS context_ok, no % 9 <> 4 AS entity_known, scope_id <> 'src3' AS scope_writable, no % 11 <> 5 AS target_known, no % 7 <> 2 AS target_scope_ok, no % 5 <> 1 AS target_context_ok FROM memories"""


@query("apply_ops_outcome", f"""SELECT op, reason, count(*) AS n FROM (SELECT op, CASE WHEN op <> 'ADD' AND NOT target_known THEN 'unknown_candidate' WHEN NOT evidence_ok THEN 'evidence_invalid' WHEN op <> 'DELETE' AND role = 'assistant' THEN 'assistant_only_source' WHEN NOT context_ok THEN 'context_mismatch'
 WHEN NOT entity_known THEN 'unknown_entity' WHEN NOT scope_writable THEN 'scope_not_allowed' WHEN op <> 'ADD' AND NOT target_scope_ok THEN 'target_scope_mismatch' WHEN op <> 'ADD' AND NOT target_context_ok THEN 'target_context_mismatch' END AS reason FROM ({_OPS})) GROUP BY ALL""")
def apply_ops_outcome(spark, sf):
    n = F.col("no")
    ops = fx.memories(spark, sf).select(
        F.when(n % 3 == 0, "ADD").when(n % 3 == 1, "UPDATE").otherwise("DELETE").alias("op"), F.array("source_role").alias("roles"), (n % 23 != 0).alias("evidence_ok"), (F.col("lang") != "es").alias("context_ok"), (n % 9 != 4).alias("entity_known"),
        (F.col("scope_id") != "src3").alias("scope_writable"), (n % 11 != 5).alias("target_known"), (n % 7 != 2).alias("target_scope_ok"), (n % 5 != 1).alias("target_context_ok"),
    )
    return curation.outcomes(ops).groupBy("op", "reason").agg(F.count("*").alias("n"))


@query("update_version", """WITH RECURSIVE c AS (SELECT id, k, CASE WHEN no % 16 = 0 THEN TIMESTAMP '2023-05-05' + to_days(CAST(k AS INTEGER)) END AS event_start, revision + CASE WHEN no % 8 = 4 AND k = 0 THEN 7 WHEN no % 24 = 0 THEN 0 ELSE k END AS expected, 'edit' || CAST(k AS VARCHAR) AS kind FROM (SELECT *, unnest(range(0, 1 + no % 3)) AS k FROM memories) WHERE no % 4 = 0),
 f AS (SELECT id, CAST(-1 AS BIGINT) AS k, kind, event_start, CAST(revision AS BIGINT) AS revision, CAST(0 AS BIGINT) AS conflicts FROM memories
 UNION ALL SELECT f.id, c.k, CASE WHEN expected = revision THEN c.kind ELSE f.kind END, CASE WHEN expected = revision THEN coalesce(c.event_start, f.event_start) ELSE f.event_start END, revision + CASE WHEN expected = revision THEN 1 ELSE 0 END, conflicts + CASE WHEN expected = revision THEN 0 ELSE 1 END FROM f JOIN c ON c.id = f.id AND c.k = f.k + 1)
 SELECT id, arg_max(kind, k) AS kind, arg_max(struct_pack(e := event_start), k).e AS event_start, max(revision) AS revision, max(conflicts) AS conflicts FROM f GROUP BY id""")
def update_version(spark, sf):
    """Up to three changes of one memory, in order: those that name its revision then are taken; what they say nothing on (null) stays."""
    m, n, k = fx.memories(spark, sf).select("no", "id", "kind", "event_start", "revision"), F.col("no"), F.col("k")
    c = m.filter("no % 4 = 0").withColumn("k", F.explode(F.sequence(F.lit(0), (n % 3).cast("int"))))
    event = F.when(n % 16 == 0, F.lit("2023-05-05").cast("timestamp") + F.make_dt_interval(k))
    expected = F.col("revision") + F.when((n % 8 == 4) & (k == 0), 7).when(n % 24 == 0, 0).otherwise(k)
    changes = c.select("id", k.alias("nth"), F.concat(F.lit("edit"), k.cast("string")).alias("kind"), event.alias("event_start"), expected.alias("expected_revision"))
    return folds.versions(m, changes, "kind", sticky=["event_start"]).select("id", "kind", "event_start", "revision", "conflicts")


@query("status_changes", "SELECT id, CASE review_status WHEN 'declined' THEN 'archived' ELSE 'active' END AS status FROM memories WHERE review_status <> 'pending'")
def status_changes(spark, sf):
    return fx.memories(spark, sf).filter("review_status != 'pending'").select("id", F.when(F.col("review_status") == "declined", "archived").otherwise("active").alias("status"))


@query("add_relation_check", "SELECT from_id, to_id, relation, a.scope_id = b.scope_id AND from_id <> to_id AS allowed FROM relations JOIN memories a ON a.id = from_id JOIN memories b ON b.id = to_id")
def add_relation_check(spark, sf):
    s = fx.memories(spark, sf).select("id", "scope_id")
    e = fx.relations(spark, sf).join(s.select(F.col("id").alias("from_id"), F.col("scope_id").alias("x")), "from_id").join(s.select(F.col("id").alias("to_id"), F.col("scope_id").alias("y")), "to_id")
    return e.select("from_id", "to_id", "relation", ((F.col("x") == F.col("y")) & (F.col("from_id") != F.col("to_id"))).alias("allowed"))


@query("already_stated", f"""WITH h AS (SELECT id, no, scope_id, sha256({_NORM}) AS h, status FROM memories), said AS (SELECT f.id FROM h f JOIN h o ON o.h = f.h AND o.scope_id = f.scope_id AND o.no < f.no WHERE o.status = 'active'),
 near AS (SELECT a.id FROM vectors a JOIN vectors b ON b.id <> a.id JOIN h f ON f.id = a.id JOIN h o ON o.id = b.id WHERE o.scope_id = f.scope_id AND o.status = 'active' AND o.no < f.no AND list_dot_product(a.v, b.v) >= 0.45)
 SELECT id FROM said UNION SELECT id FROM near""")
def already_stated(spark, sf):
    """Claims whose words an older active claim of their scope has, or to whose vector one is near."""
    m = fx.memories(spark, sf).select("id", "no", "scope_id", "status", text.content_hash(F.col("text")).alias("h"))
    return curation.stated_before(m.join(fx.vectors(spark, sf).select("id", "v"), "id", "left"), cosine=0.45)


@query("forget_plan", f"""WITH q AS (SELECT v AS q FROM vectors WHERE no = 0) SELECT m.id, round(list_dot_product(v.v, q), 6) AS score, true AS verified, false AS forgotten FROM memories m JOIN vectors v ON v.id = m.id, q WHERE status = 'active' AND list_dot_product(v.v, q) >= 0.1 AND scope_id IN (SELECT entity_id FROM memberships WHERE user_id = 7 AND role IN ('owner', 'member') UNION SELECT 'src' || CAST(i AS VARCHAR) FROM range(0, 12) t(i)) AND m.no % 5 <> 4
 ORDER BY list_dot_product(v.v, q) DESC, updated_at DESC, m.id LIMIT 20""")
def forget_plan(spark, sf):
    """What a request to forget finds by vector, in scopes that may be written, and a judge confirms; nothing goes yet."""
    v, m = fx.vectors(spark, sf), fx.memories(spark, sf)
    q = F.array(*map(F.lit, v.filter("no = 0").select("v").first()[0]))
    own = fx.memberships(spark, sf).filter((F.col("user_id") == 7) & F.col("role").isin("owner", "member")).select(F.col("entity_id").alias("scope_id"))
    more = spark.range(12).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("scope_id"))
    told = m.filter("no % 5 != 4").select("id")
    out = writes.forgotten(v.select("id", scores.dot(F.col("v"), q).alias("score")), m, own.unionAll(more), 20, 0.1, told)
    return out.withColumn("score", F.round("score", 6))


@query("forget_named", "SELECT id, 1.0 AS score, false AS verified, true AS forgotten FROM memories WHERE status = 'active' AND scope_id = 'src3' AND no % 4 = 3 ORDER BY updated_at DESC, id LIMIT 15")
def forget_named(spark, sf):
    """Ids that a dry run has shown, now archived: those that are still active in a scope of the caller."""
    m = fx.memories(spark, sf)
    return writes.forgotten(m.filter("no % 4 = 3").select("id"), m, spark.range(1).select(F.lit("src3").alias("scope_id")), 15, dry_run=False)


@query("erase_plan", "SELECT 'memories' AS t, count(*) AS n FROM memories WHERE author_id = 7 UNION ALL SELECT 'messages', count(*) FROM messages WHERE user_id = 7 UNION ALL SELECT 'searches', count(*) FROM searches WHERE user_id = 7 UNION ALL SELECT 'elsewhere', count(*) FROM memories WHERE author_id = 7 AND subject_id IS NOT NULL AND subject_id <> 7")
def erase_plan(spark, sf):
    m = fx.memories(spark, sf).filter("author_id = 7")
    sets = {"memories": m, "messages": fx.messages(spark, sf).filter("user_id = 7"), "searches": fx.searches(spark, sf).filter("user_id = 7"), "elsewhere": m.filter("subject_id IS NOT NULL AND subject_id != 7")}
    out = None
    for name, rows in sets.items():
        n = rows.agg(F.lit(name).alias("t"), F.count("*").alias("n"))
        out = n if out is None else out.unionAll(n)
    return out


@query("export_sets", "SELECT m.id, e.message_id FROM memories m JOIN evidence e ON e.memory_id = m.id JOIN messages g ON g.id = e.message_id WHERE g.user_id = 7")
def export_sets(spark, sf):
    g = fx.messages(spark, sf).filter("user_id = 7").select(F.col("id").alias("message_id"))
    return fx.evidence(spark, sf).join(g, "message_id", "left_semi").select(F.col("memory_id").alias("id"), "message_id")


@query("backup_prune", "SELECT id FROM (SELECT event_id AS id, event_id % 10 = 0 AS protected, CASE WHEN event_id % 7 = 0 THEN 'weekly' ELSE 'daily' END AS kind, row_number() OVER (PARTITION BY CASE WHEN event_id % 7 = 0 THEN 'weekly' ELSE 'daily' END ORDER BY ts DESC, event_id) AS nth FROM events) WHERE NOT protected AND nth > CASE kind WHEN 'daily' THEN 7 ELSE 4 END")
def backup_prune(spark, sf):
    n = F.col("event_id")
    snaps = fx.table(spark, sf, "events").select(n.alias("id"), F.when(n % 7 == 0, "weekly").otherwise("daily").alias("kind"), (n % 10 == 0).alias("protected"), F.col("ts").alias("created_at"))
    return curation.kept_backups(snaps, {"daily": 7, "weekly": 4}).select("id")


@query("retention", f"SELECT id FROM searches WHERE created_at >= {NOW} - to_days(14)")
def retention(spark, sf):
    return fx.searches(spark, sf).filter(F.col("created_at") >= fx.now() - F.expr("INTERVAL 14 DAYS")).select("id")


@query("dream_page", "SELECT id, updated_at FROM memories WHERE (updated_at, id) > (TIMESTAMP '2023-11-01', '00000500') ORDER BY updated_at, id LIMIT 40")
def dream_page(spark, sf):
    after = (F.col("updated_at") > F.lit("2023-11-01").cast("timestamp")) | ((F.col("updated_at") == F.lit("2023-11-01").cast("timestamp")) & (F.col("id") > "00000500"))
    return fx.memories(spark, sf).filter(after).orderBy("updated_at", "id").limit(40).select("id", "updated_at")


@query("dream_watermark", "SELECT scope_id, max(updated_at) AS seen_at, arg_max(id, (updated_at, id)) AS id FROM memories GROUP BY scope_id")
def dream_watermark(spark, sf):
    x = fx.memories(spark, sf).groupBy("scope_id").agg(F.max(F.struct("updated_at", "id")).alias("x"))
    return x.select("scope_id", F.col("x.updated_at").alias("seen_at"), F.col("x.id").alias("id"))


_SHOWN = "(source_role IN ('user', 'manual', 'tool') OR source_role = 'inference' AND review_status = 'confirmed')"
_DURABLE = "is_static DESC, importance DESC, source_count DESC, updated_at DESC, id"


@query("profile_durable", f"SELECT scope_id, id, nth FROM (SELECT scope_id, id, row_number() OVER (PARTITION BY scope_id ORDER BY {_DURABLE}) AS nth FROM memories WHERE {LIVE} AND (source_role IN ('user', 'manual', 'tool') OR source_role = 'inference' AND review_status = 'confirmed') AND kind = 'preference') WHERE nth <= 10")
def profile_durable(spark, sf):
    m = fx.memories(spark, sf).filter(filters.live(fx.now()) & profiles.shown() & (F.col("kind") == "preference"))
    order = Window.partitionBy("scope_id").orderBy(F.desc("is_static"), F.desc("importance"), F.desc("source_count"), F.desc("updated_at"), "id")
    return m.withColumn("nth", F.row_number().over(order)).filter("nth <= 10").select("scope_id", "id", "nth")


@query("profile_recent", f"SELECT scope_id, id, nth FROM (SELECT scope_id, id, row_number() OVER (PARTITION BY scope_id ORDER BY (event_end IS NOT NULL AND event_end >= {NOW}) DESC, greatest(document_date, updated_at) DESC, importance DESC, id) AS nth FROM memories WHERE {LIVE} AND {_SHOWN}) WHERE nth <= 10")
def profile_recent(spark, sf):
    m = fx.memories(spark, sf).filter(filters.live(fx.now()) & profiles.shown())
    coming = F.coalesce(F.col("event_end") >= fx.now(), F.lit(False))
    order = Window.partitionBy("scope_id").orderBy(F.desc(coming), F.desc(F.greatest("document_date", "updated_at")), F.desc("importance"), "id")
    return m.withColumn("nth", F.row_number().over(order)).filter("nth <= 10").select("scope_id", "id", "nth")


@query("profile_budget", f"""WITH RECURSIVE r AS (SELECT scope_id, row_number() OVER (PARTITION BY scope_id ORDER BY {_DURABLE}) AS rank, {TOKENS} AS cost FROM memories WHERE {LIVE} AND {_SHOWN} AND kind = 'preference'),
 f AS (SELECT DISTINCT scope_id, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n, false AS took, CAST(0 AS BIGINT) AS cost FROM r
 UNION ALL SELECT f.scope_id, r.rank, CASE WHEN f.used + r.cost <= 800 AND f.n < 20 THEN f.used + r.cost ELSE f.used END, CASE WHEN f.used + r.cost <= 800 AND f.n < 20 THEN f.n + 1 ELSE f.n END, f.used + r.cost <= 800 AND f.n < 20, r.cost FROM f JOIN r ON r.scope_id = f.scope_id AND r.rank = f.rank + 1 WHERE r.rank <= 60)
 SELECT scope_id, rank, cost, used FROM f WHERE took""")
def profile_budget(spark, sf):
    m = fx.memories(spark, sf).filter(filters.live(fx.now()) & profiles.shown() & (F.col("kind") == "preference"))
    order = Window.partitionBy("scope_id").orderBy(F.desc("is_static"), F.desc("importance"), F.desc("source_count"), F.desc("updated_at"), "id")
    ranked = m.withColumn("rank", F.row_number().over(order)).filter("rank <= 60").select("scope_id", "rank", text.token_count(F.col("text")).alias("cost"))
    return retrieval.within_budget(ranked, 800, 20, "scope_id")


_PACKED = f"""b AS (SELECT unnest([300, 1500, 6000]) AS budget),
 fa AS (SELECT id, text, row_number() OVER (ORDER BY {_DURABLE}) AS nth FROM memories WHERE {LIVE} AND kind = 'fact'), pa AS (SELECT CAST(id AS VARCHAR) AS id, content AS text, row_number() OVER (ORDER BY id) AS nth FROM messages WHERE role = 'user'),
 so AS (SELECT fa.nth AS of_nth, fa.id AS fact, CAST(g.id AS VARCHAR) AS id, row_number() OVER (PARTITION BY fa.id ORDER BY g.id) AS nth, {TOKENS.replace('text', "substr(content, 1, end_char)")} + 6 + CASE WHEN g.id % 2 = 0 THEN {TOKENS.replace('text', 'content')} ELSE 0 END AS cost FROM fa JOIN evidence e ON e.memory_id = fa.id JOIN messages g ON g.id = e.message_id WHERE fa.nth <= 30),
 c AS (SELECT 0 AS phase, nth AS a, 0 AS b, 'fact' AS part, id, CAST(NULL AS VARCHAR) AS fact, {TOKENS} + 6 AS cost FROM fa WHERE nth <= 30 UNION ALL SELECT 0, nth, 1, 'passage', id, NULL, {TOKENS} + 6 FROM pa WHERE nth <= 30 UNION ALL SELECT 1, of_nth, nth, 'source', id, fact, cost FROM so),
 t AS (SELECT *, row_number() OVER (ORDER BY phase, a, b) AS k FROM c),
 f AS (SELECT budget, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS facts, false AS took FROM b
 UNION ALL SELECT budget, k, CASE WHEN ok THEN used + cost ELSE used END, n + CASE WHEN ok AND phase = 0 THEN 1 ELSE 0 END, CASE WHEN ok AND part = 'fact' THEN list_append(facts, id) ELSE facts END, ok FROM (SELECT f.budget, f.used, f.n, f.facts, t.*, f.used + t.cost <= f.budget AND CASE WHEN phase = 0 THEN f.n < 30 ELSE list_contains(f.facts, fact) END AS ok FROM f JOIN t ON t.k = f.k + 1))"""


@query("pack_context", f"WITH RECURSIVE {_PACKED} SELECT budget, part, id, fact, cost, used FROM f JOIN t ON t.k = f.k WHERE took")
def pack_context(spark, sf):
    """Facts and passages in turn, and then the sources of the facts taken from what is left, under three budgets."""
    m = fx.memories(spark, sf).filter(filters.live(fx.now()) & (F.col("kind") == "fact"))
    order = [F.desc("is_static"), F.desc("importance"), F.desc("source_count"), F.desc("updated_at"), "id"]
    facts = m.orderBy(*order).limit(30).select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"), text.token_count(F.col("text")).alias("cost"))
    messages = fx.messages(spark, sf)
    said = messages.filter("role = 'user'").orderBy("id").limit(30)
    passages = said.select(F.col("id").cast("string").alias("id"), F.row_number().over(Window.orderBy("id")).alias("rank"), text.token_count(F.col("content")).alias("cost"))
    cited = fx.evidence(spark, sf).join(messages.select(F.col("id").alias("message_id"), "content"), "message_id")
    around = F.when(F.col("message_id") % 2 == 0, text.token_count(F.col("content"))).otherwise(0)  # every other source comes with what stands around it
    sources = cited.select(
        F.col("memory_id").alias("fact"), F.col("message_id").cast("string").alias("id"), F.row_number().over(Window.partitionBy("memory_id").orderBy("message_id")).alias("nth"),
        (text.token_count(F.substr("content", F.lit(1), F.col("end_char"))) + around).alias("cost"),
    )
    packed = retrieval.packed(facts, passages, sources, [300, 1500, 6000], 30)
    return packed.select("budget", "part", "id", "fact", "cost", "used")


@query("review_queue", f"SELECT 'review' AS queue, id, source_role AS why FROM memories WHERE {LIVE} AND review_status = 'pending' AND source_role <> 'user' UNION ALL SELECT 'expiring', id, kind FROM memories WHERE status = 'active' AND valid_until > {NOW} AND valid_until <= {NOW} + to_days(7) UNION ALL SELECT 'failed', CAST(id AS VARCHAR), collection FROM outbox WHERE status = 'failed' AND attempts >= 8 UNION ALL SELECT 'conflict', r.to_id, r.from_id FROM relations r JOIN memories m ON m.id = r.to_id WHERE relation = 'updates' AND m.status = 'active'")
def review_queue(spark, sf):
    m, now = fx.memories(spark, sf), fx.now()
    a = m.filter(filters.live(now) & (F.col("review_status") == "pending") & (F.col("source_role") != "user")).select(F.lit("review").alias("queue"), "id", F.col("source_role").alias("why"))
    b = m.filter((F.col("status") == "active") & (F.col("valid_until") > now) & (F.col("valid_until") <= now + F.expr("INTERVAL 7 DAYS"))).select(F.lit("expiring"), "id", "kind")
    c = fx.outbox(spark, sf).filter("status = 'failed' AND attempts >= 8").select(F.lit("failed"), F.col("id").cast("string"), "collection")
    open_ends = fx.relations(spark, sf).filter("relation = 'updates'").join(m.filter("status = 'active'").select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return a.unionAll(b).unionAll(c).unionAll(open_ends.select(F.lit("conflict"), "to_id", "from_id"))


@query("candidate_block", """WITH s AS (SELECT c_custkey AS user_id, 'src' || CAST(c_custkey % 20 AS VARCHAR) AS scope_id, ['en', 'de', 'fr', 'es'][c_custkey % 4 + 1] AS lang, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS asked FROM customer),
 a AS (SELECT m.*, v.v FROM memories m LEFT JOIN vectors v ON v.id = m.id WHERE status = 'active'),
 r AS (SELECT user_id, a.id, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, a.id) AS nth FROM s JOIN a ON a.scope_id = s.scope_id AND a.lang = s.lang),
 n AS (SELECT * FROM r WHERE nth <= 6), k AS (SELECT user_id, count(*) AS k FROM n GROUP BY user_id),
 d AS (SELECT s.user_id, a.id, list_dot_product(a.v, q.v) AS c FROM s JOIN vectors q ON q.id = s.asked JOIN a ON a.scope_id = s.scope_id AND a.v IS NOT NULL WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = s.user_id AND n.id = a.id)),
 e AS (SELECT d.user_id, d.id, row_number() OVER (PARTITION BY d.user_id ORDER BY c DESC, d.id) AS nth, coalesce(k, 0) AS k FROM d LEFT JOIN k ON k.user_id = d.user_id)
 SELECT user_id, id, nth, 'recent' AS arm FROM n UNION ALL SELECT user_id, id, nth + k, 'dense' FROM e WHERE nth + k <= 10""")
def candidate_block(spark, sf):
    """What an extraction may change: for each session the newest of its scope and context, filled up to ten with those near to what was said."""
    c = F.col("c_custkey")
    sessions = fx.table(spark, sf, "customer").select(
        c.alias("user_id"), F.concat(F.lit("src"), (c % 20).cast("string")).alias("scope_id"), F.element_at(F.array(*map(F.lit, ["en", "de", "fr", "es"])), (c % 4 + 1).cast("int")).alias("lang"), F.lpad(c.cast("string"), 8, "0").alias("asked")
    )
    v = fx.vectors(spark, sf).select("id", "v")
    sessions = sessions.join(v.select(F.col("id").alias("asked"), F.col("v").alias("q")), "asked", "left")
    rows = fx.memories(spark, sf).filter("status = 'active'").select("id", "scope_id", "lang", "updated_at").join(v, "id", "left")
    return curation.candidates(sessions, rows, "user_id")


@query("prompt_entities", """WITH u AS (SELECT c_custkey AS user_id FROM customer), o AS (
 SELECT user_id, 'user' || CAST(user_id AS VARCHAR) AS id, 0 AS place, 'you' AS label FROM u UNION ALL SELECT user_id, 'src0', 1, 'team' FROM u
 UNION ALL SELECT m.user_id, e.id, 2, e.kind FROM memberships m JOIN entities e ON e.id = m.entity_id WHERE NOT e.archived AND e.kind NOT IN ('user', 'team')
 UNION ALL SELECT a.user_id, 'user' || CAST(b.user_id AS VARCHAR), 3, 'teammate' FROM memberships a JOIN memberships b ON a.entity_id = b.entity_id AND a.user_id <> b.user_id WHERE a.role = 'owner' AND b.role = 'owner'),
 f AS (SELECT user_id, id, min(place) AS place, arg_min(label, place) AS label FROM o GROUP BY user_id, id), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place, id) AS nth FROM f)
 SELECT user_id, id, label, nth FROM n WHERE nth <= 40""")
def prompt_entities(spark, sf):
    """The numbered entities that a speaker may name: themself, the team, their projects, teammates; the first forty."""
    users = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    e = fx.entities(spark, sf)
    own = users.select("user_id", F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("id"), F.lit(0).alias("place"), F.lit("you").alias("label"))
    team = users.crossJoin(F.broadcast(e.filter("kind = 'team'").select("id").limit(1))).select("user_id", "id", F.lit(1), F.lit("team"))  # an instance has one team
    projects = fx.memberships(spark, sf).join(e.filter("NOT archived AND kind NOT IN ('user', 'team')").select(F.col("id").alias("entity_id"), "kind"), "entity_id").select("user_id", F.col("entity_id"), F.lit(2), "kind")
    mates = teammates(spark, sf).select("user_id", F.concat(F.lit("user"), F.col("mate").cast("string")), F.lit(3), F.lit("teammate"))
    return curation.numbered_entities(own.unionAll(team).unionAll(projects).unionAll(mates), 40)


@query("index_parity", "SELECT 'missing' AS side, m.id FROM memories m WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM vectors v WHERE v.id = m.id) UNION ALL SELECT 'orphan', v.id FROM vectors v WHERE NOT EXISTS (SELECT 1 FROM memories m WHERE m.id = v.id AND m.status = 'active')")
def index_parity(spark, sf):
    live, there = fx.memories(spark, sf).filter("status = 'active'").select("id"), fx.vectors(spark, sf).select("id")
    return live.join(there, "id", "left_anti").select(F.lit("missing").alias("side"), "id").unionAll(there.join(live, "id", "left_anti").select(F.lit("orphan"), "id"))


_ISO = "'%Y-%m-%dT%H:%M:%SZ'"


@query("memory_summary", f"""SELECT m.id, sha256(text) AS text_sha, m.kind, round(CAST(importance AS DOUBLE), 3) AS importance, round(CAST(confidence AS DOUBLE), 4) AS confidence, review_status, source_role, status, scope_id AS scope, e.kind AS scope_kind, c.c_name AS subject, 'user' || CAST(subject_id AS VARCHAR) AS subject_slug,
 array_to_string(tags, ',') AS tags, strftime(created_at, {_ISO}) AS created_at, strftime(updated_at, {_ISO}) AS updated_at, revision, strftime(document_date, {_ISO}) AS document_date, strftime(event_start, '%Y-%m-%d') AS event_dates, is_static, source_count
 FROM memories m JOIN entities e ON e.id = m.scope_id LEFT JOIN customer c ON c.c_custkey = m.subject_id""")
def memory_summary(spark, sf):
    """What every list shows of a memory: twenty fields, names with what links to them."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    e = fx.entities(spark, sf).select(F.col("id").alias("scope"), F.col("kind").alias("scope_kind"))
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_name").alias("subject"))
    m = fx.memories(spark, sf).withColumnRenamed("scope_id", "scope").join(e, "scope").join(c, "subject_id", "left")
    return m.select(
        "id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha"), "kind", F.round(F.col("importance").cast("double"), 3).alias("importance"), F.round(F.col("confidence").cast("double"), 4).alias("confidence"), "review_status", "source_role", "status", "scope", "scope_kind", "subject",
        F.concat(F.lit("user"), F.col("subject_id").cast("string")).alias("subject_slug"), F.array_join("tags", ",").alias("tags"), iso("created_at"), iso("updated_at"), "revision", iso("document_date"), F.date_format("event_start", "yyyy-MM-dd").alias("event_dates"), "is_static", "source_count",
    )


@query("profile_render", f"""WITH RECURSIVE m AS (SELECT *, {TOKENS} AS cost FROM memories WHERE {LIVE} AND {_SHOWN}),
 o AS (SELECT scope_id, 0 AS b, row_number() OVER (PARTITION BY scope_id ORDER BY {_DURABLE}) AS nth, id, cost FROM m WHERE kind = 'fact' OR is_static
 UNION ALL SELECT scope_id, 1, row_number() OVER (PARTITION BY scope_id ORDER BY {_DURABLE}), id, cost FROM m WHERE kind = 'preference'
 UNION ALL SELECT scope_id, 2, row_number() OVER (PARTITION BY scope_id ORDER BY greatest(document_date, updated_at) DESC, id), id, cost FROM m WHERE kind = 'episode'),
 t AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY b, nth) AS k FROM o WHERE nth <= 60),
 f AS (SELECT DISTINCT scope_id, CAST(0 AS BIGINT) AS k, -1 AS b, CAST(0 AS BIGINT) AS spent, CAST(3000 AS BIGINT) AS lft, CAST([] AS VARCHAR[]) AS seen, false AS took, '' AS id, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS cost FROM t
 UNION ALL SELECT scope_id, k, b, CASE WHEN ok THEN sp + cost ELSE sp END, CASE WHEN ok THEN lft - cost ELSE lft END, CASE WHEN ok THEN list_append(seen, id) ELSE seen END, ok, id, nth, cost FROM (
  SELECT t.scope_id, t.k, t.b, CASE WHEN f.b = t.b THEN f.spent ELSE 0 END AS sp, f.lft, f.seen, t.id, t.nth, t.cost,
   NOT list_contains(f.seen, t.id) AND t.cost <= f.lft AND CASE WHEN f.b = t.b THEN f.spent ELSE 0 END + t.cost <= CASE t.b WHEN 0 THEN 600 WHEN 1 THEN 1050 ELSE CASE WHEN f.b = t.b THEN f.lft + f.spent ELSE f.lft END END AS ok
  FROM f JOIN t ON t.scope_id = f.scope_id AND t.k = f.k + 1))
 SELECT scope_id, CASE b WHEN 0 THEN 'about' WHEN 1 THEN 'style' ELSE 'recent' END AS block, nth, id, cost FROM f WHERE took""")
def profile_render(spark, sf):
    m = fx.memories(spark, sf).filter(filters.live(fx.now()) & profiles.shown()).withColumn("cost", text.token_count(F.col("text")))
    durable = [F.desc("is_static"), F.desc("importance"), F.desc("source_count"), F.desc("updated_at"), "id"]
    recent = [F.desc(F.greatest("document_date", "updated_at")), "id"]
    block = lambda name, rows, order: rows.select("scope_id", F.lit(name).alias("block"), F.row_number().over(Window.partitionBy("scope_id").orderBy(*order)).alias("nth"), "id", "cost")
    offered = block("about", m.filter("kind = 'fact' OR is_static"), durable).unionAll(block("style", m.filter("kind = 'preference'"), durable)).unionAll(block("recent", m.filter("kind = 'episode'"), recent))
    return profiles.rendered(offered, 3000, ["about", "style", "recent"], "scope_id")


@query("round_robin", "SELECT session_id, id, place FROM (SELECT session_id, id, row_number() OVER (ORDER BY nth, session_id) AS place FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY length(content) DESC, id) AS nth FROM messages WHERE role = 'user') WHERE nth <= 8) WHERE place <= 60")
def round_robin(spark, sf):
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc(F.length("content")), "id"))
    top = fx.messages(spark, sf).filter("role = 'user'").withColumn("nth", nth).filter("nth <= 8").orderBy("nth", "session_id").limit(60)
    return top.select("session_id", "id", F.row_number().over(Window.orderBy("nth", "session_id")).alias("place"))


@query("cluster_subsets", "WITH c AS (SELECT conv_id AS no, list_distinct(list(length(text) % 7)) AS members FROM conversations GROUP BY conv_id) SELECT no FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.no < a.no AND list_has_all(b.members, a.members))")
def cluster_subsets(spark, sf):
    c = fx.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("no")).agg(F.collect_set(F.length("text") % 7).alias("members"))
    return profiles.without_subsets(c).select("no")
