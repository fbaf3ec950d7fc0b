"""Queries on statistics, dashboards, telemetry and the work queue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gistmill.operators import stats
from gistmill.plans.registry import query
from gistmill.sources import fixtures as fx

NOW = f"TIMESTAMP '{fx.NOW}'"


def everything():
    return Window.partitionBy()


for _key, _column in (("kind", "kind"), ("scope", "scope_id"), ("role", "source_role"), ("review", "review_status")):

    @query(f"stats_memories_{_key}", f"SELECT CAST(created_at AS DATE) AS day, {_column} AS key, count(*) AS value FROM memories WHERE created_at >= {NOW} - to_days(120) GROUP BY ALL")
    def stats_memories(spark, sf, column=_column):
        m = fx.memories(spark, sf).filter(F.col("created_at") >= fx.now() - F.expr("INTERVAL 120 DAYS"))
        return stats.by_day(m, "created_at", column)


@query("stats_totals", """SELECT count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'active' AND review_status = 'pending') AS pending, count(*) FILTER (status = 'archived') AS archived,
 count(*) FILTER (status = 'superseded') AS superseded, count(*) FILTER (subject_id IS NOT NULL) AS about_someone FROM memories""")
def stats_totals(spark, sf):
    active = F.col("status") == "active"
    return fx.memories(spark, sf).agg(
        F.count_if(active).alias("active"), F.count_if(active & (F.col("review_status") == "pending")).alias("pending"), F.count_if(F.col("status") == "archived").alias("archived"),
        F.count_if(F.col("status") == "superseded").alias("superseded"), F.count_if(F.col("subject_id").isNotNull()).alias("about_someone"),
    )


_OUTCOMES = "SELECT CAST(ts AS DATE) AS day, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events"


@query("stats_pipeline", f"""SELECT day, CAST(sum(CASE WHEN event_type = 'signup' THEN k END) AS BIGINT) AS added, CAST(sum(CASE WHEN event_type = 'error' THEN k END) AS BIGINT) AS rejected,
 round(coalesce(sum(CASE WHEN event_type = 'signup' THEN k END), 0) / nullif(coalesce(sum(CASE WHEN event_type IN ('signup', 'error') THEN k END), 0), 0), 4) AS acceptance FROM ({_OUTCOMES}) GROUP BY day""")
def stats_pipeline(spark, sf):
    e = fx.table(spark, sf, "events").select(F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_type")
    of = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("k")))
    out = e.groupBy("day").agg(of("signup").alias("added"), of("error").alias("rejected"))
    wrote, noise = F.coalesce("added", F.lit(0)), F.coalesce("rejected", F.lit(0))
    return out.withColumn("acceptance", F.round(stats.share(wrote, wrote + noise), 4))


@query("stats_spend", "SELECT CAST(created_at AS DATE) AS day, model, CAST(sum(cost) AS DOUBLE) AS cost, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS tokens, count(*) AS calls, count(error) AS errors FROM calls GROUP BY ALL")
def stats_spend(spark, sf):
    return fx.calls(spark, sf).groupBy(F.to_date("created_at").alias("day"), "model").agg(F.sum("cost").cast("double").alias("cost"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), F.count("*").alias("calls"), F.count("error").alias("errors"))


@query("month_spend", "SELECT strftime(created_at, '%Y-%m') AS period, CAST(sum(cost) AS DOUBLE) AS spend, count(*) AS calls, count(error) AS errors FROM calls WHERE strftime(created_at, '%Y-%m') = '2024-01' GROUP BY ALL")
def month_spend(spark, sf):
    c = fx.calls(spark, sf).withColumn("period", F.date_format("created_at", "yyyy-MM")).filter("period = '2024-01'")
    return c.groupBy("period").agg(F.sum("cost").cast("double").alias("spend"), F.count("*").alias("calls"), F.count("error").alias("errors"))


_LATENCY = "round(quantile_cont(total_ms, 0.5), 1) AS p50, round(quantile_disc(total_ms, 0.95), 1) AS p95, count(*) AS searches, round(avg(CAST(abstained AS DOUBLE)), 4) AS abstention"


@query("stats_retrieval", f"SELECT CAST(created_at AS DATE) AS day, {_LATENCY} FROM searches GROUP BY ALL")
def stats_retrieval(spark, sf):
    return stats.latencies(fx.searches(spark, sf), F.to_date("created_at").alias("day"))


@query("stats_retrieval_all", f"SELECT {_LATENCY} FROM searches")
def stats_retrieval_all(spark, sf):
    return stats.latencies(fx.searches(spark, sf))


@query("telemetry_percentiles", "SELECT user_id, quantile_disc(total_ms, 0.5) AS p50, quantile_disc(total_ms, 0.95) AS p95, quantile_disc(total_ms, 0.99) AS p99, count(*) AS n FROM searches GROUP BY user_id")
def telemetry_percentiles(spark, sf):
    return fx.searches(spark, sf).groupBy("user_id").agg(*[stats.nearest_rank("total_ms", s).alias(f"p{round(s * 100)}") for s in (0.5, 0.95, 0.99)], F.count("*").alias("n"))


@query("feedback_labels", "SELECT count(*) AS labels, count(DISTINCT run_id) AS runs, round(avg(CAST(useful AS INTEGER)), 4) AS useful, round(avg(CAST(correct AS INTEGER)), 4) AS correct FROM feedback")
def feedback_labels(spark, sf):
    mean = lambda c: F.round(F.avg(F.col(c).cast("int")), 4).alias(c)
    return fx.feedback(spark, sf).agg(F.count("*").alias("labels"), F.count_distinct("run_id").alias("runs"), mean("useful"), mean("correct"))


@query("feedback_days", "SELECT CAST(f.created_at AS DATE) AS day, count(*) FILTER (useful) AS useful, count(*) FILTER (NOT useful) AS not_useful FROM feedback f JOIN searches s ON s.id = f.run_id GROUP BY ALL")
def feedback_days(spark, sf):
    f = fx.feedback(spark, sf).join(fx.searches(spark, sf).select(F.col("id").alias("run_id")), "run_id")
    return f.groupBy(F.to_date("created_at").alias("day")).agg(F.count_if("useful").alias("useful"), F.count_if(~F.col("useful")).alias("not_useful"))


@query("feedback_upsert", "SELECT memory_id, arg_max(useful, run_id) AS useful, arg_max(created_at, run_id) AS created_at FROM feedback GROUP BY memory_id")
def feedback_upsert(spark, sf):
    return fx.feedback(spark, sf).groupBy("memory_id").agg(F.max_by("useful", "run_id").alias("useful"), F.max_by("created_at", "run_id").alias("created_at"))


@query("spend_by_user", "SELECT c_name AS name, CAST(sum(cost) AS DOUBLE) AS spend, count(*) AS calls, row_number() OVER (ORDER BY sum(cost) DESC, c_name) AS nth FROM calls JOIN customer ON c_custkey = user_id WHERE strftime(created_at, '%Y-%m') = '2024-01' GROUP BY c_name")
def spend_by_user(spark, sf):
    c = fx.calls(spark, sf).filter(F.date_format("created_at", "yyyy-MM") == "2024-01").groupBy("user_id").agg(F.sum("cost").alias("spend"), F.count("*").alias("calls"))
    named = c.join(fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name")), "user_id")
    named = named.groupBy("name").agg(F.sum("spend").alias("spend"), F.sum("calls").alias("calls"))
    return stats.ranked(named, [F.desc("spend"), F.asc("name")]).select("name", F.col("spend").cast("double").alias("spend"), "calls", "nth")


@query("review_flow", f"""SELECT CAST(created_at AS DATE) AS day, 'opened' AS key, count(*) AS value FROM memories WHERE review_status = 'pending' AND created_at >= {NOW} - to_days(60) GROUP BY ALL
 UNION ALL SELECT CAST(updated_at AS DATE), review_status, count(*) FROM memories WHERE review_status <> 'pending' AND updated_at >= {NOW} - to_days(60) GROUP BY ALL""")
def review_flow(spark, sf):
    m, since = fx.memories(spark, sf), fx.now() - F.expr("INTERVAL 60 DAYS")
    opened = stats.by_day(m.filter((F.col("review_status") == "pending") & (F.col("created_at") >= since)), "created_at", F.lit("opened"))
    return opened.unionAll(stats.by_day(m.filter((F.col("review_status") != "pending") & (F.col("updated_at") >= since)), "updated_at", "review_status"))


@query("review_backlog", "SELECT source_role AS key, count(*) AS value, min(created_at) AS oldest FROM memories WHERE status = 'active' AND review_status = 'pending' GROUP BY source_role")
def review_backlog(spark, sf):
    return fx.memories(spark, sf).filter("status = 'active' AND review_status = 'pending'").groupBy(F.col("source_role").alias("key")).agg(F.count("*").alias("value"), F.min("created_at").alias("oldest"))


@query("stats_entities", """SELECT e.id, e.kind, count(*) FILTER (m.scope_id = e.id AND m.status = 'active') AS in_scope, count(*) FILTER ('user' || CAST(m.subject_id AS VARCHAR) = e.id AND m.status = 'active') AS about, max(m.updated_at) AS last_activity,
 (SELECT count(*) FROM memberships mm WHERE mm.entity_id = e.id) AS members, row_number() OVER (ORDER BY count(m.id) DESC, e.id) AS nth
 FROM entities e LEFT JOIN memories m ON (m.scope_id = e.id OR 'user' || CAST(m.subject_id AS VARCHAR) = e.id) WHERE NOT e.archived GROUP BY e.id, e.kind HAVING count(m.id) > 0 ORDER BY count(m.id) DESC, e.id LIMIT 10""")
def stats_entities(spark, sf):
    """The condition with OR is two equi joins; a memory that meets both counts once."""
    m = fx.memories(spark, sf).select("id", "scope_id", F.concat(F.lit("user"), F.col("subject_id").cast("string")).alias("subject"), "status", "updated_at")
    e = fx.entities(spark, sf).filter(~F.col("archived")).select(F.col("id").alias("entity"), "kind")
    active = F.col("status") == "active"
    held = m.withColumn("entity", F.col("scope_id")).select("entity", "id", (active).alias("in_scope"), (active & F.col("subject").eqNullSafe(F.col("scope_id"))).alias("about"), "updated_at")
    about = m.filter(F.col("subject").isNotNull() & (F.col("subject") != F.col("scope_id"))).select(F.col("subject").alias("entity"), "id", F.lit(False).alias("in_scope"), active.alias("about"), "updated_at")
    counts = held.unionAll(about).groupBy("entity").agg(F.count_if("in_scope").alias("in_scope"), F.count_if("about").alias("about"), F.max("updated_at").alias("last_activity"), F.count("*").alias("n"))
    members = fx.memberships(spark, sf).groupBy(F.col("entity_id").alias("entity")).agg(F.count("*").alias("members"))
    out = e.join(counts, "entity").join(members, "entity", "left").orderBy(F.desc("n"), "entity").limit(10)
    return out.select(F.col("entity").alias("id"), "kind", "in_scope", "about", "last_activity", F.coalesce("members", F.lit(0)).alias("members"), F.row_number().over(Window.orderBy(F.desc("n"), "entity")).alias("nth"))


@query("stats_users", f"""SELECT c_custkey AS user_id, (SELECT count(*) FROM memories m WHERE m.author_id = c_custkey AND m.created_at >= {NOW} - to_days(30)) AS memories, (SELECT count(*) FROM memories m WHERE m.author_id = c_custkey) AS memories_all_time,
 (SELECT count(*) FROM searches s WHERE s.user_id = c_custkey AND s.created_at >= {NOW} - to_days(30)) AS searches, (SELECT count(DISTINCT session_id) FROM messages g WHERE g.user_id = c_custkey) AS sessions, (SELECT count(*) FROM memberships b WHERE b.user_id = c_custkey) AS memberships,
 (SELECT CAST(coalesce(sum(cost), 0) AS DOUBLE) FROM calls j WHERE j.user_id = c_custkey AND strftime(j.created_at, '%Y-%m') = '2024-01') AS month_spend FROM customer""")
def stats_users(spark, sf):
    """Correlated counts are aggregated once each and joined."""
    since = fx.now() - F.expr("INTERVAL 30 DAYS")
    parts = [
        fx.memories(spark, sf).groupBy(F.col("author_id").alias("user_id")).agg(F.count_if(F.col("created_at") >= since).alias("memories"), F.count("*").alias("memories_all_time")),
        fx.searches(spark, sf).filter(F.col("created_at") >= since).groupBy("user_id").agg(F.count("*").alias("searches")),
        fx.messages(spark, sf).groupBy("user_id").agg(F.count_distinct("session_id").alias("sessions")),
        fx.memberships(spark, sf).groupBy("user_id").agg(F.count("*").alias("memberships")),
        fx.calls(spark, sf).filter(F.date_format("created_at", "yyyy-MM") == "2024-01").groupBy("user_id").agg(F.sum("cost").cast("double").alias("month_spend")),
    ]
    out = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    for part in parts:
        out = out.join(part, "user_id", "left")
    return out.na.fill(0).na.fill(0.0, ["month_spend"])


@query("stats_users_days", "SELECT CAST(created_at AS DATE) AS day, c_name AS key, count(*) AS value FROM memories JOIN customer ON c_custkey = author_id GROUP BY ALL")
def stats_users_days(spark, sf):
    m = fx.memories(spark, sf).join(fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("author_id"), "c_name"), "author_id")
    return stats.by_day(m, "created_at", "c_name")


@query("metrics", "SELECT (SELECT count(*) FROM memories WHERE status = 'active') AS active, (SELECT count(*) FROM messages) AS messages, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM relations) AS relations, (SELECT count(*) FROM outbox WHERE status = 'pending') AS backlog, (SELECT count(*) FROM searches WHERE abstained) AS abstained, (SELECT count(*) FROM calls WHERE error IS NOT NULL) AS failed_calls, (SELECT count(*) FROM vectors) AS vectors")
def metrics(spark, sf):
    counts = [
        fx.memories(spark, sf).agg(F.count_if(F.col("status") == "active").alias("active")), fx.messages(spark, sf).agg(F.count("*").alias("messages")), fx.entities(spark, sf).agg(F.count("*").alias("entities")),
        fx.relations(spark, sf).agg(F.count("*").alias("relations")), fx.outbox(spark, sf).agg(F.count_if(F.col("status") == "pending").alias("backlog")), fx.searches(spark, sf).agg(F.count_if("abstained").alias("abstained")),
        fx.calls(spark, sf).agg(F.count("error").alias("failed_calls")), fx.vectors(spark, sf).agg(F.count("*").alias("vectors")),
    ]
    long = counts[0].select(F.lit("active").alias("k"), F.col("active").alias("n"))
    for c in counts[1:]:
        long = long.unionAll(c.select(F.lit(c.columns[0]), c.columns[0]))
    return long.agg(*[F.max(F.when(F.col("k") == c.columns[0], F.col("n"))).alias(c.columns[0]) for c in counts])


@query("outbox_backlog", "SELECT collection, status, count(*) AS n, min(created_at) AS oldest FROM outbox GROUP BY ALL")
def outbox_backlog(spark, sf):
    return fx.outbox(spark, sf).groupBy("collection", "status").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"))


@query("outbox_latest", "SELECT collection, entity_id, max(id) AS id, arg_max(operation, id) AS operation, arg_max(status, id) AS status FROM outbox GROUP BY ALL")
def outbox_latest(spark, sf):
    return fx.outbox(spark, sf).groupBy("collection", "entity_id").agg(F.max("id").alias("id"), F.max_by("operation", "id").alias("operation"), F.max_by("status", "id").alias("status"))


@query("outbox_claim", "SELECT collection, entity_id, id FROM outbox o WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM outbox p WHERE p.collection = o.collection AND p.entity_id = o.entity_id AND p.status IN ('pending', 'claimed') AND p.id < o.id)")
def outbox_claim(spark, sf):
    """The earliest open delivery of each entity, if it is still to be claimed."""
    opened = fx.outbox(spark, sf).filter(F.col("status").isin("pending", "claimed"))
    return opened.groupBy("collection", "entity_id").agg(F.min("id").alias("id"), F.min_by("status", "id").alias("status")).filter("status = 'pending'").drop("status")


@query("jobs_by_status", "SELECT status, operation AS kind, count(*) AS n FROM outbox GROUP BY ALL")
def jobs_by_status(spark, sf):
    return fx.outbox(spark, sf).groupBy("status", F.col("operation").alias("kind")).agg(F.count("*").alias("n"))


@query("dismissed_jobs", "SELECT id FROM outbox o WHERE status = 'failed' AND NOT EXISTS (SELECT 1 FROM feedback f WHERE f.run_id = o.id)")
def dismissed_jobs(spark, sf):
    return fx.outbox(spark, sf).filter("status = 'failed'").select("id").join(fx.feedback(spark, sf).select(F.col("run_id").alias("id")), "id", "left_anti")


@query("budget_check", "SELECT period, spend, spend + 0.5 + 0.25 <= 100 + 1e-12 AS allowed FROM (SELECT strftime(created_at, '%Y-%m') AS period, CAST(sum(cost) AS DOUBLE) AS spend FROM calls GROUP BY ALL)")
def budget_check(spark, sf):
    spent = fx.calls(spark, sf).groupBy(F.date_format("created_at", "yyyy-MM").alias("period")).agg(F.sum("cost").cast("double").alias("spend"))
    return spent.withColumn("allowed", F.col("spend") + 0.5 + 0.25 <= 100 + 1e-12)


@query("calls_by_model", "SELECT kind, model, count(*) AS n, count(error) AS errors, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, round(avg(latency), 4) AS latency FROM calls GROUP BY ALL")
def calls_by_model(spark, sf):
    return fx.calls(spark, sf).groupBy("kind", "model").agg(F.count("*").alias("n"), F.count("error").alias("errors"), F.sum("tokens_in").alias("tokens_in"), F.round(F.avg("latency"), 4).alias("latency"))


_REPORT = " UNION ALL ".join(f"SELECT '{name}' AS what, CAST({column} AS VARCHAR) AS key, count(*) AS n FROM memories WHERE status = 'active' AND scope_id IN ('src0', 'src1', 'src4') GROUP BY ALL" for name, column in (("version", "revision"), ("role", "source_role"), ("review", "review_status"), ("context", "lang")))


@query("reextract_report", f"""WITH s AS (SELECT session_id, count(*) AS n FROM messages WHERE scope_id IN ('src0', 'src1', 'src4') GROUP BY session_id)
 {_REPORT} UNION ALL SELECT 'total', 'sessions', count(*) FROM s UNION ALL SELECT 'total', 'messages', CAST(coalesce(sum(n), 0) AS BIGINT) FROM s UNION ALL SELECT 'total', 'windows', CAST(coalesce(sum(ceil(n / 10.0)), 0) AS BIGINT) FROM s""")
def reextract_report(spark, sf):
    """What a new extraction of some scopes would touch: active claims by version, role, review and context, and windows, rounded for each session."""
    scopes = ["src0", "src1", "src4"]
    m = fx.memories(spark, sf).filter((F.col("status") == "active") & F.col("scope_id").isin(scopes))
    return stats.extraction_report(m.withColumn("context", F.col("lang")), fx.messages(spark, sf).filter(F.col("scope_id").isin(scopes)), {"version": "revision", "role": "source_role", "review": "review_status", "context": "context"})


@query("searches_visible", "SELECT s.id, f.useful, m.text AS said FROM searches s LEFT JOIN feedback f ON f.run_id = s.id LEFT JOIN (SELECT * FROM memories WHERE scope_id IN ('src0', 'src1')) m ON m.id = f.memory_id")
def searches_visible(spark, sf):
    """Telemetry keeps no text; that of unreadable memories stays masked."""
    m = fx.memories(spark, sf).filter(F.col("scope_id").isin("src0", "src1")).select(F.col("id").alias("memory_id"), F.col("text").alias("said"))
    f = fx.feedback(spark, sf).select(F.col("run_id").alias("id"), "useful", "memory_id")
    return fx.searches(spark, sf).select("id").join(f, "id", "left").join(m, "memory_id", "left").select("id", "useful", "said")


_SERIES = "SELECT CAST(ts AS DATE) AS day, event_type AS key, count(*) AS value FROM events GROUP BY ALL"
_KEYS = ["click", "error", "purchase", "signup", "view"]


def _series(spark, sf):
    return stats.by_day(fx.table(spark, sf, "events"), "ts", "event_type")


@query("series_pivot", f"SELECT day, {', '.join(f'CAST(coalesce(sum(value) FILTER (key = $${k}$$), 0) AS BIGINT) AS {k}' for k in _KEYS)} FROM ({_SERIES}) GROUP BY day")
def series_pivot(spark, sf):
    return stats.pivoted(_series(spark, sf), _KEYS)


@query("series_dense", f"SELECT CAST(d AS DATE) AS day, CAST(coalesce((SELECT sum(value) FROM ({_SERIES}) s WHERE s.day = CAST(d AS DATE) AND key = 'click'), 0) AS BIGINT) AS click FROM generate_series(DATE '2023-12-20', DATE '2024-02-10', INTERVAL 1 DAY) g(d)")
def series_dense(spark, sf):
    wide = stats.pivoted(_series(spark, sf), ["click"])
    return stats.densified(wide, F.lit("2023-12-20").cast("date"), F.lit("2024-02-10").cast("date"), ["click"])


@query("series_totals", f"SELECT key, CAST(sum(value) AS BIGINT) AS total, row_number() OVER (ORDER BY sum(value) DESC, key) AS nth FROM ({_SERIES}) GROUP BY key")
def series_totals(spark, sf):
    return stats.totals(_series(spark, sf))


@query("heat_levels", f"SELECT day, key, CASE WHEN value <= 0 THEN 0 ELSE CAST(ceil(value / max(value) OVER () * 4) AS INTEGER) END AS level FROM ({_SERIES})")
def heat_levels(spark, sf):
    rows = _series(spark, sf)
    return rows.select("day", "key", stats.heat_level(F.col("value"), rows.agg(F.max("value")).scalar()).alias("level"))


@query("cost_models", "SELECT DISTINCT substr(k, 6) AS model FROM (SELECT 'cost:' || model AS k FROM calls UNION ALL SELECT 'tokens') WHERE starts_with(k, 'cost:')")
def cost_models(spark, sf):
    k = fx.calls(spark, sf).select(F.concat(F.lit("cost:"), "model").alias("k")).unionAll(spark.range(1).select(F.lit("tokens")))
    return k.filter(F.startswith("k", F.lit("cost:"))).select(F.substr("k", F.lit(6)).alias("model")).distinct()


@query("spend_pace", "SELECT period, round(least(100, (spend + 1.0) / 120 * 100), 4) AS percent, round(120.0 / day(last_day(CAST(period || '-01' AS DATE))), 4) AS daily FROM (SELECT strftime(created_at, '%Y-%m') AS period, CAST(sum(cost) AS DOUBLE) AS spend FROM calls GROUP BY ALL)")
def spend_pace(spark, sf):
    spent = fx.calls(spark, sf).groupBy(F.date_format("created_at", "yyyy-MM").alias("period")).agg(F.sum("cost").cast("double").alias("spend"))
    days = F.dayofmonth(F.last_day(F.to_date(F.concat("period", F.lit("-01")))))
    return spent.select("period", F.round(F.least(F.lit(100.0), (F.col("spend") + 1.0) / 120 * 100), 4).alias("percent"), F.round(120.0 / days, 4).alias("daily"))


@query("person_matrix", "SELECT user_id, day, n, max(n) OVER () AS peak, CAST(sum(n) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM (SELECT user_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM searches GROUP BY ALL)")
def person_matrix(spark, sf):
    d = fx.searches(spark, sf).groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    return d.withColumns({"peak": d.agg(F.max("n")).scalar(), "total": F.sum("n").over(Window.partitionBy("user_id"))})


@query("eval_recall_mrr", """WITH q AS (SELECT f.run_id AS id, row_number() OVER (PARTITION BY f.memory_id ORDER BY f.run_id) AS rank, f.memory_id, useful FROM feedback f),
 c AS (SELECT memory_id, min(rank) FILTER (useful) AS first FROM q WHERE rank <= 10 GROUP BY memory_id)
 SELECT count(*) AS cases, round(avg(CASE WHEN first IS NULL THEN 0 ELSE 1 END), 4) AS recall, round(avg(coalesce(1.0 / first, 0)), 4) AS mrr, count(*) FILTER (first = 1) AS top1 FROM c""")
def eval_recall_mrr(spark, sf):
    rank = F.row_number().over(Window.partitionBy("memory_id").orderBy("run_id"))
    q = fx.feedback(spark, sf).withColumn("rank", rank).filter("rank <= 10")
    c = q.groupBy("memory_id").agg(F.min(F.when(F.col("useful"), F.col("rank"))).alias("first"))
    return c.agg(F.count("*").alias("cases"), F.round(F.avg(F.col("first").isNotNull().cast("int")), 4).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"), F.count_if(F.col("first") == 1).alias("top1"))


@query("eval_binary", "SELECT count(*) FILTER (useful AND correct) AS tp, count(*) FILTER (useful AND NOT correct) AS fp, count(*) FILTER (NOT useful AND correct) AS fn, round(count(*) FILTER (useful AND correct) / nullif(count(*) FILTER (useful AND correct IS NOT NULL), 0), 4) AS prec, round(count(*) FILTER (useful AND correct) / nullif(count(*) FILTER (correct), 0), 4) AS recall FROM feedback")
def eval_binary(spark, sf):
    u, c = F.col("useful"), F.col("correct")
    n = fx.feedback(spark, sf).agg(F.count_if(u & c).alias("tp"), F.count_if(u & ~c).alias("fp"), F.count_if(~u & c).alias("fn"), F.count_if(c).alias("right"))
    return n.select("tp", "fp", "fn", F.round(stats.share(F.col("tp"), F.col("tp") + F.col("fp")), 4).alias("prec"), F.round(stats.share(F.col("tp"), F.col("right")), 4).alias("recall"))


@query("eval_by_category", "SELECT model, list_sort(list(latency))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1] AS p95 FROM calls GROUP BY model")
def eval_by_category(spark, sf):
    """The element at round-half-even of share * (n - 1): counts of equal values are summed before the groups are put in order."""
    return stats.element_at_share(fx.calls(spark, sf), "model", "latency", 0.95).withColumnRenamed("value", "p95")


@query("detail_coverage", "SELECT scope_id, count(*) AS n, count(*) FILTER (contains(lower(text), 'the') OR contains(lower(text), 'der')) AS kept, count(*) FILTER (length(text) > 8000) AS over_budget FROM memories GROUP BY scope_id")
def detail_coverage(spark, sf):
    low = F.lower("text")
    return fx.memories(spark, sf).groupBy("scope_id").agg(F.count("*").alias("n"), F.count_if(F.contains(low, F.lit("the")) | F.contains(low, F.lit("der"))).alias("kept"), F.count_if(F.length("text") > 8000).alias("over_budget"))
