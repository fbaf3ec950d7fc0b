"""The relations of a conversational memory, projected from the driver's tables.

Every projection is deterministic, and ``SQL`` holds the same one for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clock of all queries.
NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(x):
    return F.lpad(x.cast("string"), 8, "0")


def _ago(days):
    return now() - F.make_dt_interval(days.cast("int"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.col("doc_id")
    said = _ago(n % 700)
    event = F.when(n % 6 == 2, said - F.expr("INTERVAL 30 DAYS"))
    return d.select(
        n.alias("no"),
        _id(n).alias("id"),
        F.col("source").alias("scope_id"),
        F.when(n % 4 == 0, n % 150).alias("subject_id"),
        (n % 100 + 1).alias("author_id"),
        F.when(n % 3 == 0, "preference").when(n % 3 == 1, "fact").otherwise("episode").alias("kind"),
        "text",
        ((n % 11) / 10.0).cast("float").alias("importance"),
        (F.lit(0.5) + (n % 6) / 10.0).cast("float").alias("confidence"),
        F.when((n % 13 == 0) & (n > 0), "archived").when((n % 17 == 0) & (n > 0), "superseded").otherwise("active").alias("status"),
        F.when(F.col("toxic") == 1, "assistant").when(n % 19 == 7, "inference").otherwise("user").alias("source_role"),
        F.when(F.col("quality") == 1, "confirmed").when(F.col("quality") == 0, "declined").otherwise("pending").alias("review_status"),
        _ago(n % 400).alias("updated_at"),
        _ago(n % 400 + 10).alias("created_at"),
        said.alias("document_date"),
        event.alias("event_start"),
        (event + F.expr("INTERVAL 2 DAYS")).alias("event_end"),
        F.when(n % 5 == 1, now() + F.make_dt_interval((n % 30 - 10).cast("int"))).alias("valid_until"),
        (n % 29 == 3).alias("is_static"),
        (1 + n % 8).alias("source_count"),
        "lang",
        (1 + n % 3).alias("revision"),
        (F.col("n_chars") > 2000).alias("legacy_imported"),
        F.array("lang", "source").alias("tags"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("no"), _id(F.col("vec_id")).alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), c.cast("int"), t.cast("int"))
    return table(spark, sf_dir, "conversations").select(
        (c * 1000 + t).alias("id"), c.alias("session_id"), (c % 150).alias("user_id"), "role", F.col("text").alias("content"), at.alias("created_at"), F.concat(F.lit("src"), (c % 20).cast("string")).alias("scope_id"), t.alias("turn")
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(n)
    edge = lambda back, kind: (_id(n).alias("from_id"), _id(n - back).alias("to_id"), F.lit(kind).alias("relation"))
    return (
        d.filter((n % 17 == 3) & (n >= 20)).select(*edge(20, "updates"))
        .unionAll(d.filter((n % 7 == 5) & (n >= 20)).select(*edge(20, "extends")))
        .unionAll(d.filter((n % 31 == 1)).select(*edge(1, "extends")))
    )


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).select("no", "id", "text", "status", "revision", "updated_at", "valid_until")
    r = m.withColumn("r", F.explode(F.sequence(F.lit(1), F.col("revision").cast("int"))))
    return r.select(
        F.col("id").alias("memory_id"), F.col("r").alias("revision"),
        F.when(F.col("r") == F.col("revision"), F.col("text")).otherwise(F.substr("text", F.lit(1), F.col("r") * 40)).alias("text"),
        F.when(F.col("r") == F.col("revision"), F.col("status")).otherwise("active").alias("status"),
        (F.col("updated_at") - F.make_dt_interval((F.col("revision") - F.col("r")).cast("int"))).alias("at"),
        (F.col("valid_until") - F.make_dt_interval((F.col("revision") - F.col("r")).cast("int"))).alias("valid_until"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each memory cites the first characters of one message; every 23rd digest is broken."""
    m, n = table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id")
    msg = messages(spark, sf_dir).select("id", "content", "session_id", "turn")
    cited = m.join(msg, (n % 100 == F.col("session_id")) & (F.col("turn") == n % 3))
    end = F.least(F.lit(20), F.length("content"))
    digest = F.when(n % 23 == 0, F.lit("broken")).otherwise(F.sha2(F.substr("content", F.lit(1), end).cast("binary"), 256))
    return cited.select(_id(n).alias("memory_id"), F.col("id").alias("message_id"), F.lit(0).alias("start_char"), end.alias("end_char"), digest.alias("sha"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = table(spark, sf_dir, "documents").select(F.col("source").alias("id")).distinct()
    no = F.regexp_replace("id", "src", "").cast("int")
    scopes = scopes.select("id", F.when(F.col("id") == "src0", "team").otherwise("project").alias("kind"), F.when(no % 5 == 0, "team").otherwise("private").alias("visibility"), (no == 19).alias("archived"))
    users = table(spark, sf_dir, "customer").select(F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("id"), F.lit("user").alias("kind"), F.lit("private").alias("visibility"), F.lit(False).alias("archived"))
    return scopes.unionAll(users)


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey")
    part = lambda shift, role: c.select(F.concat(F.lit("src"), ((k + shift) % 20).cast("string")).alias("entity_id"), k.alias("user_id"), F.lit(role).alias("role"))
    return part(0, "member").unionAll(part(1, "viewer")).unionAll(c.filter(k <= 20).select(F.concat(F.lit("src"), ((k + 7) % 20).cast("string")).alias("entity_id"), k.alias("user_id"), F.lit("owner").alias("role")))


def _k():
    return F.get_json_object("props", "$.k").cast("bigint")


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "user_id", F.col("ts").cast("timestamp").alias("created_at"), F.col("value").alias("total_ms"), (F.col("event_type") == "error").alias("abstained"), _k().alias("used_tokens"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "purchase"))
    n = F.col("event_id")
    return e.select(n.alias("run_id"), _id(n % 1000).alias("memory_id"), (F.col("event_type") == "purchase").alias("useful"), F.when(n % 3 != 0, n % 2 == 0).alias("correct"), F.col("ts").cast("timestamp").alias("created_at"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    model = F.when(n % 3 == 0, "small").when(n % 3 == 1, "medium").otherwise("large")
    kind = F.when(n % 2 == 0, "extract").otherwise("merge")
    return e.select(n.alias("id"), "user_id", model.alias("model"), kind.alias("kind"), F.when(F.col("event_type") == "error", "failed").alias("error"), (_k() * 30).alias("tokens_in"), _k().alias("tokens_out"), (F.col("value") / 10000).cast("decimal(12,6)").alias("cost"), F.col("value").alias("latency"), F.col("ts").cast("timestamp").alias("created_at"))


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    status = F.when(n % 4 == 0, "pending").when(n % 4 == 1, "done").when(n % 4 == 2, "failed").otherwise("claimed")
    return e.select(n.alias("id"), F.when(n % 5 == 0, "raw").otherwise("memories").alias("collection"), F.col("user_id").alias("entity_id"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("operation"), status.alias("status"), (n % 10).alias("attempts"), F.col("ts").cast("timestamp").alias("created_at"))


# The same projections for DuckDB.
_NOW = f"TIMESTAMP '{NOW}'"
SQL: dict[str, str] = {
    "memories": f"""SELECT d.doc_id AS no, lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS id, source AS scope_id, CASE WHEN d.doc_id % 4 = 0 THEN d.doc_id % 150 END AS subject_id,
 d.doc_id % 100 + 1 AS author_id, CASE d.doc_id % 3 WHEN 0 THEN 'preference' WHEN 1 THEN 'fact' ELSE 'episode' END AS kind, text,
 CAST((d.doc_id % 11) / 10.0 AS FLOAT) AS importance, CAST(0.5 + (d.doc_id % 6) / 10.0 AS FLOAT) AS confidence,
 CASE WHEN d.doc_id % 13 = 0 AND d.doc_id > 0 THEN 'archived' WHEN d.doc_id % 17 = 0 AND d.doc_id > 0 THEN 'superseded' ELSE 'active' END AS status,
 CASE WHEN toxic = 1 THEN 'assistant' WHEN d.doc_id % 19 = 7 THEN 'inference' ELSE 'user' END AS source_role,
 CASE WHEN quality = 1 THEN 'confirmed' WHEN quality = 0 THEN 'declined' ELSE 'pending' END AS review_status,
 {_NOW} - to_days(CAST(d.doc_id % 400 AS INTEGER)) AS updated_at, {_NOW} - to_days(CAST(d.doc_id % 400 + 10 AS INTEGER)) AS created_at,
 {_NOW} - to_days(CAST(d.doc_id % 700 AS INTEGER)) AS document_date,
 CASE WHEN d.doc_id % 6 = 2 THEN {_NOW} - to_days(CAST(d.doc_id % 700 + 30 AS INTEGER)) END AS event_start,
 CASE WHEN d.doc_id % 6 = 2 THEN {_NOW} - to_days(CAST(d.doc_id % 700 + 28 AS INTEGER)) END AS event_end,
 CASE WHEN d.doc_id % 5 = 1 THEN {_NOW} + to_days(CAST(d.doc_id % 30 - 10 AS INTEGER)) END AS valid_until,
 d.doc_id % 29 = 3 AS is_static, 1 + d.doc_id % 8 AS source_count, lang, 1 + d.doc_id % 3 AS revision, n_chars > 2000 AS legacy_imported, [lang, source] AS tags
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "vectors": "SELECT vec_id AS no, lpad(CAST(vec_id AS VARCHAR), 8, '0') AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings",
    "messages": "SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, conv_id % 150 AS user_id, role, text AS content, TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS created_at, 'src' || CAST(conv_id % 20 AS VARCHAR) AS scope_id, turn FROM conversations",
    "relations": """SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS from_id, lpad(CAST(doc_id - 20 AS VARCHAR), 8, '0') AS to_id, 'updates' AS relation FROM documents WHERE doc_id % 17 = 3 AND doc_id >= 20
 UNION ALL SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0'), lpad(CAST(doc_id - 20 AS VARCHAR), 8, '0'), 'extends' FROM documents WHERE doc_id % 7 = 5 AND doc_id >= 20
 UNION ALL SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0'), lpad(CAST(doc_id - 1 AS VARCHAR), 8, '0'), 'extends' FROM documents WHERE doc_id % 31 = 1""",
    "revisions": """SELECT m.id AS memory_id, CAST(r AS INTEGER) AS revision, CASE WHEN r = m.revision THEN text ELSE substr(text, 1, CAST(r * 40 AS INTEGER)) END AS text, CASE WHEN r = m.revision THEN status ELSE 'active' END AS status,
 updated_at - to_days(CAST(m.revision - r AS INTEGER)) AS at, valid_until - to_days(CAST(m.revision - r AS INTEGER)) AS valid_until FROM (SELECT *, unnest(generate_series(1, revision)) AS r FROM memories) m""",
    "evidence": """SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS memory_id, g.id AS message_id, 0 AS start_char, CAST(least(20, length(content)) AS INTEGER) AS end_char,
 CASE WHEN doc_id % 23 = 0 THEN 'broken' ELSE sha256(substr(content, 1, least(20, length(content)))) END AS sha FROM documents d JOIN messages g ON d.doc_id % 100 = g.session_id AND g.turn = d.doc_id % 3""",
    "entities": """SELECT source AS id, CASE WHEN source = 'src0' THEN 'team' ELSE 'project' END AS kind, CASE WHEN CAST(replace(source, 'src', '') AS INTEGER) % 5 = 0 THEN 'team' ELSE 'private' END AS visibility, source = 'src19' AS archived FROM (SELECT DISTINCT source FROM documents)
 UNION ALL SELECT 'user' || CAST(c_custkey AS VARCHAR), 'user', 'private', false FROM customer""",
    "memberships": """SELECT 'src' || CAST(c_custkey % 20 AS VARCHAR) AS entity_id, c_custkey AS user_id, 'member' AS role FROM customer UNION ALL SELECT 'src' || CAST((c_custkey + 1) % 20 AS VARCHAR), c_custkey, 'viewer' FROM customer
 UNION ALL SELECT 'src' || CAST((c_custkey + 7) % 20 AS VARCHAR), c_custkey, 'owner' FROM customer WHERE c_custkey <= 20""",
    "searches": "SELECT event_id AS id, user_id, ts AS created_at, value AS total_ms, event_type = 'error' AS abstained, CAST(json_extract_string(props, '$.k') AS BIGINT) AS used_tokens FROM events",
    "feedback": "SELECT event_id AS run_id, lpad(CAST(event_id % 1000 AS VARCHAR), 8, '0') AS memory_id, event_type = 'purchase' AS useful, CASE WHEN event_id % 3 <> 0 THEN event_id % 2 = 0 END AS correct, ts AS created_at FROM events WHERE event_type IN ('click', 'purchase')",
    "calls": "SELECT event_id AS id, user_id, CASE event_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS model, CASE WHEN event_id % 2 = 0 THEN 'extract' ELSE 'merge' END AS kind, CASE WHEN event_type = 'error' THEN 'failed' END AS error, CAST(json_extract_string(props, '$.k') AS BIGINT) * 30 AS tokens_in, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_out, CAST(value / 10000 AS DECIMAL(12,6)) AS cost, value AS latency, ts AS created_at FROM events",
    "outbox": "SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'raw' ELSE 'memories' END AS collection, user_id AS entity_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS operation, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'done' WHEN 2 THEN 'failed' ELSE 'claimed' END AS status, event_id % 10 AS attempts, ts AS created_at FROM events",
}
_NEEDS = {"revisions": ["memories"], "evidence": ["messages"]}


def oracle(sql: str) -> str:
    """DuckDB SQL with the projections that it names put before it."""
    import re

    used: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in used:
            used.append(name)

    for name in SQL:
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
            add(name)
    head = ", ".join(f"{name} AS ({SQL[name]})" for name in used)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = re.sub(r"(?i)^WITH\s+(RECURSIVE\s+)?", "", body)
        return f"WITH {'RECURSIVE ' * recursive}{head}{', ' * bool(head)}{body}"
    return f"WITH {head} {body}" if head else body
