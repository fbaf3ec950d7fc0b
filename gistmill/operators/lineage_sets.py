"""Sets of rows that belong together: citations and their revisions, exports, parity of an index, erasures to repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.functions import text
from gistmill.operators import writes


def evidence_links(evidence: DataFrame, messages: DataFrame, memories: DataFrame, revisions: DataFrame) -> DataFrame:
    """memory_id, message_id, revisions (in order), current, whole: each citation with what it supports, and whether its span still is what was cited."""
    held = writes.revision_evidence(revisions, evidence).groupBy("memory_id", "message_id").agg(F.sort_array(F.collect_set("revision")).alias("r"))
    said = messages.select(F.col("id").alias("message_id"), "content")
    now = memories.select(F.col("id").alias("memory_id"), F.col("revision").alias("now"))
    e = evidence.join(said, "message_id").join(now, "memory_id").join(held, ["memory_id", "message_id"], "left")
    listed = F.coalesce(F.array_join(F.transform("r", lambda x: x.cast("string")), ","), F.lit(""))
    current = F.coalesce(F.array_contains("r", F.col("now").cast("int")), F.lit(False))
    return e.select("memory_id", "message_id", listed.alias("revisions"), current.alias("current"), text.span_holds(F.col("content"), F.col("start_char"), F.col("end_char"), F.col("sha")).alias("whole"))


#: Columns that an export never holds; fixed values.
SECRETS = ("password_hash", "key_hash")


def export(tables: dict[str, DataFrame], user_id: int, own_scope: str, own_entity: str) -> dict[str, DataFrame]:
    """The seventeen parts of one user's export, from tables of one version.

    What they are and may use, without secrets; what they said; claims in their own scope and those they made elsewhere, with history, sources and
    citations; edges with both ends among these; what awaits them; their searches with what was said of these, what was said of their claims; and model calls.
    """
    of = lambda name: tables[name].filter(F.col("user_id") == user_id)
    public = lambda rows: rows.drop(*SECRETS)
    memories = tables["memories"].filter((F.col("scope_id") == own_scope) | (F.col("author_id") == user_id))
    ids, runs, said = memories.select(F.col("id").alias("memory_id")), of("runs"), of("messages")
    about = lambda rows: rows.join(ids, "memory_id", "left_semi")
    ends = lambda e, end: e.join(memories.select(F.col("id").alias(end)), end, "left_semi")
    return {
        "user": public(of("users")), "api_keys": public(of("api_keys")), "entities": tables["entities"].filter(F.col("id") == own_entity), "memberships": of("memberships"), "sessions": said.select("session_id").distinct(), "messages": said,
        "memories": memories, "revisions": about(tables["revisions"]), "sources": about(tables["sources"]), "evidence": about(tables["evidence"]), "revision_evidence": writes.revision_evidence(about(tables["revisions"]), about(tables["evidence"])),
        "relations": ends(ends(tables["relations"], "from_id"), "to_id"), "attention": of("attention"), "runs": runs, "run_feedback": tables["feedback"].join(runs.select(F.col("id").alias("run_id")), "run_id", "left_semi"),
        "feedback": about(tables["feedback"]), "calls": of("calls"),
    }


def export_to(parts: dict[str, DataFrame], path: str) -> None:
    """Each part as JSON lines in a folder of its own."""
    for name, rows in parts.items():
        rows.write.mode("errorifexists").json(f"{path}/{name}")


def parity(wanted: DataFrame, held: DataFrame, key: str = "id") -> DataFrame:
    """side, key: rows that an index lacks, holds without reason, or holds with other contents."""
    rest = [c for c in wanted.columns if c != key]
    a, b = wanted.select(key, F.struct(*rest).alias("a")), held.select(key, F.struct(*rest).alias("b"))
    j = a.join(b, key, "full")
    side = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "orphan").when(~F.col("a").eqNullSafe(F.col("b")), "stale")
    return j.select(side.alias("side"), key).filter("side IS NOT NULL")


def replayed(receipts: DataFrame, users: DataFrame, memories: DataFrame) -> DataFrame:
    """user_id, elsewhere, blocked: erasures of users who are still there, with the claims that they made of others."""
    written = memories.filter(F.col("subject_id").isNotNull() & (F.col("subject_id") != F.col("author_id"))).groupBy(F.col("author_id").alias("user_id")).agg(F.count("*").alias("elsewhere"))
    r = receipts.join(users, "user_id", "left_semi").join(written, "user_id", "left").na.fill(0, ["elsewhere"])
    return r.select("user_id", "elsewhere", (F.col("elsewhere") > 0).alias("blocked"))


def copied(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """name, source, target, whole: row counts of an import's tables on both sides."""
    out = None
    for name, rows in source.items():
        n = rows.agg(F.lit(name).alias("name"), F.count("*").alias("source")).crossJoin(target[name].agg(F.count("*").alias("target")))  # two single rows
        out = n if out is None else out.unionAll(n)
    return out.withColumn("whole", F.col("source") == F.col("target"))
