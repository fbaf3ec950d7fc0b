"""Merges of clusters that a model has confirmed: which are carried out, and the tables that they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.functions import text
from gistmill.lineage import written
from gistmill.operators import curation

#: Characters of a merged text; fixed value.
LONGEST = 200
#: Why a merge is not carried out; fixed values.
INACTIVE, CHANGED, BEYOND, NOTHING, TOO_LONG = "members_no_longer_active", "members_changed", "merge_cap", "null_merge", "merged_text_too_long"


def verdicts(groups: DataFrame, rows: DataFrame, answers: DataFrame, now: Column, cap: int) -> DataFrame:
    """cluster, reason (null: merged), text, importance for each cluster of ``groups`` (cluster, id, revision as planned).

    Members must still be there, active, of the planned revisions and of one identity; then the model's answer (cluster, text, importance, error) counts.  No more than ``cap``
    clusters are asked about, the least names first.
    """
    first = groups.select("cluster").distinct().orderBy("cluster").limit(cap).withColumn("asked", F.lit(True))
    held = rows.filter(F.col("status") == "active").withColumn("identity", curation.identity()).select("id", F.col("revision").alias("now"), "identity")
    g = groups.join(held, "id", "left").groupBy("cluster").agg(
        F.count("*").alias("planned"), F.count("now").alias("left"), F.count_distinct("identity").alias("identities"), F.count_if(F.col("now") != F.col("revision")).alias("moved"),
    )
    said = text.stripped(F.coalesce("text", F.lit("")))
    a = g.join(answers.select("cluster", said.alias("text"), F.col("importance").cast("double").alias("importance"), "error"), "cluster", "left").join(first, "cluster", "left")
    reason = (
        F.when(F.col("asked").isNull(), BEYOND).when(F.col("left") < 2, INACTIVE).when((F.col("left") != F.col("planned")) | (F.col("identities") != 1) | (F.col("moved") > 0), CHANGED)
        .when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce(F.col("text"), F.lit("")) == "", NOTHING).when(F.length("text") > LONGEST, TOO_LONG)
    )
    return a.select("cluster", reason.alias("reason"), "text", "importance")


def applied(rows: DataFrame, groups: DataFrame, told: DataFrame, evidence: DataFrame, messages: DataFrame) -> dict[str, DataFrame]:
    """The next memories (id, text, importance, confidence, document_date, is_static, source_role, source_count, status, review_status, revision, superseded_by) and evidence.

    A merged claim stands for its members: it was said when the first of them was, is as sure as the least sure, no better sourced than the worst, static if one is, and up for review;
    its identity is theirs, and its name that of the cluster with ``merged-`` before it.  It inherits their citations, and counts the sessions that these lie in.  Members stay as history.
    """
    told = written(told.filter("reason IS NULL").withColumn("survivor", F.concat(F.lit("merged-"), "cluster")))
    members = written(groups.select("cluster", "id").join(told.select("cluster", "survivor"), "cluster"))
    of = rows.join(members, "id")
    share = of.groupBy("cluster").agg(
        F.min("confidence").alias("confidence"), F.min("document_date").alias("document_date"), F.bool_or("is_static").alias("is_static"), curation.first_of(F.collect_set("source_role"), curation.WEAKEST_FIRST).alias("source_role"), F.max("importance").alias("most"),
    )
    inherited = evidence.join(members.select(F.col("id").alias("memory_id"), "survivor"), "memory_id").drop("memory_id").withColumnRenamed("survivor", "memory_id").select(*evidence.columns).distinct()
    sessions = inherited.join(messages.select(F.col("id").alias("message_id"), "session_id"), "message_id").groupBy(F.col("memory_id").alias("survivor")).agg(F.count_distinct("session_id").alias("n"))
    born = told.join(share, "cluster").join(sessions, "survivor", "left").select(
        F.col("survivor").alias("id"), "text", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "importance")), F.col("most").cast("double")).alias("importance"), "confidence", "document_date", "is_static", "source_role",
        F.greatest(F.lit(1), F.coalesce("n", F.lit(0))).cast("int").alias("source_count"), F.lit("active").alias("status"), F.lit("pending").alias("review_status"), F.lit(1).cast("long").alias("revision"), F.lit(None).cast("string").alias("superseded_by"),
    )
    j = rows.join(members.select("id", "survivor"), "id", "left")
    merged = F.col("survivor").isNotNull()
    old = j.select(
        "id", "text", F.col("importance").cast("double").alias("importance"), "confidence", "document_date", "is_static", "source_role", F.col("source_count").cast("int").alias("source_count"),
        F.when(merged, "superseded").otherwise(F.col("status")).alias("status"), "review_status", (F.col("revision") + merged.cast("int")).cast("long").alias("revision"), F.col("survivor").alias("superseded_by"),
    )
    return {"memories": old.unionByName(born), "evidence": evidence.unionByName(inherited)}
