"""Transcript lines as JSON: which are turns of a conversation, and why others are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_CHARS, LEAST_INDEXED = 20_000, 20
# Marks of lines that no person wrote, with the names under which they are counted, in order.
NOISE: list[tuple[str, str]] = [
    ("interrupt-marker", r"^\[Request interrupted"),
    ("slash-command", r"<command-(name|message|args)>"),
    ("custom-slash-command", r"^\s*<[a-zA-Z0-9_-]+-command>"),
    ("command-output", r"<local-command-(stdout|stderr)>"),
    ("bash-io", r"<bash-(input|stdout|stderr)>"),
    ("task-notification", r"<task-notification>"),
    ("system-reminder", r"^\s*<system-reminder>"),
    ("compaction-summary", r"^This session is being continued from"),
    ("agent-brief", r"^#\s*Peer brief"),
]
EXCLUDED_SOURCES = ("system",)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all JSONL files under a folder, as ``value``."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)


def body_text(content: Column) -> Column:
    """Text of a message body, a variant: a string, or the text blocks of a list."""
    blocks = F.try_variant_get(content, "$", "array<struct<type:string,text:string>>")
    joined = F.array_join(F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), lambda x: x != ""), "\n")
    plain = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))
    return F.regexp_replace(F.coalesce(plain, joined, F.lit("")), r"^\s+|\s+$", "")


def classified(lines: DataFrame, value: str = "value", keep: str | None = None) -> DataFrame:
    """reason, kept, and the fields of a turn for each line, with the column ``keep``; a line that is no JSON has reason ``bad-json``."""
    v = F.try_parse_json(F.col(value))
    own = [F.col(keep).alias("__keep")] if keep else []
    rows = lines.select(v.alias("v"), *own)
    get = lambda path, kind="string": F.try_variant_get("v", f"$.{path}", kind)
    content = get("message.content", "variant")
    blocks = F.try_variant_get(content, "$", "array<struct<type:string>>")
    text, kind, source = body_text(content), get("type"), get("promptSource")
    reason = F.when(F.col("v").isNull(), "bad-json")
    reason = reason.when(kind.isNull() | ~kind.isin("user", "assistant"), F.concat(F.lit("type:"), F.coalesce(kind, F.lit("None"))))
    reason = reason.when(F.coalesce(get("isSidechain", "boolean"), F.lit(False)), "sidechain").when(F.coalesce(get("isMeta", "boolean"), F.lit(False)), "meta")
    reason = reason.when(F.coalesce(F.exists(blocks, lambda b: b["type"] == "tool_result"), F.lit(False)), "tool_result")
    reason = reason.when(text == "", "no-text").when(F.length(text) > MOST_CHARS, "oversized-document")
    reason = reason.when((kind == "user") & source.isin(*EXCLUDED_SOURCES), F.concat(F.lit("source:"), source))
    for name, pattern in NOISE:
        reason = reason.when((kind == "user") & text.rlike(pattern), name)
    reason = reason.when((F.coalesce(get("uuid"), F.lit("")) == "") | (F.coalesce(get("sessionId"), F.lit("")) == ""), "missing-ids")
    out = rows.select(
        *(["__keep"] if keep else []), reason.alias("refused"), kind.alias("role"), text.alias("text"), source.alias("source"), get("uuid").alias("external_id"), get("sessionId").alias("session_id"), get("timestamp").alias("created_at"),
        F.element_at(F.split(get("cwd"), "/"), -1).alias("project"), get("gitBranch").alias("git_branch"),
    )
    kept = F.col("refused").isNull()
    label = F.when(F.col("role") == "user", F.concat(F.lit("user:"), F.coalesce("source", F.lit("n/a")))).otherwise("assistant")
    indexed = (F.col("role") == "user") & (F.length("text") >= LEAST_INDEXED)
    return out.select(*([F.col("__keep").alias(keep)] if keep else []), F.coalesce("refused", label).alias("reason"), kept.alias("kept"), "role", "text", "external_id", "session_id", "created_at", "project", "git_branch", (kept & indexed).alias("indexed"))


def in_time(rows: DataFrame) -> DataFrame:
    """Turns that are kept, in order of when they were said and their names: a sort by ranges."""
    return rows.filter("kept").orderBy("created_at", "external_id")


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kept", "reason").agg(F.count("*").alias("n"))
