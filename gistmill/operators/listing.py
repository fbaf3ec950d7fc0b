"""Listings: facets that are given, sort orders that are known, and pages."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions import fulltext

#: Columns that a listing may be sorted by, and groups that a series may have; anything else is refused.
SORTS = ("updated_at", "created_at", "importance", "confidence", "document_date")
GROUPS = {"kind": "kind", "scope": "scope_id", "source_role": "source_role", "review_status": "review_status"}


class UnknownChoice(ValueError):
    """A sort order, group or facet outside those that are known."""


def listed(rows: DataFrame, facets: dict[str, Any]) -> DataFrame:
    """Rows that meet each facet that is given; a null facet asks nothing, status ``any`` neither.

    A query matches by its words' stems, all of them, or literally without regard to case; its wildcards are wildcards.
    """
    plain = ("kind", "source_role", "subject_id", "review_status")
    out = rows
    for name, value in facets.items():
        if value is None or (name, value) == ("status", "any"):
            continue
        if name in plain or name == "status":
            out = out.filter(F.col(name) == value)
        elif name == "scopes":
            out = out.filter(F.col("scope_id").isin(value))
        elif name == "tag":
            out = out.filter(F.array_contains("tags", value))
        elif name == "importance_min":
            out = out.filter(F.col("importance") >= F.lit(value).cast("float"))
        elif name == "created_from":
            out = out.filter(F.col("created_at") >= F.lit(value).cast("timestamp"))
        elif name == "created_to":
            out = out.filter(F.col("created_at") <= F.lit(value).cast("timestamp"))
        elif name == "query":
            out = out.filter(fulltext.holds_all(F.col("text"), value) | F.col("text").ilike(f"%{value}%"))
        else:
            raise UnknownChoice(name)
    return out


def page(rows: DataFrame, sort: str, limit: int, offset: int = 0, ascending: bool = False) -> DataFrame:
    """The rows of one page with ``nth``, their place in the whole listing; ties by id."""
    if sort not in SORTS:
        raise UnknownChoice(sort)
    order = [F.asc_nulls_last(sort) if ascending else F.desc_nulls_first(sort), F.asc("id")]
    top = rows.orderBy(*order).offset(offset).limit(limit)
    return top.withColumn("nth", F.row_number().over(Window.orderBy(*order)) + F.lit(offset))  # of at most ``limit`` rows


def group_column(name: str) -> Column:
    if name not in GROUPS:
        raise UnknownChoice(name)
    return F.col(GROUPS[name])


def policies(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """scope, kind, id, version, nth: for each scope the policies of the instance (without scope) and its own, the newest first."""
    everywhere = scopes.join(rows.filter("scope_id IS NULL"), F.lit(True))  # each holds for each scope
    own = scopes.join(rows, scopes["scope"] == rows["scope_id"])
    nth = F.row_number().over(Window.partitionBy("scope", "kind").orderBy(F.desc("version"), "id"))
    return everywhere.unionByName(own).withColumn("nth", nth).select("scope", "kind", "id", "version", "nth")


def entity_profiles(rows: DataFrame, most: int = 100) -> DataFrame:
    """entity, part, id, nth: the first claims in each scope, and about each person."""
    order = [F.desc("importance"), F.desc("updated_at"), "id"]
    nth = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    inside = rows.withColumn("nth", nth("scope_id")).filter(F.col("nth") <= most).select(F.col("scope_id").alias("entity"), F.lit("in_scope").alias("part"), "id", "nth")
    about = rows.filter("subject_id IS NOT NULL").withColumn("nth", nth("subject_id")).filter(F.col("nth") <= most)
    return inside.unionAll(about.select(F.concat(F.lit("user"), F.col("subject_id").cast("string")), F.lit("about"), "id", "nth"))


def _iso(column: str) -> Column:
    return F.coalesce(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")).alias(column)


def _context() -> Column:
    """The context as JSON, in order of its keys; an empty object for none."""
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("context")))), F.lit("{}")).alias("context")


def raw_payload(messages: DataFrame) -> DataFrame:
    """What an index holds of each message: ten fields."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return messages.select(
        plain("user_id").alias("user_id"), plain("scope_id").alias("scope_id"), plain("agent_id").alias("agent_id"), "session_id", "role", F.col("content").alias("text"), _context(), _iso("created_at"), F.col("id").alias("message_id"), "redacted",
    )


def payload(rows: DataFrame) -> DataFrame:
    """What an index holds of each memory: 22 fields as plain values, times to the second, and the digest of its text in the text's place."""
    number = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    return rows.select(
        "id", "scope_id", F.coalesce(F.col("subject_id").cast("string"), F.lit("")).alias("subject"), "author_id", "kind", number("importance"), number("confidence"), "status", "source_role", "review_status", F.array_join("tags", ",").alias("tags"),
        _iso("valid_until"), _iso("created_at"), _iso("updated_at"), "revision", _iso("document_date"), _iso("event_start"), _iso("event_end"), "is_static", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha"), F.coalesce("agent_id", F.lit("")).alias("agent_id"), _context(), "redacted",
    )
