"""Judgments of a model as a table: validation, reranking, selection, vetoes, and modes; without a judgment the baseline stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions import text

MODES = ("off", "shadow", "verify", "rerank", "filter", "contribution")
HEAD, CONTRIBUTES, SAME = 30, 0.7, 0.9
REWRITES, REWRITE_CHARS = 3, 512


def unsound(kind: Column, value: Column, choice: Column, options: Column, probabilities: Column, confidence: Column) -> Column:
    """Why an answer cannot be used; null for a sound one.

    Kind ``noul`` has a value of 0 to 1; ``choice`` and ``score`` have a probability for each of ``options`` (array) that sum to one
    within the rounding of two decimals, and a confidence; a choice is the likeliest option, a score the mean of the options' places.
    """
    unit = lambda x: x.isNotNull() & ~F.isnan(x) & x.between(0, 1)
    keys = F.array_sort(F.map_keys(probabilities))
    p = F.map_values(probabilities)
    n = F.size(options)
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    spread = F.abs(total - 1) <= 0.005 * n + 1e-9
    mean = F.aggregate(F.map_entries(probabilities), F.lit(0.0), lambda s, e: s + (F.array_position(options, e["key"]) - 1) * e["value"])
    near = F.abs(value - mean) <= 0.005 * (n * (n - 1) / 2 + 1) + 1e-9
    shared = (
        F.when((keys != F.array_sort(options)) | keys.isNull(), "wrong_options").when(~F.forall(p, unit), "out_of_range").when(~spread, "invalid_distribution").when(~unit(confidence), "out_of_range")
    )
    likeliest = F.array_contains(options, choice) & (F.element_at(probabilities, choice) >= F.array_max(p))
    return (
        F.when(kind == "noul", F.when(~unit(value), "out_of_range"))
        .when(kind == "choice", F.coalesce(shared, F.when(~F.coalesce(likeliest, F.lit(False)), "invalid_choice")))
        .when(kind == "score", F.coalesce(shared, F.when(value.isNull() | F.isnan(value) | ~value.between(0, n - 1), "out_of_range").when(~near, "inconsistent_score")))
        .otherwise("wrong_type")
    )


def _complete(by: str, limit: int) -> Column:
    """Whether all rows of a list that are asked about have a judgment."""
    return F.count_if((F.col("rank") <= limit) & F.col("value").isNull()).over(Window.partitionBy(by)) == 0


def reranked(rows: DataFrame, by: str, floor: float | None = None, limit: int = HEAD) -> DataFrame:
    """by, id, rank: each list (by, id, rank, value) with its first ``limit`` rows in order of their judgments, ties as before.

    With a floor, rows below it and the rows that were not judged fall away.  A list with a judgment missing stays as it was.
    Lists hold a bounded number of rows.
    """
    r = rows.withColumns({"whole": _complete(by, limit), "head": F.col("rank") <= limit})
    if floor is not None:
        r = r.filter(~F.col("whole") | (F.col("head") & (F.col("value") >= floor)))
    order = Window.partitionBy(by).orderBy(F.when(F.col("whole"), (~F.col("head")).cast("int")).otherwise(0), F.when(F.col("whole") & F.col("head"), -F.col("value")).otherwise(0.0), "rank")
    return r.select(by, "id", F.row_number().over(order).alias("rank"))


def contributing(rows: DataFrame, by: str, floor: float = CONTRIBUTES, limit: int = HEAD) -> DataFrame:
    """by, id, rank: of each list's first ``limit`` rows those that contribute, the most first; all as before where a judgment is missing."""
    r = rows.withColumn("whole", _complete(by, limit)).filter(~F.col("whole") | ((F.col("rank") <= limit) & (F.col("value") >= floor)))
    order = Window.partitionBy(by).orderBy(F.when(F.col("whole"), -F.col("value")).otherwise(0.0), "rank")
    return r.select(by, "id", F.row_number().over(order).alias("rank"))


def vetoed(rows: DataFrame, floor: float = SAME) -> DataFrame:
    """The rows with ``vetoed``: whether a judgment says that the same has been stated; an outage keeps a new claim."""
    return rows.withColumn("vetoed", F.coalesce(F.col("value"), F.lit(0.0)) >= floor)


def in_mode(rows: DataFrame, mode: str, by: str, floor: float = 0.5) -> DataFrame:
    """by, id, rank under a mode: off and shadow leave lists as they are, verify drops rows judged under the floor, and so on."""
    if mode not in MODES:
        raise ValueError(f"a mode is one of {', '.join(MODES)}, not {mode!r}")
    if mode == "rerank":
        return reranked(rows, by)
    if mode == "filter":
        return reranked(rows, by, floor)
    if mode == "contribution":
        return contributing(rows, by)
    kept = rows.filter(F.col("value").isNull() | (F.col("value") >= floor)) if mode == "verify" else rows
    return kept.select(by, "id", F.row_number().over(Window.partitionBy(by).orderBy("rank")).alias("rank"))


def accepted_rewrites(rewrites: DataFrame, by: str) -> DataFrame:
    """by, nth, rewrite: of what was proposed for each query (by, place, query, rewrite) the first three that are usable and differ, case folded."""
    said = text.stripped(F.coalesce("rewrite", F.lit("")))
    r = rewrites.withColumns({"rewrite": said, "key": text.casefolded(said), "asked": text.casefolded(text.stripped(F.coalesce("query", F.lit(""))))})
    r = r.filter((F.col("rewrite") != "") & (F.length("rewrite") <= REWRITE_CHARS) & (F.col("key") != F.col("asked")))
    once = r.groupBy(by, "key").agg(F.min(F.struct("place", "rewrite")).alias("x"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy("x.place"))
    return once.withColumn("nth", nth).filter(F.col("nth") <= REWRITES).select(by, "nth", F.col("x.rewrite").alias("rewrite"))


def parsed_op(op: Column, target: Column, said: Column, kind: Column, tags: Column, evidence: Column) -> Column:
    """Why a proposed operation cannot be used; null for a sound one.  ``evidence`` is an array of message_id, start_char, end_char, quote."""
    name, words = F.upper(F.coalesce(op, F.lit(""))), text.stripped(F.coalesce(said, F.lit("")))
    writes = name.isin("ADD", "UPDATE")
    label = text.stripped(F.when(F.coalesce(kind, F.lit("")) == "", "fact").otherwise(kind))
    each = F.coalesce(tags, F.array().cast("array<string>"))
    bad_tag = F.exists(each, lambda t: (text.stripped(F.coalesce(t, F.lit(""))) == "") | (F.length(text.stripped(t)) > 64)) | (F.size(each) > 20)
    cited = F.coalesce(evidence, F.array().cast("array<struct<message_id:bigint,start_char:int,end_char:int,quote:string>>"))
    lost = lambda e: F.coalesce((e["message_id"] <= 0) | (((e["start_char"] < 0) | (e["end_char"] <= e["start_char"])) & (F.coalesce(e["quote"], F.lit("")) == "")), F.lit(True))
    return (
        F.when(~name.isin("ADD", "UPDATE", "DELETE"), "unknown_op").when(name.isin("UPDATE", "DELETE") & (F.coalesce(target, F.lit("")) == ""), "no_target").when(writes & (words == ""), "no_text")
        .when(writes & (F.length(words) > 200), "too_long").when((label == "") | (F.length(label) > 64), "invalid_kind").when(bad_tag, "invalid_tags").when(writes & (F.size(cited) == 0), "no_evidence").when(F.exists(cited, lost), "invalid_evidence")
    )


def reconciled(own: Column, session: Column) -> Column:
    """A claim's context (map) in the session's keys: a key that the session does not have takes the one key there that holds its value; null where that is none or several."""
    entries = F.map_entries(own)

    def key_of(e: Column) -> Column:
        named = F.map_keys(F.map_filter(session, lambda k, v: (v == e["value"]) & ~F.array_contains(F.map_keys(own), k)))
        same = F.element_at(session, e["key"]) == e["value"]
        return F.when(F.coalesce(same, F.lit(False)), e["key"]).when(F.size(named) == 1, F.get(named, F.lit(0)))

    found = F.transform(entries, lambda e: F.struct(key_of(e).alias("key"), e["value"].alias("value")))
    whole = F.forall(found, lambda e: e["key"].isNotNull())
    # of two keys that come to one, their values are equal
    distinct = F.array_distinct(F.filter(found, lambda e: e["key"].isNotNull()))
    return F.when(whole, F.map_from_entries(distinct))
