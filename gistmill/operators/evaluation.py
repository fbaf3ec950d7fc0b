"""Measures of retrieval and extraction, over tables of cases, results and expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.operators.stats import nearest_rank, share


def hybrid_metrics(cases: DataFrame, results: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: top-1, relevant rows retained, abstentions, irrelevant rows.  ``cases`` has q, ``results`` q, id and rank, ``expected`` q and id."""
    right = results.join(expected.select("q", "id", F.lit(True).alias("right")), ["q", "id"], "left")
    got = right.groupBy("q").agg(F.count("*").alias("n"), F.count("right").alias("right"), F.max_by("right", -F.col("rank")).alias("first"))
    wanted = expected.groupBy("q").agg(F.count("*").alias("wanted"))
    c = cases.join(got, "q", "left").join(wanted, "q", "left").na.fill(0, ["n", "right", "wanted"])
    answerable = F.col("wanted") > 0
    return c.agg(
        F.count("*").alias("queries"), F.count_if(answerable).alias("answerable"), F.count_if(answerable & F.coalesce("first", F.lit(False))).alias("top1_correct"), F.sum("right").alias("relevant_retained"), F.sum("wanted").alias("relevant_total"),
        F.count_if(~answerable).alias("unanswerable"), F.count_if(~answerable & (F.col("n") == 0)).alias("correct_abstentions"), F.sum(F.col("n") - F.col("right")).alias("irrelevant_returned"),
    )


def ranking_metrics(scores: DataFrame, floor: float) -> DataFrame:
    """One row: top-1 and mean reciprocal rank by score, and what a floor keeps.  ``scores`` has q, place, score and expected (boolean)."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "place"))
    s = scores.withColumns({"rank": rank, "kept": F.col("score") >= floor})
    c = s.groupBy("q").agg(F.count_if("expected").alias("wanted"), F.min(F.when(F.col("expected"), F.col("rank"))).alias("first"), F.count_if("kept").alias("kept"), F.count_if(F.col("kept") & F.col("expected")).alias("right"))
    answerable = F.col("wanted") > 0
    return c.agg(
        F.count("*").alias("n"), F.count_if(answerable).alias("answerable"), F.round(F.avg(F.when(answerable, (F.col("first") == 1).cast("int"))), 4).alias("top1"), F.round(F.avg(1 / F.col("first")), 4).alias("mrr"),
        F.count_if(~answerable & (F.col("kept") == 0)).alias("correct_abstentions"), F.count_if(answerable & (F.col("kept") == 0)).alias("false_empty"), F.sum(F.when(answerable, F.col("right"))).alias("relevant_retained"), F.sum("wanted").alias("relevant_total"),
    )


def context_metrics(cases: DataFrame, results: DataFrame, relevant: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: details retained, whole contexts, irrelevant and redundant items, right abstentions.

    ``results`` has q, id, pos and facets (array), ``relevant`` q and id, ``wanted`` q and facet.  An item is redundant if it has facets, and items before it hold all of them.
    """
    each = results.select("q", "id", "pos", F.explode("facets").alias("facet"))
    first = F.min("pos").over(Window.partitionBy("q", "facet"))
    stale = each.withColumn("first", first).groupBy("q", "id", "pos").agg(F.bool_and(F.col("first") < F.col("pos")).alias("stale")).groupBy("q").agg(F.count_if("stale").alias("redundant"))
    held = each.select("q", "facet").distinct()
    covered = wanted.distinct().join(held.withColumn("held", F.lit(True)), ["q", "facet"], "left").groupBy("q").agg(F.count("*").alias("expected"), F.count("held").alias("covered"))
    right = results.join(relevant.select("q", "id", F.lit(True).alias("right")), ["q", "id"], "left").groupBy("q").agg(F.count("*").alias("n"), F.count_if(F.col("right").isNull()).alias("irrelevant"))
    c = cases.join(covered, "q", "left").join(stale, "q", "left").join(right, "q", "left").na.fill(0)
    none = F.col("expected") == 0
    return c.agg(
        F.count("*").alias("queries"), F.sum("covered").alias("details_retained"), F.sum("expected").alias("details_expected"), F.count_if(~none & (F.col("covered") == F.col("expected"))).alias("complete"), F.sum("irrelevant").alias("irrelevant"),
        F.sum("redundant").alias("redundant"), F.count_if(none & (F.col("n") == 0)).alias("correct_empty"), F.count_if(none).alias("unanswerable"),
    )


def extraction_metrics(cases: DataFrame, found: DataFrame) -> DataFrame:
    """One row: recall of expected claims, false ones, leaks, and citations that do not hold.

    ``cases`` has q, pattern and forbidden (boolean): a claim that matches a forbidden pattern is a leak; ``found`` q, text, cited (boolean).
    """
    j = cases.join(found, "q", "left").withColumn("hit", F.coalesce(F.regexp_like("text", F.col("pattern")), F.lit(False)))
    of = j.groupBy("q", "pattern", "forbidden").agg(F.bool_or("hit").alias("hit"))
    per = of.agg(F.count_if(~F.col("forbidden")).alias("expected"), F.count_if(~F.col("forbidden") & F.col("hit")).alias("recalled"), F.count_if(F.col("forbidden") & F.col("hit")).alias("leaks"))
    good = j.filter("hit AND NOT forbidden").select("q", "text").distinct().withColumn("good", F.lit(True))
    extra = found.join(good, ["q", "text"], "left").agg(F.count_if(F.col("good").isNull()).alias("false_positives"), F.count_if(~F.col("cited")).alias("fabricated"))
    return per.crossJoin(extra).select("*", F.round(share(F.col("recalled"), F.col("expected")), 4).alias("recall"))  # two single rows


def readiness(rows: DataFrame, by: str) -> DataFrame:
    """by, n, kept details, irrelevant items, right abstentions, budget violations, p50 and p95 by nearest rank; see the columns that it reads."""
    empty = F.col("wanted") == 0
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.sum("kept").alias("kept"), F.sum("irrelevant").alias("irrelevant"), F.count_if(empty & (F.col("returned") == 0)).alias("abstained"), F.count_if(F.col("used") > F.col("budget")).alias("over_budget"),
        nearest_rank("latency", 0.5).alias("p50"), nearest_rank("latency", 0.95).alias("p95"),
    )


def as_text(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda e: e.cast("string")), ",")
