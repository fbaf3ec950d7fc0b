"""Hybrid retrieval: three arms, one floor, one score, and a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions import fulltext, scores, text
from gistmill.functions.scores import Policy
from gistmill.lineage import written
from gistmill.operators import filters


def measured(rows: DataFrame, query: str, vector: Column) -> DataFrame:
    """The rows with what the three arms rank by: ``near`` (null without a vector), ``covers``, the cover density of the query's terms, and ``named``.

    ``named`` tells whether a row holds an identifier of the query literally.  Rows that carry ``covers``, as read from stored postings, are not stemmed again.
    """
    terms = fulltext.asked(query)
    names = F.transform(text.identifiers(F.lit(query)), F.lower)
    covers = F.col("covers") if "covers" in rows.columns else fulltext.cover_density(fulltext.positions(F.col("text"), fulltext.wanted(terms)), terms) if terms else F.lit(0.0)
    return rows.withColumns(
        {
            "near": F.when(F.col("v").isNotNull(), scores.dot(F.col("v"), vector)),
            "covers": F.coalesce(covers, F.lit(0.0)),
            "named": F.exists(names, lambda x: F.contains(F.lower("text"), x)),
            "cost": text.token_count(F.col("text")),
        }
    )


def dense_arm(rows: DataFrame, limit: int) -> DataFrame:
    """id, dense: the rows nearest to the vector; rows without a vector take no part."""
    return rows.filter("near IS NOT NULL").orderBy(F.desc("near"), "id").limit(limit).select("id", F.greatest("near", F.lit(0.0)).alias("dense"))


def lexical_arm(rows: DataFrame, limit: int) -> DataFrame:
    """id, lexical: rows that hold what a query asks for, whatever the words' forms, by cover density over the best."""
    top = rows.filter("covers > 0").orderBy(F.desc("covers"), "id").limit(limit)
    return top.select("id", (F.col("covers") / F.max("covers").over(Window.partitionBy())).alias("lexical"))


def entity_arm(rows: DataFrame, limit: int) -> DataFrame:
    """id, entity: rows that hold an identifier of the query literally."""
    return rows.filter("named").orderBy(F.desc("updated_at"), "id").limit(limit).select("id", F.lit(1.0).alias("entity"))


#: What scoring reads of a memory; texts and vectors stay where they are.
_SCORED = ["id", "scope_id", "kind", "importance", "updated_at", "event_start", "event_end", "document_date", "valid_until", "status", "source_role", "review_status", "source_count"]


def search(rows: DataFrame, query: str, vector: Column, policy: Policy, now: Column, scopes: list[str], limit: int = 30, expression: dict | None = None, order: str | None = None, window: tuple[Column, Column] | None = None, reranker=None) -> DataFrame:
    """id, rank, score and its parts.  ``rows`` holds memories with their vectors ``v``.

    Texts and vectors are read once; what the arms rank by and scoring needs is written without them, and all that follows reads this.
    Guards come before the floor, and the floor before importance, recency and the other boosts, so that
    a search without relevant rows stays empty.  ``reranker`` is any function from such rows to rows with other ranks and scores.
    """
    readable = filters.matching(rows.filter(F.col("scope_id").isin(scopes) & (F.col("status") == "active")), expression)
    slim = written(measured(readable, query, vector).select(*_SCORED, "near", "covers", "named", "cost"))
    most = max(50, 3 * limit)
    arms = [dense_arm(slim, most), lexical_arm(slim, most), entity_arm(slim, most)]
    merged = arms[0]
    for arm in arms[1:]:
        merged = merged.unionByName(arm, allowMissingColumns=True)
    merged = merged.groupBy("id").agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("dense", "lexical", "entity")])
    # the arms give 3 * max(50, 3 * limit) candidates at most
    kept = slim.join(F.broadcast(merged), "id").filter(filters.live(now) & F.col("source_role").isin(*policy.trusted))
    kept = kept.withColumn("relevance", scores.relevance(policy, F.col("dense"), F.col("lexical"), F.col("entity"))).filter(F.col("relevance") >= policy.floor)
    recent = scores.recency(policy, now, F.col("kind"), F.col("importance"), F.col("updated_at"), F.col("event_start"), F.col("event_end"), F.col("document_date"))
    boost = F.when(filters.in_range(*window), policy.temporal).otherwise(0.0) if window else F.lit(0.0)
    unconfirmed = (F.col("source_role") == "inference") & (F.col("review_status") != "confirmed")
    score = (
        F.col("relevance") + policy.importance * F.col("importance").cast("double") + policy.recency * recent
        + policy.reinforcement * scores.reinforcement(F.col("source_count")) + boost - F.when(unconfirmed, policy.inference_penalty).otherwise(0.0)
    )
    kept = kept.withColumn("score", score)
    if order and policy.order:
        kept = kept.withColumn("score", F.col("score") + policy.order * order_bonus(order))
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    top = kept.orderBy(F.desc("score"), "id").limit(most)
    out = top.select("id", rank.alias("rank"), "score", "relevance", "dense", "lexical", "entity", "cost", "scope_id", "kind")
    return reranker(out) if reranker else out


def raw_search(turns: DataFrame, vector: Column, scopes: list[str], limit: int = 30, expression: dict | None = None) -> DataFrame:
    """message_id, session_id, scope_id, text, created_at, similarity: user turns nearest to a vector, in scopes that may be read.

    ``turns`` has id, session_id, scope_id, role, content, created_at and v; each counts as kind ``evidence``, without tags or subject.
    """
    rows = turns.withColumns({"kind": F.lit("evidence"), "tags": F.array().cast("array<string>"), "subject_id": F.lit(None).cast("string")})
    rows = filters.matching(rows.filter(F.col("scope_id").isin(scopes) & (F.col("role") == "user") & F.col("v").isNotNull()), expression)
    near = rows.withColumn("s", scores.dot(F.col("v"), vector)).orderBy(F.desc("s"), "id").limit(limit)
    return near.select(F.col("id").alias("message_id"), "session_id", "scope_id", F.col("content").alias("text"), "created_at", F.round("s", 4).alias("similarity"))


def order_bonus(order: str) -> Column:
    """0 to 1 by the place in time among the rows; 0 where fewer than two moments differ."""
    at = F.unix_micros(F.coalesce("event_start", "event_end", "document_date") if order == "earliest" else F.coalesce("event_end", "event_start", "document_date"))
    all_rows = Window.partitionBy()
    low, high = F.min(at).over(all_rows), F.max(at).over(all_rows)
    place = (at - low) / (high - low)
    return F.when(high > low, place if order == "latest" else 1 - place).otherwise(0.0)


def within_budget(ranked: DataFrame, budget: int, limit: int, *by: str) -> DataFrame:
    """rank, cost and running total of what fits: a row too large is skipped, and later ones still count.

    ``ranked`` has columns rank and cost, and holds a bounded number of rows for each group of ``by``.
    """
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<rank:bigint,cost:bigint,used:bigint>>").alias("rows"))

    def step(s: Column, x: Column) -> Column:
        used = s["used"] + x["cost"]
        fits = (used <= budget) & (F.size(s["rows"]) < limit)
        row = F.struct(x["rank"].alias("rank"), x["cost"].alias("cost"), used.alias("used"))
        return F.struct(F.when(fits, used).otherwise(s["used"]).alias("used"), F.when(fits, F.array_append(s["rows"], row)).otherwise(s["rows"]).alias("rows"))

    items = F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), F.col("cost").cast("long").alias("cost"))))
    folded = ranked.groupBy(*by).agg(F.aggregate(items, state, step, lambda s: s["rows"]).alias("rows"))
    return folded.select(*by, F.explode("rows").alias("x")).select(*by, "x.rank", "x.cost", "x.used")


#: Tokens that a piece of a context costs besides its text; fixed value.
PIECE = 6


def packed(facts: DataFrame, passages: DataFrame, sources: DataFrame, budgets: list[int], limit: int) -> DataFrame:
    """budget, part, id, fact, rank, cost, used: what a context holds under each budget.

    Facts and passages (id, rank, cost) alternate by rank, ``limit`` of them at most; then the sources (fact, id, nth, cost) of the facts that were taken, fact by fact, from what
    is left.  A piece too large is skipped, and later ones still count.  One pass over the offered rows, of which there is a bounded number, carries both levels.
    """
    text_of = lambda rows, part, b: rows.select(F.lit(0).alias("phase"), F.col("rank").cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(part).alias("part"), "id", F.lit(None).cast("string").alias("fact"), (F.col("cost") + PIECE).cast("long").alias("cost"))
    of_fact = sources.join(facts.select(F.col("id").alias("fact"), "rank"), "fact")
    more = of_fact.select(F.lit(1), F.col("rank").cast("long"), F.col("nth").cast("long"), F.lit("source"), "id", "fact", (F.col("cost") + PIECE).cast("long"))
    offered = text_of(facts, "fact", 0).unionAll(text_of(passages, "passage", 1)).unionAll(more)
    kept = "array<struct<part:string,id:string,fact:string,rank:bigint,cost:bigint,used:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("facts"), F.array().cast(kept).alias("rows"))

    def step(budget: int):
        def one(s: Column, x: Column) -> Column:
            used, first = s["used"] + x["cost"], x["phase"] == 0
            takes = (used <= budget) & F.when(first, s["n"] < limit).otherwise(F.array_contains(s["facts"], x["fact"]))
            row = F.struct(x["part"].alias("part"), x["id"].alias("id"), x["fact"].alias("fact"), x["a"].alias("rank"), x["cost"].alias("cost"), used.alias("used"))
            return F.struct(
                F.when(takes, used).otherwise(s["used"]).alias("used"), (s["n"] + (takes & first).cast("int")).alias("n"),
                F.when(takes & (x["part"] == "fact"), F.array_append(s["facts"], x["id"])).otherwise(s["facts"]).alias("facts"), F.when(takes, F.array_append(s["rows"], row)).otherwise(s["rows"]).alias("rows"),
            )

        return one

    items = offered.agg(F.array_sort(F.collect_list(F.struct("phase", "a", "b", "part", "id", "fact", "cost"))).alias("x"))
    each = items.select(F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), F.aggregate("x", start, step(b), lambda s: s["rows"]).alias("rows")) for b in budgets])).alias("y"))
    return each.select("y.budget", F.explode("y.rows").alias("z")).select("budget", "z.*")


def fused(ranked: DataFrame, k: int = 60) -> DataFrame:
    """id, rrf, score, rank: reciprocal ranks summed over lists (columns list, id, rank, score)."""
    out = ranked.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.max("score").alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rrf"), F.desc("score"), "id")))


def scaled(value: Column, over: Window) -> Column:
    """Min-max over a window; 0 where all are equal."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(high > low, (value - low) / (high - low)).otherwise(0.0)


def blended(ranked: DataFrame, head: int = 30, weight: float = 0.7) -> DataFrame:
    """id, rank, score: the first rows ordered anew by a cross score (column cross), the others behind them as before."""
    inside = Window.partitionBy(F.col("rank") <= head)
    score = F.when(F.col("rank") <= head, weight * scaled(F.col("cross"), inside) + (1 - weight) * scaled(F.col("score"), inside)).otherwise(F.col("score"))
    out = ranked.withColumn("blend", score)
    order = Window.orderBy((F.col("rank") > head), F.when(F.col("rank") <= head, -F.col("blend")).otherwise(F.col("rank")), "id")
    return out.select("id", F.row_number().over(order).alias("rank"), F.col("blend").alias("score"))
