"""Profiles: blocks of memories under one token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.lineage import written
from gistmill.operators.curation import TRUSTED

# The blocks in order, and the share of the budget that each may spend; the last one may spend what is left.
SHARES = {"about": 0.20, "style": 0.35, "team": 0.20, "project": 0.20, "recent": 0.05}
#: Rows that a block may offer.
MOST = 60


def rendered(rows: DataFrame, budget: int, blocks: list[str], *by: str) -> DataFrame:
    """block, nth, id, cost of what a profile holds, for each group of ``by``.

    ``rows`` offers block, nth, id and cost, at most MOST to a block.  A row that does not fit is skipped, one that an
    earlier block has taken is not taken again, and what a block leaves goes to the last one.
    """
    number = F.create_map(*[F.lit(x) for k, b in enumerate(blocks) for x in (b, k)])
    allowance = F.array(*[F.lit(int(budget * SHARES.get(b, 0.2))) for b in blocks])
    offered = rows.filter(F.col("block").isin(*blocks) & (F.col("nth") <= MOST)).withColumn("b", F.element_at(number, F.col("block")))
    items = F.array_sort(F.collect_list(F.struct("b", "nth", "id", F.col("cost").cast("int").alias("cost"))))
    start = F.struct(F.lit(-1).alias("b"), F.lit(0).alias("spent"), F.lit(budget).alias("left"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<struct<b:int,nth:int,id:string,cost:int>>").alias("rows"))

    def step(s: Column, x: Column) -> Column:
        spent = F.when(s["b"] == x["b"], s["spent"]).otherwise(0)
        most = F.when(x["b"] == len(blocks) - 1, F.when(s["b"] == x["b"], s["left"] + s["spent"]).otherwise(s["left"])).otherwise(F.element_at(allowance, x["b"] + 1))
        takes = ~F.array_contains(s["seen"], x["id"]) & (spent + x["cost"] <= most) & (x["cost"] <= s["left"])
        return F.struct(
            x["b"].alias("b"), F.when(takes, spent + x["cost"]).otherwise(spent).alias("spent"), F.when(takes, s["left"] - x["cost"]).otherwise(s["left"]).alias("left"),
            F.when(takes, F.array_append(s["seen"], x["id"])).otherwise(s["seen"]).alias("seen"), F.when(takes, F.array_append(s["rows"], x)).otherwise(s["rows"]).alias("rows"),
        )

    folded = offered.groupBy(*by).agg(F.aggregate(items, start, step, lambda s: s["rows"]).alias("rows"))
    names = F.array(*map(F.lit, blocks))
    return folded.select(*by, F.explode("rows").alias("x")).select(*by, F.element_at(names, F.col("x.b") + 1).alias("block"), "x.nth", "x.id", "x.cost")


def without_subsets(clusters: DataFrame) -> DataFrame:
    """Clusters (no, members) without those whose members an earlier one holds all.

    A cluster in a dropped one lies in what that one was dropped for, too, so every earlier cluster may count.  Of equal clusters the first stands for all.  What holds
    a cluster holds its rarest member, so a cluster is held against the larger ones that have this member, and no others.
    """
    sets = written(clusters.select("no", F.array_sort("members").alias("members")).groupBy("members").agg(F.min("no").alias("first")))
    each = sets.select("first", "members", F.explode("members").alias("m"))
    often = each.groupBy("m").agg(F.count("*").alias("often"))
    rarest = each.join(often, "m").groupBy("first").agg(F.min_by("m", F.struct("often", "m")).alias("m"), F.min("often").alias("often")).filter("often > 1").select("first", "m")
    asked = sets.join(rarest, "first").select("first", F.col("members").alias("own"), "m")
    holding = each.select(F.col("first").alias("other"), "members", "m")
    inside = (F.col("other") < F.col("first")) & (F.size("members") > F.size("own")) & (F.size(F.array_except("own", "members")) == 0)
    held = asked.join(holding, (asked["m"] == holding["m"]) & inside).select("first").distinct()
    kept = sets.filter(F.size("members") > 0).join(held, "first", "left_anti").select(F.col("first").alias("no"))
    # nothing lies in any earlier cluster
    lone = sets.filter(F.size("members") == 0).select("first").filter(F.col("first") == sets.agg(F.min("first")).scalar()).select(F.col("first").alias("no"))
    return clusters.join(kept.unionAll(lone), "no", "left_semi")


def unrepeated(ranked: DataFrame, redundant: DataFrame, *by: str) -> DataFrame:
    """Ranked rows without those that a judgment calls redundant to an earlier kept one (pairs id, earlier)."""
    told = redundant.groupBy("id").agg(F.collect_set("earlier").alias("of"))
    items = F.array_sort(F.collect_list(F.struct("rank", "id", F.coalesce("of", F.array().cast("array<string>")).alias("of"))))
    start = F.array().cast("array<string>")
    kept = ranked.join(told, "id", "left").groupBy(*by).agg(F.aggregate(items, start, lambda s, x: F.when(F.arrays_overlap(s, x["of"]), s).otherwise(F.array_append(s, x["id"]))).alias("ids"))
    return kept.select(*by, F.posexplode("ids").alias("place", "id"))


def shown() -> Column:
    """Whether a profile shows a claim: of a trusted role, or an inference that someone has confirmed."""
    return F.col("source_role").isin(*TRUSTED) | ((F.col("source_role") == "inference") & (F.col("review_status") == "confirmed"))
