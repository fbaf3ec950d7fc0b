"""Relations between memories: readable edges, histories, neighbours, clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.lineage import written
from gistmill.operators.components import components


def readable_edges(edges: DataFrame, memories: DataFrame, scopes: list[str]) -> DataFrame:
    """Edges whose ends both lie in scopes that may be read."""
    seen = memories.filter(F.col("scope_id").isin(scopes)).select("id", "scope_id", "status")
    ends = edges.join(seen.select(F.col("id").alias("from_id"), F.col("scope_id").alias("from_scope")), "from_id")
    return ends.join(seen.select(F.col("id").alias("to_id"), F.col("scope_id").alias("to_scope"), F.col("status").alias("to_status")), "to_id")


def histories(edges: DataFrame, memories: DataFrame, depth: int = 8) -> DataFrame:
    """id, past, hops: superseded memories behind each one by 'updates', nearest first, up to a depth."""
    step = edges.filter("relation = 'updates'").select("from_id", "to_id")
    old = memories.filter("status = 'superseded'").select(F.col("id").alias("to_id"))
    step = step.join(old, "to_id", "left_semi")
    step = written(step)
    found = front = step.select(F.col("from_id").alias("id"), F.col("to_id").alias("past"), F.lit(1).alias("hops"))
    for hops in range(2, depth + 1):
        # a level is written once, and the first empty one is the last
        front = written(front.join(step, F.col("past") == F.col("from_id")).select("id", F.col("to_id").alias("past"), F.lit(hops).alias("hops")).distinct())
        if front.isEmpty():
            break
        found = found.unionAll(front)
    return found.groupBy("id", "past").agg(F.min("hops").alias("hops")).filter("id != past")


def neighbours(edges: DataFrame, most: int = 3) -> DataFrame:
    """id, other, label, nth: up to ``most`` neighbours of each memory over edges in either direction."""
    out = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), F.col("relation").alias("label"))
    back = edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), F.concat(F.col("relation"), F.lit("_by")).alias("label"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("other", "label"))
    return out.unionAll(back).distinct().withColumn("nth", nth).filter(F.col("nth") <= most)


#: Vectors in a block; a task holds two blocks and the products between them.
BLOCK = 1024


def block_products(rows: DataFrame, same: list[str], keep, schema: str) -> DataFrame:
    """What ``keep`` makes of each pair of blocks of rows that agree in the columns ``same``.

    A group, however large, is cut into blocks by hashes of ids, and each pair of blocks is one task's matrix product, so all pairs are
    seen and none is a row.  ``keep`` takes ids and the products of two blocks (in equal blocks those of a block with itself) and gives a table.
    Rows with a null vector take no part; nulls in ``same`` form a group of their own.
    """
    rows = rows.filter("v IS NOT NULL").select(F.struct(*same).alias("g"), "id", "v")
    blocks = rows.groupBy(F.col("g").alias("h")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(blocks, F.col("g").eqNullSafe(F.col("h"))).select("g", "id", "v", "blocks").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    # a block meets itself and each other block once
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = rows.select("g", "id", "v", "own", each).select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "v")

    def products(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own, ids = table.column("own").to_numpy(), np.array(table.column("id").to_pylist(), dtype=object)
        v = table.column("v").combine_chunks()
        x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        return keep(ids[left], ids[right], x[left] @ x[right].T if len(left) and len(right) else np.zeros((len(left), len(right))), i == j)

    return dealt.groupBy("g", "i", "j").applyInArrow(products, schema)


def similar_pairs(rows: DataFrame, threshold: float, *same: str) -> DataFrame:
    """a, b, cosine of rows (id, v) that agree in the columns ``same`` and whose vectors are similar; a comes before b."""

    def keep(left, right, products, within: bool) -> pa.Table:
        x, y = np.nonzero(products >= threshold)
        a, b = left[x], right[y]
        once = a < b if within else np.ones(len(a), dtype=bool)
        a, b, c = a[once], b[once], products[x, y][once]
        low, high = np.where(a < b, a, b), np.where(a < b, b, a)
        return pa.table({"a": pa.array(low, pa.string()), "b": pa.array(high, pa.string()), "cosine": pa.array(c, pa.float64())})

    return block_products(rows, list(same), keep, "a string, b string, cosine double")


def nearest(rows: DataFrame, k: int, floor: float, *same: str) -> DataFrame:
    """id, other, cosine, nth: for each row its k most similar others at or above a floor, within the groups of ``same``."""

    def keep(left, right, products, within: bool) -> pa.Table:
        out: list[list] = [[], [], []]
        for ids, others, p in ((left, right, products), (right, left, products.T))[: 1 if within else 2]:
            for n, name in enumerate(ids):
                at = np.flatnonzero((p[n] >= floor) & (others != name))
                at = at[np.lexsort((others[at].astype(str), -p[n][at]))][:k]
                out[0] += [name] * len(at)
                out[1] += others[at].tolist()
                out[2] += p[n][at].tolist()
        return pa.table({"id": pa.array(out[0], pa.string()), "other": pa.array(out[1], pa.string()), "cosine": pa.array(out[2], pa.float64())})

    found = block_products(rows, list(same), keep, "id string, other string, cosine double")
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= k)


#: Rows of each side in a task of ``nearest_to``, and those of them whose products are held at a time.
SIDE, STRIP = 8192, 512


def nearest_to(asking: DataFrame, rows: DataFrame, k: int, *same: str, floor: float | None = None) -> DataFrame:
    """asked, other, cosine: for each of ``asking`` (id, v) the k most similar of ``rows`` (id, v) that agree in the columns ``same``, at or above a floor, and maybe more for each pair of blocks.

    Ties go to the smaller id.  Only blocks of the one side meet blocks of the other; each pair of blocks is one task's matrix product, a strip of which is held at a time.
    """
    sides = [d.filter("v IS NOT NULL").select(F.struct(*same).alias("g"), F.col("id").cast("string").alias("id"), "v") for d in (asking, rows)]
    blocks = [d.groupBy(F.col("g").alias("h")).agg(F.ceil(F.count("*") / SIDE).cast("int").alias(n)) for d, n in zip(sides, ("is", "js"), strict=True)]
    both = blocks[0].join(blocks[1].withColumnRenamed("h", "h2"), F.col("h").eqNullSafe(F.col("h2"))).select("h", "is", "js")

    def dealt(side: DataFrame, asks: bool) -> DataFrame:
        own, others = ("is", "js") if asks else ("js", "is")
        x = side.join(both, F.col("g").eqNullSafe(F.col("h"))).withColumn("own", F.pmod(F.xxhash64("id"), own).cast("int"))
        x = x.select("g", "id", "v", "own", F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias("other"))
        i, j = ("own", "other") if asks else ("other", "own")
        return x.select("g", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(asks).alias("asks"), "id", "v")

    def found(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        ids, v = np.array(table.column("id").to_pylist(), dtype=object), table.column("v").combine_chunks()
        x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)
        held = np.flatnonzero(~asks)
        held = held[np.argsort(ids[held].astype(str), kind="stable")]  # the first of equal products has the smaller id
        asked, y, out = np.flatnonzero(asks), x[held].T, []
        for n in range(0, len(asked) if len(held) else 0, STRIP):
            mine = asked[n : n + STRIP]
            products, at = x[mine] @ y, np.arange(len(mine))
            products[np.isnan(products)] = -np.inf
            for _ in range(min(k, len(held))):
                best = products.argmax(axis=1)
                cosine = products[at, best]
                kept = cosine > -np.inf if floor is None else cosine >= floor
                if not kept.any():
                    break
                out.append((ids[mine[kept]], ids[held[best[kept]]], cosine[kept]))
                products[at, best] = -np.inf
        parts = [np.concatenate(p) for p in zip(*out, strict=True)] if out else [[], [], []]
        return pa.table({"asked": pa.array(parts[0], pa.string()), "other": pa.array(parts[1], pa.string()), "cosine": pa.array(parts[2], pa.float64())})

    return dealt(sides[0], True).unionAll(dealt(sides[1], False)).groupBy("g", "i", "j").applyInArrow(found, "asked string, other string, cosine double")


def clusters(pairs: DataFrame) -> DataFrame:
    """node, cluster: each member of a pair with the smallest member that it reaches."""
    return components(pairs).select("node", F.col("component").alias("cluster"))


def semantic_groups(pairs: DataFrame, rows: DataFrame, wording: Column | str = "wording", most: int = 6) -> DataFrame:
    """node, cluster, size, oversized: clusters of similar rows, without those whose members all have one ``wording``, which is worked out from ``rows`` (with id) for members only.

    Clusters of more than ``most`` members are named, but too large to be merged.
    """
    found = clusters(pairs)
    told = found.join(rows.withColumnRenamed("id", "node"), "node", "left").select("node", "cluster", (F.col(wording) if isinstance(wording, str) else wording).alias("wording"))
    size = told.groupBy("cluster").agg(F.count("*").alias("size"), F.count_distinct("wording").alias("wordings"), F.count_if(F.col("wording").isNull()).alias("unknown"))
    kept = size.filter((F.col("wordings") + F.col("unknown")) > 1).select("cluster", "size", (F.col("size") > most).alias("oversized"))
    return found.join(kept, "cluster").select("node", "cluster", "size", "oversized")


def linked(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """id, other, relation and what a reader is shown of the other: text, kind, status, source_role, document_date, event_dates (days, in order), valid_until.

    ``edges`` has id, other and label.
    """
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    dates = F.array_distinct(F.array_compact(F.array(day("event_start"), day("event_end"))))
    shown = rows.select(F.col("id").alias("other"), "text", "kind", "status", "source_role", "document_date", dates.alias("event_dates"), "valid_until")
    return edges.select("id", "other", F.col("label").alias("relation")).join(shown, "other").select("id", "other", "relation", *shown.columns[1:])


def within_leftover(rows: DataFrame, budget: int, by: str) -> DataFrame:
    """by, id, other, used: neighbours (by, part, id, other, cost) that fit what is left of a budget, part by part; one too large is skipped.  A group has a bounded number."""
    items = F.array_sort(F.collect_list(F.struct("part", "id", "other", F.col("cost").cast("long").alias("cost"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<id:string,other:string,used:bigint>>").alias("rows"))

    def step(s, x):
        used = s["used"] + x["cost"]
        row = F.struct(x["id"].alias("id"), x["other"].alias("other"), used.alias("used"))
        return F.struct(F.when(used <= budget, used).otherwise(s["used"]).alias("used"), F.when(used <= budget, F.array_append(s["rows"], row)).otherwise(s["rows"]).alias("rows"))

    folded = rows.groupBy(by).agg(F.aggregate(items, start, step, lambda s: s["rows"]).alias("rows"))
    return folded.select(by, F.explode("rows").alias("x")).select(by, "x.id", "x.other", "x.used")
