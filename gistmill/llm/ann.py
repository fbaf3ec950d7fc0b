"""Approximate nearest neighbours: inverted lists with an adaptive dimension scan.

Vectors are dealt into lists by their nearest centroid.  Centroids are fitted on at most
``SAMPLE`` vectors, chosen by a hash of the id; every vector is indexed.  How many lists a
query probes at least is calibrated on the sample: the fewest that hold ``AIM`` of the true neighbours of sampled
vectors.  A query whose lists hold fewer than k candidates probes further ones until they do.

Vectors are rotated at random once.  Within a probed list a candidate is scanned in blocks of
``COLUMNS`` rotated columns.  As the partial distance over d of D columns, times D / d, estimates
the distance, the hypothesis that a candidate is nearer than the k-th best so far is
rejected once the estimate exceeds that by a factor of 1 + EPSILON / sqrt(d), and the candidate is
abandoned.  The others are measured on the original vectors in double precision.

A list is cut into pieces of at most about ``PIECE`` vectors and ``QUERIES`` queries, so that a list
with a third of all vectors, or queries, is many tasks' work; each piece gives its k best.

Defined results: null vectors, vectors of zeros, and vectors that hold null or non-finite
components or have another length than most take no part, as queries or candidates; rows with the query's id are no
candidates; where rows repeat an id, each is a candidate, and a query id that repeats is answered once, by the least
distances from any of its rows; equal distances are ordered by id; vectors of any finite size are measured, as differences
are scaled by their largest component; fewer candidates than k give fewer rows; an empty table gives none; further columns
play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.lineage import written

SAMPLE, MOST_LISTS, AIM = 20_000, 1024, 0.98
COLUMNS, EPSILON = 16, 2.1
PIECE, QUERIES = 20_000, 2_000


def usable(vector: Column) -> Column:
    """Whether a vector can take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances; where squares would overflow or vanish, of differences divided by a power of two."""
    d = x - q
    size = np.abs(d).max(axis=1, initial=0.0)
    odd = (size > 1e150) | ((size < 1e-150) & (size > 0))
    out = np.sqrt((d**2).sum(axis=1)) if not odd.any() else np.sqrt((np.where(odd[:, None], 0.0, d) ** 2).sum(axis=1))
    if odd.any():
        power = np.exp2(np.ceil(np.log2(np.abs(np.c_[x[odd], np.broadcast_to(q, x[odd].shape)]).max(axis=1))))[:, None]
        half = x[odd] / power - q / power
        at = np.abs(half).max(axis=1)[:, None]
        at[at == 0] = 1.0
        out[odd] = np.sqrt(((half / at) ** 2).sum(axis=1)) * at[:, 0] * power[:, 0]
    return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None, :]


class Index:
    """Centroids, the rotation and the number of lists to probe at least."""

    def __init__(self, sample: np.ndarray, rows: int, k: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = sample.shape[1]
        # a power of two, so that centroids are found among numbers whose squares are finite
        self.scale = float(np.exp2(-np.floor(np.log2(np.abs(sample).max()))))
        sample = self.scaled(sample)
        self.rotation = np.linalg.qr(rng.normal(size=(self.size, self.size)))[0]
        lists = int(min(MOST_LISTS, max(1, rows**0.5 / 2))) if rows > 1000 else 1
        self.centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
        for _ in range(12 if lists > 1 else 0):
            mine = self.nearest(sample)
            sums, n = np.zeros_like(self.centroids), np.bincount(mine, minlength=len(self.centroids))
            np.add.at(sums, mine, sample)
            self.centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.centroids)
        self.probes = self._calibrated(sample, k, rng)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(x * self.scale, -1e120, 1e120)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The list of each scaled vector."""
        return np.concatenate([_squares(x[i : i + 4096], self.centroids).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.array([], dtype=np.int64)

    def _calibrated(self, sample: np.ndarray, k: int, rng) -> int:
        lists = len(self.centroids)
        if lists == 1 or len(sample) <= k:
            return lists
        asked = rng.choice(len(sample), min(200, len(sample)), replace=False)
        near = _squares(sample[asked], sample)
        near[np.arange(len(asked)), asked] = np.inf
        home = self.nearest(sample)[np.argpartition(near, k, axis=1)[:, :k]]
        rank = _squares(sample[asked], self.centroids).argsort(1).argsort(1)
        needed = np.sort(np.take_along_axis(rank, home, axis=1).ravel())
        return min(lists, int(needed[min(len(needed) - 1, int(np.ceil(AIM * len(needed))))]) + 1)

    def probed(self, x: np.ndarray, sizes: np.ndarray, own: list[dict], k: int) -> list[list[int]]:
        """Lists to probe for each query, by the lists' sizes and the number of rows in them that have the query's own id."""
        out = []
        for order, mine in zip(_squares(self.scaled(x), self.centroids).argsort(1), own, strict=True):
            left = sizes.copy()
            for at, n in mine.items():
                left[at] -= n
            enough = int(np.searchsorted(np.cumsum(left[order]), k)) + 1
            out.append(order[: max(self.probes, enough)].tolist())
        return out


def scan(index: Index, ids: np.ndarray, vectors: np.ndarray, rotated: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest of some vectors, nearest first, by the adaptive scan."""
    turned = query @ index.rotation
    found, best = np.array([], dtype=np.int64), np.array([])
    limit = float("inf")
    for i in range(0, len(ids), 2048):
        alive = np.arange(i, min(i + 2048, len(ids)))
        alive = alive[ids[alive] != query_id]
        if np.isfinite(limit):
            bound = limit * limit  # infinite where it overflows: then all are measured
            partial = np.zeros(len(alive))
            for d in range(0, index.size, COLUMNS):
                to = min(d + COLUMNS, index.size)
                with np.errstate(over="ignore"):
                    partial += ((rotated[alive, d:to] - turned[d:to]) ** 2).sum(axis=1)
                slack = (1 + EPSILON / to**0.5) ** 2 if to < index.size else 1 + 1e-9
                keep = ~(partial * (index.size / to) > bound * slack) | (bound < 1e-300)
                alive, partial = alive[keep], partial[keep]
        found, best = np.concatenate((found, alive)), np.concatenate((best, _distances(vectors[alive], query)))
        order = np.lexsort((ids[found], best))[:k]
        found, best = found[order], best[order]
        limit = float(best[-1]) if len(best) == k else float("inf")
    return found, best


def search(table: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that ``queries`` selects."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), queries.alias("asks")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return table.sparkSession.createDataFrame([], empty)
    rows = rows.filter(F.size("v") == sizes.d)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    index = table.sparkSession.sparkContext.broadcast(Index(np.array(chosen.tolist(), dtype=float), sizes.n, k))

    def assign(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, -1)
            home = index.value.nearest(index.value.scaled(x))
            columns = [pa.array(home, pa.int32()), batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["list", "vec_id", "v", "asks"])

    indexed = written(rows.mapInArrow(assign, "list int, vec_id long, v binary, asks boolean").withColumn("row", F.monotonically_increasing_id()))
    sizes = np.zeros(len(index.value.centroids), dtype=np.int64)
    for r in indexed.groupBy("list").count().collect():  # a row for each list
        sizes[r["list"]] = r["count"]

    def probe(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, index.value.size)
            own = [{n["list"]: n["count"] for n in at} for at in batch.column(2).to_pylist()]
            probes = index.value.probed(x, sizes, own, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(probes, pa.list_(pa.int32()))], names=["query_id", "q", "probes"])

    asking = indexed.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    own = indexed.select("vec_id", "list").join(asking.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    own = own.groupBy("vec_id", "list").count().groupBy(F.col("vec_id").alias("query_id")).agg(F.collect_list(F.struct("list", "count")).alias("own"))
    asked = written(asking.join(own, "query_id").select("query_id", "q", "own").mapInArrow(probe, "query_id long, q binary, probes array<int>"))
    asked = asked.select(F.explode("probes").alias("list"), "query_id", "q")
    # a row for each list, of which there are MOST_LISTS at most
    pieces = indexed.groupBy("list").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")).join(
        asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("rounds")), "list"
    )
    pieces = F.broadcast(written(pieces))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = indexed.drop("asks").join(pieces, "list").select("list", F.pmod(F.xxhash64("vec_id"), "pieces").cast("int").alias("piece"), every("rounds").alias("round"), "vec_id", "row", "v")
    right = asked.join(pieces, "list").select("list", every("pieces").alias("piece"), F.pmod(F.xxhash64("query_id"), "rounds").cast("int").alias("round"), "query_id", "q")

    def nearest(candidates: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if candidates.num_rows and wanted.num_rows:
            ids, row = candidates.column("vec_id").to_numpy(), candidates.column("row").to_numpy()
            vectors = np.frombuffer(b"".join(candidates.column("v").to_pylist())).reshape(len(ids), -1)
            rotated = vectors @ index.value.rotation
            for query_id, q in zip(wanted.column("query_id").to_pylist(), wanted.column("q").to_pylist(), strict=True):
                found, score = scan(index.value, ids, vectors, rotated, query_id, np.frombuffer(q), k)
                out[0] += [query_id] * len(found)
                out[1] += ids[found].tolist()
                out[2] += score.tolist()
                out[3] += row[found].tolist()
        names, types = ["query_id", "vec_id", "score", "row"], [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        return pa.table({name: pa.array(x, t) for name, x, t in zip(names, out, types, strict=True)})

    parts = ["list", "piece", "round"]
    found = left.groupBy(*parts).cogroup(right.groupBy(*parts)).applyInArrow(nearest, "query_id long, vec_id long, score double, row long")
    # a query id that repeats finds a row from each of its own
    found = found.groupBy("query_id", "vec_id", "row").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
