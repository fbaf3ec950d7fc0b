"""Vector code compression: product codes whose nearest entries are found by a VA-file.

Vectors of integers are cut into parts; each part position has a codebook, refined by Lloyd's rounds in integers.  The
nearest entry of a part is found by filtering, then refining.  Each codebook's entries are quantised: in every dimension the
entries' coordinates fall into 2^``BITS`` cells, and an entry is kept as its cells' numbers.  For a part that is asked, a table
holds the least and the greatest squared difference to each cell of each dimension; sums of table entries bound the distance to
an entry from below and above.  Only entries whose lower bound does not exceed the least upper bound are measured, in
integers, so the result is exact.

Each round sends the driver one sum for each codebook entry and place; rows stay where they are.

Defined results: vectors that are null, empty, or hold null or non-finite components, or whose integers
reach 2^53, and vectors of another length than most (ties to the shorter) take no part.  Where the length is no multiple of the
number of parts, the first parts are one longer.  With fewer rows than entries a codebook has one entry for each row.  Repeated
ids are rows of their own; among the smallest ids, ties are ordered by vector, and null ids come last.  Equal distances go to the
lower entry.  An error beyond a long is null, as is the sum over its label.  An empty table gives no rows; further columns play no
part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.lineage import written
from gistmill.llm.vectors import common_size, finite, matrix, summed

PARTS, ENTRIES, ROUNDS, BITS = 4, 256, 4, 4
#: Integers are under this in size.
MOST = 2.0**53
#: Rows that are held against a codebook at a time.
SLICE = 1024
#: So many labels at most are broadcast with their sums; more are joined by a shuffle, rows dealt to so many places for each label.
LABELS, DEAL = 10_000, 32


def _fits(*arrays: np.ndarray) -> bool:
    """Whether sums of squared differences fit into 64 bits."""
    most = sum(int(np.abs(a).max(initial=0)) for a in arrays)
    return most * most * max(1, arrays[0].shape[-1]) < 1 << 63


@dataclass
class Cells:
    """One part's entries, and the cells that their coordinates fall into."""

    entries: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, bits: int = BITS) -> Cells:
        """Cells with about as many entries each, in every dimension; their edges are coordinates of entries."""
        n, size = entries.shape
        rank = entries.argsort(axis=0, kind="stable").argsort(axis=0, kind="stable")
        cell = rank * min(n, 1 << bits) // n
        count = int(cell.max(initial=0)) + 1
        low, high = np.full((size, count), np.inf), np.full((size, count), -np.inf)
        for d in range(size):
            np.minimum.at(low[d], cell[:, d], entries[:, d])
            np.maximum.at(high[d], cell[:, d], entries[:, d])
        return cls(entries, cell, low, high)

    def candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and entries whose bounds overlap, row by row, entries ascending."""
        v = x.astype(float)[:, :, None]
        under, over = v - self.low, v - self.high
        least = np.where((under >= 0) & (over <= 0), 0.0, np.minimum(under**2, over**2))
        most = np.maximum(under**2, over**2)
        lower, upper = np.zeros((len(x), len(self.entries))), np.zeros((len(x), len(self.entries)))
        for d in range(x.shape[1]):
            lower += least[:, d].take(self.cell[:, d], axis=1)
            upper += most[:, d].take(self.cell[:, d], axis=1)
        # the factor covers the rounding of the sums
        return np.nonzero(lower <= upper.min(axis=1, keepdims=True) * (1 + 1e-9))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest entry and its squared distance; ties to the lower entry."""
        at, entry = self.candidates(x)
        wide = _fits(x, self.entries)
        away = x[at] - self.entries[entry] if wide else x[at].astype(object) - self.entries[entry].astype(object)
        square = (away * away).sum(axis=1)
        first = np.searchsorted(at, np.arange(len(x)))
        least = np.minimum.reduceat(square, first)
        number = np.where(square == least[at], entry, len(self.entries))
        return np.minimum.reduceat(number, first), least


def widths(size: int, parts: int) -> list[slice]:
    """The places of each part."""
    ends = np.cumsum([size // parts + (i < size % parts) for i in range(parts)]).tolist()
    return [slice(a, b) for a, b in zip([0, *ends], ends, strict=False)]


def _refined(rows: DataFrame, size: int, parts: list[slice], books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: codebooks whose entries are the means of the parts that were nearest to them."""
    cells, most = [Cells.of(b) for b in books], max(p.stop - p.start for p in parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), most), dtype=object) for b in books]
        count = [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            x = matrix(batch.column(0), size)
            for i in range(0, len(x), SLICE):
                for k, p in enumerate(parts):
                    own = x[i : i + SLICE, p]
                    entry, _ = cells[k].nearest(own)
                    part = np.zeros((len(books[k]), own.shape[1]), dtype=np.int64)  # SLICE numbers under 2^53 fit
                    np.add.at(part, entry, own)
                    sums[k][:, : own.shape[1]] += part.astype(object)
                    count[k] += np.bincount(entry, minlength=len(books[k]))
        for k in range(len(books)):
            used = np.flatnonzero(count[k])
            values = [[Decimal(int(v)) for v in (count[k][e], *sums[k][e])] for e in used]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(values, pa.list_(pa.decimal128(38, 0)))], names=["part", "entry", "values"])

    partials = rows.select("x").mapInArrow(run, "part int, entry int, values array<decimal(38,0)>")
    new = [b.copy() for b in books]
    for r in summed(partials, ["part", "entry"], "values", most + 1, "decimal(38,0)"):  # at most ENTRIES for each part
        width = parts[r["part"]].stop - parts[r["part"]].start
        n = int(r["values"][0])
        new[r["part"]][r["entry"]] = [int(v) // n for v in r["values"][1 : width + 1]]
    return new


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def train(rows: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks from rows of vec_id and x, all of one length; they start as the smallest ids' parts."""
    start = np.array([r.x for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()], dtype=np.int64)
    places = widths(size, parts)
    books = [start[:, p] for p in places]
    for _ in range(rounds):
        books = _refined(rows, size, places, books)
    return books


def encode(rows: DataFrame, size: int, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error of rows with vec_id, label and x."""
    places, cells = widths(size, len(books)), [Cells.of(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), size)
            code: list[str] = []
            error: list[int | None] = []
            for i in range(0, len(x), SLICE):
                found = [c.nearest(x[i : i + SLICE, p]) for c, p in zip(cells, places, strict=True)]
                code += [bytes(e).hex() for e in np.stack([e for e, _ in found], axis=1).astype(np.uint8).tolist()]
                total = (int(sum(v)) for v in zip(*(s.tolist() for _, s in found), strict=True))
                error += [v if v < 1 << 63 else None for v in total]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "x").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """The rows with the sum of errors over equal labels, nulls together."""
    total = F.when(F.count("error") == F.count("*"), F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS bigint)"))
    totals = written(coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of"))
    if totals.count() <= LABELS:
        return coded.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    # a label may have a third of all rows
    dealt = totals.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))))
    rows = coded.withColumn("at", F.pmod(F.xxhash64("vec_id", "code"), F.lit(DEAL)).cast("int"))
    return rows.join(dealt, F.col("label").eqNullSafe(F.col("of")) & (F.col("at") == F.col("deal")), "left").drop("of", "at", "deal")


def compress(table: DataFrame, x: Column, id_col: str = "vec_id", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each row that takes part; ``x`` gives a row's numbers, which are floored."""
    if entries > 256:
        raise ValueError("an index has two hex digits")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), x.alias("x")).filter(finite(F.col("x"), MOST))
    rows = rows.withColumn("x", F.transform("x", lambda v: F.floor(v).cast("long")))
    found = common_size(rows, "x")
    if not found:
        return table.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows = rows.filter(F.size("x") == found[0])
    books = train(rows, found[0], parts, entries, rounds)
    coded = written(encode(rows, found[0], books))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
