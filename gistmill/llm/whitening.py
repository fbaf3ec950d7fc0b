"""Whitening of integer vectors: a randomised range finder, and Rayleigh-Ritz on its subspace.

The covariance V of the rows is never formed from raw products.  Every pass over the rows centres them by their exact
mean, multiplies them with a basis Q of a few directions and adds up V Q, which is all that reaches the driver: d rows of
so many numbers.  Q starts as random directions, ``OVERSAMPLE`` more than there are components.  After each pass the
eigenvectors of Q'VQ give Ritz pairs, and the residuals |V u - e u| tell how far those are from being eigenvectors of V.  While
they are over ``TOLERANCE`` times the largest eigenvalue, V Q spans the next basis (a power pass).  Where the
residuals will not get there within ``PASSES`` passes, as with spectra that fall slowly, the basis is expanded to the full
dimension, and one more pass makes the pairs exact.

Sums of entries, and the distance of a row from the mean, are integers and exact.

Defined results: vectors that are null, empty, or hold null or non-finite entries, or entries of 2^40 and over (for
which sums of squares say nothing in double precision), and vectors of another length than most (ties to the shorter) take no
part.  Components are numbered by falling eigenvalue; equal eigenvalues leave their eigenvectors free, and any choice is the
same for all rows.  Directions without variance, those under d * 2^-52 of the largest eigenvalue, have no
whitening and give no rows; so a single row, or equal rows alone, give none, nor does an empty table.  Rows that repeat count
each for itself; a null id is kept; a deviation beyond a long is null; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm.vectors import common_size, finite, matrix, summed

COMPONENTS, OVERSAMPLE, PASSES, TOLERANCE, SEED = 32, 10, 4, 1e-13, 20240611
#: Entries are under this in size.
MOST = 2.0**40
#: Rows of a batch that are worked on at a time.
SLICE = 2048
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Mean:
    """The exact mean of n rows, as whole numbers and remainders over n."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Mean:
        return cls(n, np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=np.int64))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of squares of n * x - S for each row, exactly; None beyond a long."""
        away = x - self.whole
        most = self.n * (int(np.abs(away).max(initial=0)) + 1)
        if most * most * x.shape[1] < 1 << 63:
            return ((self.n * away - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((away.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


@dataclass
class Whitening:
    """Unit components as columns, their eigenvalues, the trace of V, and the basis sizes of the passes made."""

    mean: Mean
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: list[int]

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.mean.centred(x) @ self.components / np.sqrt(self.values)


def usable(rows: DataFrame) -> tuple[DataFrame, int, int] | None:
    """The rows of vec_id and x that take part, their dimension and number."""
    rows = rows.filter(finite(F.col("x"), MOST))
    found = common_size(rows, "x")
    return (rows.filter(F.size("x") == found[0]), *found) if found else None


def _parts(rows: DataFrame, size: int, width: int, kind: str, f) -> list:
    """Adds up over all rows the matrices that ``f`` makes of slices of them; rows (at, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix(batch.column(0), size)
            for i in range(0, len(x), SLICE):
                own = f(x[i : i + SLICE])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64() if kind != "double" else pa.float64()))], names=["at", "values"])

    partials = rows.select("x").mapInArrow(run, f"at int, values array<{'double' if kind == 'double' else 'long'}>")
    return [r["values"] for r in sorted(summed(partials, ["at"], "values", width, kind), key=lambda r: r["at"])]


def mean_of(rows: DataFrame, size: int, n: int) -> Mean:
    """One pass: the exact sums."""
    sums = _parts(rows, size, size, "decimal(38,0)", lambda x: x.sum(axis=0)[None, :])
    return Mean.of(n, [int(s) for s in sums[0]])


def multiplied(rows: DataFrame, mean: Mean, basis: np.ndarray) -> tuple[np.ndarray, float]:
    """One pass: V times the basis, and the trace of V."""
    size, width = basis.shape

    def own(x: np.ndarray) -> np.ndarray:
        c = mean.centred(x)
        return np.vstack((c.T @ (c @ basis), np.full((1, width), (c * c).sum())))

    total = np.array(_parts(rows, size, width, "double", own)) / mean.n
    return total[:-1], float(total[-1, 0])


def fit(rows: DataFrame, size: int, n: int, components: int = COMPONENTS) -> Whitening:
    """The leading components of usable rows."""
    mean = mean_of(rows, size, n)
    rng = np.random.default_rng(SEED)
    basis = np.linalg.qr(rng.normal(size=(size, min(size, components + OVERSAMPLE))))[0]
    passes: list[int] = []
    before = None
    while True:
        product, trace = multiplied(rows, mean, basis)
        passes.append(basis.shape[1])
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = basis @ turn
        worst = float(np.linalg.norm((product @ turn - ritz * values)[:, :components], axis=0).max())
        if basis.shape[1] == size or worst <= TOLERANCE * max(values[0], 0.0):
            break
        left = PASSES - len(passes)
        if left <= 0 or (before and worst * (worst / before) ** left > TOLERANCE * values[0]):
            # the residuals fail: all directions, those found first
            basis = np.linalg.qr(np.hstack((ritz, rng.normal(size=(size, size - basis.shape[1])))))[0]
        else:
            basis = np.linalg.qr(product)[0]
        before = worst
    keep = values[:components] > size * np.finfo(float).eps * max(values[0], 0.0)
    keep &= values[:components] > 0
    return Whitening(mean, ritz[:, :components][:, keep], values[:components][keep], trace, passes)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """One pass: the largest entry of the whitened rows' covariance less the identity."""
    size, k = model.components.shape

    def own(x: np.ndarray) -> np.ndarray:
        z = model.apply(x)
        return np.vstack((z.T @ z, z.sum(axis=0)))

    total = np.array(_parts(rows, size, k, "double", own)) / model.mean.n
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(k)).max())


def whiten(table: DataFrame, x: Column, components: int = COMPONENTS, id_col: str = "vec_id") -> DataFrame:
    """A row for each usable row and component: the columns of ``OUT``; ``x`` gives the integers of a row."""
    found = usable(table.select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<long>").alias("x")))
    empty = table.sparkSession.createDataFrame([], OUT)
    if not found:
        return empty
    rows, size, n = found
    model = fit(rows, size, n, components)
    if not len(model.values):
        return empty
    error, explained = identity_error(rows, model), model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                batch = whole.slice(i, SLICE)
                x = matrix(batch.column(1), size)
                m = len(x)
                again = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(model.mean.deviations(x), pa.int64()).take(again),
                        pa.array(model.apply(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, OUT)
