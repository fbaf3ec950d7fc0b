"""What the operators on vectors share: which rows take part, and batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column, most: float) -> Column:
    """Whether a vector is not null, not empty, and holds only numbers under ``most`` in size."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= most))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def common_size(rows: DataFrame, vector_col: str) -> tuple[int, int] | None:
    """The length that most vectors have, ties to the smaller, and how many have it; None without rows."""
    found = rows.groupBy(F.size(vector_col).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return (found.d, found.n) if found else None


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A row for each list of ``size`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def summed(partials: DataFrame, key: list[str], values: str, size: int, kind: str) -> list:
    """Tasks' arrays of ``size`` numbers, summed place by place for each key; a row for each key comes to the driver."""
    return partials.groupBy(*key).agg(F.array(*[F.sum(F.col(values)[i].cast(kind)) for i in range(size)]).alias(values)).collect()
