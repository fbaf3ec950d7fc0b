"""A place for an embedder: any function from a column of texts to vectors of length one; here one that needs no model."""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.functions import fulltext

SIZE = 64


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _hashed(stems: pd.Series) -> pd.Series:
    def vector(words) -> list[float] | None:
        if words is None:
            return None
        v = np.zeros(SIZE)
        for w in words:
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % SIZE] += 1.0 if h >> 63 else -1.0
        return (v / (np.linalg.norm(v) or 1.0)).tolist()

    return stems.map(vector)


def hashed(text: Column) -> Column:
    """Signed hashes of a text's stems; the same text has the same vector everywhere, a text without words zeros."""
    return _hashed(fulltext.stems(text))


def query_key(secret: str, query: str) -> str:
    """Under which name telemetry knows a query: a keyed digest of one short string."""
    if not secret:
        raise ValueError("an empty secret keeps no query private")
    return hmac.new(secret.encode(), query.encode(), hashlib.sha256).hexdigest()
