"""Verbatim passages of a text: spans that end at a paragraph or a sentence, and are never cut within one."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE, MOST_SIZE, MOST = 1200, 2400, 8
#: A blank line, or the end of a sentence with the white space behind it.
_END = re.compile(r"\n\s*\n|[.!?]\s+")


def spans(text: str, size: int = SIZE, most_size: int = MOST_SIZE, most: int = MOST) -> list[tuple[int, int]]:
    """(start, end) of consecutive passages.

    A passage ends at the last end within ``size`` characters, or else at the first one within ``most_size``.  Where there is none, no passage follows, since a cut might part a
    sentence from what it excepts.  Passages of white space are left out, and do not count among the ``most`` that are made.
    """
    out: list[tuple[int, int]] = []
    at = 0
    while at < len(text) and len(out) < most:
        end = len(text)
        if at + size < len(text):
            near = max((m.end() for m in _END.finditer(text, at, at + size)), default=None)
            far = _END.search(text, at + size, at + most_size) if near is None else None
            if near is None and far is None:
                break
            end = near if near is not None else far.end()
        if not text[at:end].isspace():
            out.append((at, end))
        at = end
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def passages(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": a, "end": b} for a, b in spans(t or "")])
