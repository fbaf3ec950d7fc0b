"""Order-preserving packing of token streams by dynamic programming.

The documents of a partition form one stream of ids, in the order in which they are
read; an end-of-document id closes each.  The stream is cut into windows of at most
``window`` ids.  Cuts fall at document ends, at sentence ends, or, where a sentence is
longer than that, inside it.  Chosen are the cuts with the least sum of padding and
truncation penalties: best(j) = min over i of best(i) + (window - (P[j] - P[i])) +
penalty(j), where P[j] is the position of boundary j.  As best(i) + P[i] does not depend on j, its minimum
over the sliding range P[i] >= P[j] - window comes from a monotone queue, and each
transition takes constant time on average.

What is left at the end of a stream goes into windows whose lengths are powers of two,
which need no padding.

No shuffle: a partition is packed where it is read, and memory is bounded by one batch
of documents, since windows are closed up as ``flush`` ids have been gathered.

Defined results: null text counts as empty, and an empty document is its end id alone;
a text longer than a window lies in several pieces; repeated rows are packed each on
their own, also where they share a doc_id or have none; further columns play no part; an empty table gives no pieces.  ``sequence_id`` is the number of the
partition times 2**40 plus a running number: it is unique, and depends on how the
table is partitioned, as does the packing.
"""

from __future__ import annotations

import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.bpe import encoder, packed, unpacked, vocabulary_path

WINDOW = 2048
END_ID = 1
#: Padding ids that a cut within a document, and one within a sentence, is worth avoiding.
SENTENCE_PENALTY, INNER_PENALTY = 16, 64

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(positions, penalties, window: int) -> list[int]:
    """The chosen boundaries: ``positions`` ascend from 0 by steps of at most ``window``; the last is always chosen."""
    n = len(positions)
    best, came = [0] * n, [0] * n
    queue: deque[int] = deque([0])
    for j in range(1, n):
        at = positions[j]
        while positions[queue[0]] < at - window:
            queue.popleft()
        i = queue[0]
        best[j] = best[i] + positions[i] - at + window + penalties[j]
        came[j] = i
        value = best[j] + at
        while queue and best[queue[-1]] + positions[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j:
        out.append(j)
        j = came[j]
    return out[::-1]


def boundaries(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """Positions and penalties of the places where a stream may be cut; ``ends`` are the documents' ends."""
    penalty = np.zeros(len(ids) + 1, dtype=np.int64)  # of each place, plus one; 0 where no boundary lies
    penalty[1:][sentence_end[ids]] = SENTENCE_PENALTY + 1
    penalty[ends] = penalty[0] = 1
    places = np.flatnonzero(penalty)
    wide = np.flatnonzero(np.diff(places) > window)
    if len(wide):
        inner = np.concatenate([np.arange(places[k] + window // 4, places[k + 1], window // 4) for k in wide])
        penalty[inner] = INNER_PENALTY + 1
        places = np.flatnonzero(penalty)
    return places.tolist(), (penalty[places] - 1).tolist()


def tail(length: int) -> list[int]:
    """Lengths, all powers of two, that sum up to ``length``."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


@lru_cache(4)
def sentence_ends(path: str) -> np.ndarray:
    """Whether the id is a piece that ends in a full stop, a question or an exclamation mark."""
    return np.array([x.endswith((".</w>", "!</w>", "?</w>")) for x in encoder(path).strings])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, end_id: int = END_ID, flush: int = 1 << 18) -> DataFrame:
    """One row per piece of a document, with its place in a sequence; columns as in SCHEMA."""
    path = path or vocabulary_path()

    def run(batches):
        own, stops, end = encoder(path), sentence_ends(path), packed([end_id])
        number = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # (doc_id, start, ids, doc_tokens) not yet in a closed window
        size = 0

        def close(last: bool):
            nonlocal held, size, number
            ids = np.concatenate([x[2] for x in held])
            ends = np.cumsum([len(x[2]) for x in held])
            places, penalties = boundaries(ids, ends, stops, window)
            chosen = [places[j] for j in cuts(places, penalties, window)]
            rest = chosen[-2] if len(chosen) > 1 else 0  # the last window is not full yet
            edges = chosen[:-1]
            if last:
                for k in tail(size - rest) if size - rest < window else [size - rest]:
                    edges.append((edges[-1] if edges else 0) + k)
                rest = size
            rows, kept, w, at = [], [], 0, 0
            for doc_id, start, own_ids, total in held:
                lo, hi = at, at + len(own_ids)
                while lo < hi and w < len(edges):
                    to = min(hi, edges[w])
                    piece = own_ids[lo - at : to - at]
                    rows.append((doc_id, start + lo - at, to - lo, zlib.crc32(piece.astype("<u4").tobytes()), total, number + w, lo - (edges[w - 1] if w else 0)))
                    lo = to
                    w += to == edges[w]
                if lo < hi:
                    kept.append((doc_id, start + lo - at, own_ids[lo - at :], total))
                at = hi
            number += len(edges)
            held, size = kept, size - rest
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = unpacked(own.encoded(text) + end)
                held.append((doc_id, 0, ids, len(ids)))
                size += len(ids)
                if size >= flush:
                    yield close(False)
        if held:
            yield close(True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
