"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier.

Sorting all suffixes of a corpus at once needs many times its size.  Here suffixes are
dealt into buckets, and one bucket after another is sorted.

1. Anchors.  The 24-byte string with the smallest hash within a 100-byte window is the
   window's anchor, so equal windows have equal anchors at equal offsets.  Neighbouring
   windows with one anchor form a run, about 35 windows each.  Only hashes of anchors and
   runs are shuffled.  Runs whose bytes equal an earlier run's are repeats as a whole (within a batch of
   documents they are set apart before the shuffle), and anchors that occur once end here.
2. Buckets.  Where runs with one anchor differ, their windows are dealt into buckets by
   62 or 63 bytes around the anchor that all of a bucket's windows hold.  A task takes its
   buckets in blocks of bounded size and finds equal windows by a difference cover modulo 13:
   cover positions of the block get ranks by sorting their 87-byte strings; a window
   starts within 13 bytes before a cover position for each residue that its pair may have, so two
   windows are equal if and only if their first 13 bytes, their last 13 bytes and the ranks at
   their common cover position are.  Long ties cost a comparison of ranks, never one of suffixes.
   A bucket with over ``HOT_ROWS`` rows is split first: rows with the same bytes are grouped, with partial sums before the
   shuffle, and the windows of one row of each group are dealt into smaller buckets by their first and last bytes.
3. Spans.  The windows found are merged for each document and cut out.

Defined results: null text counts as empty; texts under 100 bytes lose nothing; matches
never cross documents; strings are judged on the input; rows that repeat a doc_id are documents of their own, in the
order of a hash of their text; a row without doc_id is judged on its own text alone, and other rows are not held against
it; a text may have any length; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmill.lineage import written
from gistmill.llm.rows import KEY, keyed

LENGTH = 100
ANCHOR = 24
_SPAN = LENGTH - ANCHOR + 1
#: Windows whose anchor starts at most so many bytes after them share the bytes right of it, the others those left of it.
_RIGHT = (LENGTH - ANCHOR) // 2
#: A difference cover: every residue modulo PERIOD is a difference of two of COVER.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Bytes of window text in a block, and rows of a bucket that one task gathers at most.
BLOCK_BYTES, HOT_ROWS = 16 << 20, 50_000

#: Parts into which the rows of large buckets are dealt, and bytes at both ends of a window that deal it to a smaller bucket.
SALTS, _ENDS = 32, 18

_LOW = np.uint64((1 << 32) - 1)
_DOWN = np.uint64(32)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _DOWN)) * _MIX
    return x ^ (x >> _DOWN)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = 1
    while n * 2 <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: -(width - n)], x[width - n :]) if n < width else x


def runs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, start, number of windows, start of the anchor) of each run of windows."""
    n = len(text) - ANCHOR + 1
    h = np.zeros(n, dtype=np.uint64)
    for k, odd in enumerate(_ODD):
        h = _mixed(h + np.ndarray((n,), dtype="<u8", buffer=text, offset=8 * k, strides=(1,)) * odd)
    # the place below 32 bits of the hash: of equal hashes the leftmost is the least
    least = _least((h & ~_LOW) | np.arange(n, dtype=np.uint64), _SPAN)
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    counts = np.diff(np.concatenate((starts, [len(least)])))
    places = (least[starts] & _LOW).astype(np.int64)
    return h[places].view(np.int64), starts, counts, places


def _batch_runs(batch) -> tuple[np.ndarray, ...]:
    """anchor, content, doc_id, start, n, and whether an equal run of the batch comes earlier."""
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        raw = (text or "").encode()
        if len(raw) < LENGTH:
            continue
        anchors, starts, counts, _ = runs(raw)
        contents = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), (starts + counts + (LENGTH - 1)).tolist(), strict=True)]
        for part, x in zip(parts, (anchors, np.array(contents, dtype=np.uint64).view(np.int64), np.full(len(starts), doc_id), starts, counts), strict=True):
            part.append(x)
    anchor, content, doc, start, n = (np.concatenate(x) if x else np.array([], dtype=np.int64) for x in parts)
    order = np.lexsort((start, doc, content, anchor))
    anchor, content, doc, start, n = (x[order] for x in (anchor, content, doc, start, n))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else order
    later = same & ((doc != doc[head]) | (start != start[head])) if len(order) else same
    return anchor, content, doc, start, n, later


def _spans_of(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of a document merged."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    group = np.cumsum(first) - 1
    shift = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift) - shift
    new = first | np.concatenate(([True], start[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return doc[at], start[at], np.concatenate((reach[at[1:] - 1], reach[-1:]))


def _span_batch(doc, start, end):
    doc, start, end = _spans_of(doc, start, end)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "start", "end"])


SPANS = "doc_id long, start long, end long"


def run_table(texts: DataFrame) -> DataFrame:
    """anchor, content, doc_id, start, n of the runs that no equal run of their batch precedes."""

    def run(batches):
        for batch in batches:
            *columns, later = _batch_runs(batch)
            for i in range(0, len(later), 1 << 16):
                keep = ~later[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)][keep].astype(np.int64)) for x in columns], names=["anchor", "content", "doc_id", "start", "n"])

    return texts.mapInArrow(run, "anchor long, content long, doc_id long, start long, n long")


def spans_within_batches(texts: DataFrame) -> DataFrame:
    """Spans of the runs that ``run_table`` leaves out."""

    def run(batches):
        for batch in batches:
            _, _, doc, start, n, later = _batch_runs(batch)
            yield _span_batch(doc[later], start[later], (start + n + (LENGTH - 1))[later])

    return texts.mapInArrow(run, SPANS)


def ranks(text: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Rank of the string of ``length`` bytes at each place, equal for equal strings."""
    rows = np.lib.stride_tricks.as_strided(text, (len(text) - length + 1, length), (1, 1))[places]
    return np.unique(np.ascontiguousarray(rows).view(f"V{length}").ravel(), return_inverse=True)[1].reshape(-1)


def first_equal(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each window of LENGTH bytes, given in order of age, the number of the first equal one.

    By the difference cover: a pair of equal windows shares exactly one distance to positions
    in the cover unless their residues are equal, then all.
    """
    middle = LENGTH - PERIOD
    in_cover = np.isin(np.arange(PERIOD), COVER)
    reach = starts[None, :] + np.arange(PERIOD)[:, None]
    chosen = in_cover[reach % PERIOD]
    places, rank_at = np.unique(reach[chosen]), np.empty(len(text), dtype=np.int64)
    rank_at[places] = ranks(text, places, middle)
    most = int(rank_at[places].max()) + 1
    heads, tails = ranks(text, starts, PERIOD), ranks(text, starts + middle, PERIOD)
    ends = np.unique(heads * (int(tails.max()) + 1) + tails, return_inverse=True)[1].reshape(-1)
    first = np.arange(len(starts))
    for step in range(PERIOD):
        mine = np.flatnonzero(chosen[step])
        _, at, group = np.unique(ends[mine] * most + rank_at[starts[mine] + step], return_index=True, return_inverse=True)
        first[mine] = np.minimum(first[mine], mine[at][group.reshape(-1)])
    return first


def bucket_rows(requests: DataFrame, texts: DataFrame) -> DataFrame:
    """bucket, doc_id, start, n, text: the halves of the requested runs (doc_id, runs: array of start, n, place), with the bytes of their windows."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, asked, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode()
                anchors, starts, counts, places = runs(raw)
                wanted = np.isin(starts, asked)
                for anchor, s, n, p in zip(anchors[wanted].tolist(), starts[wanted].tolist(), counts[wanted].tolist(), places[wanted].tolist(), strict=True):
                    cut = max(s, min(s + n, p - _RIGHT))
                    for a, b, near in ((s, cut, raw[p - _RIGHT - 1 : p + ANCHOR]), (cut, s + n, raw[p : p + LENGTH - _RIGHT])):
                        if a < b:
                            for column, x in zip(out, (xxhash.xxh3_64_intdigest(near, seed=anchor & 0xFFFFFFFF) - (1 << 63), doc_id, a, b - a, raw[a : b + LENGTH - 1]), strict=True):
                                column.append(x)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            for i in range(0, len(out[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 20_000], t) for x, t in zip(out, types, strict=True)], names=["bucket", "doc_id", "start", "n", "text"])

    joined = texts.join(requests, "doc_id").select("doc_id", "starts", "text")
    return joined.mapInArrow(run, "bucket long, doc_id long, start long, n long, text binary")


def block_spans(rows: DataFrame) -> DataFrame:
    """Spans of repeated windows, bucket by bucket; a bucket lies within one partition, its rows side by side."""

    def found(parts: list):
        held = pa.Table.from_batches(parts)
        bucket = held.column(0).to_numpy()
        alone = np.ones(len(bucket), dtype=bool)
        alone[1:] &= bucket[1:] != bucket[:-1]
        alone[:-1] &= bucket[1:] != bucket[:-1]
        held = held.filter(pa.array(~alone))
        if not held.num_rows:
            return
        doc, start, n = (held.column(k).to_numpy() for k in (1, 2, 3))
        texts = held.column(4).to_pylist()
        sizes = np.array([len(x) for x in texts])
        text = np.frombuffer(b"".join(texts), dtype=np.uint8)
        offset = np.cumsum(sizes) - sizes
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        docs, starts, at = np.repeat(doc, n), np.repeat(start, n) + step, np.repeat(offset, n) + step
        order = np.lexsort((starts, docs))
        docs, starts, at = docs[order], starts[order], at[order]
        first = first_equal(text, at)
        later = (docs[first] != docs) | (starts[first] != starts)
        yield _span_batch(docs[later], starts[later], starts[later] + LENGTH)

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            # whole buckets: what has come before the last change of bucket can be sorted
            if size > BLOCK_BYTES:
                last = parts[-1].column(0)[-1].as_py()
                other = np.flatnonzero(ids != last)
                if len(other):
                    parts.append(batch.slice(0, int(other[0])))
                    yield from found(parts)
                    batch, parts, size = batch.slice(int(other[0])), [], 0
            parts.append(batch)
            size += batch.nbytes
        if parts:
            yield from found(parts)

    return rows.mapInArrow(run, SPANS)


def hot_spans(rows: DataFrame) -> DataFrame:
    """The same for buckets too large for a task: equal rows by their bytes, then the others' windows in smaller buckets."""

    def windows(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for bucket, doc_id, start, n, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for k in range(n):
                    window = text[k : k + LENGTH]
                    near = xxhash.xxh3_64_intdigest(window[:_ENDS] + window[-_ENDS:], seed=bucket & 0xFFFFFFFF) - (1 << 63)
                    for column, x in zip(out, (near, doc_id, start + k, 1, window), strict=True):
                        column.append(x)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            for i in range(0, len(out[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 20_000], t) for x, t in zip(out, types, strict=True)], names=["bucket", "doc_id", "start", "n", "text"])

    place = F.struct("doc_id", "start")
    first = written(rows.groupBy("bucket", "text").agg(F.min(place).alias("first"), F.first("n").alias("n")))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int").alias("salt")
    later = rows.select("*", salt).join(first.select("bucket", "text", "first", salts), ["bucket", "text", "salt"]).filter(place != F.col("first"))
    copies = later.select("doc_id", "start", (F.col("start") + F.col("n") + (LENGTH - 1)).alias("end"))
    dealt = first.select("bucket", "first.doc_id", "first.start", "n", "text").mapInArrow(windows, "bucket long, doc_id long, start long, n long, text binary")
    return copies.unionAll(block_spans(dealt.repartition("bucket").sortWithinPartitions("bucket")))


def repeated_spans(texts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, start, end: spans (they may overlap) of bytes to remove."""
    group = Window.partitionBy("anchor", "content").orderBy("doc_id", "start")
    anchor = Window.partitionBy("anchor")
    table = run_table(texts).repartition("anchor")
    table = table.withColumns({"first_doc": F.first("doc_id").over(group), "first_start": F.first("start").over(group), "nth": F.row_number().over(group)})
    table = table.withColumns({"rows": F.count("*").over(anchor), "contents": F.sum((F.col("nth") == 1).cast("int")).over(anchor)})
    known = written(table.filter("rows > 1").select("doc_id", "start", "n", ((F.col("doc_id") == F.col("first_doc")) & (F.col("start") == F.col("first_start"))).alias("first"), "nth", "contents"))
    copies = known.filter("NOT first").select("doc_id", "start", (F.col("start") + F.col("n") + (LENGTH - 1)).alias("end"))
    requests = known.filter("nth = 1 AND contents > 1").groupBy("doc_id").agg(F.collect_list("start").alias("starts"))
    rows = written(bucket_rows(requests, texts))
    hot = written(rows.groupBy("bucket").count().filter(F.col("count") > hot_rows).select("bucket"))
    ordinary = rows.join(hot, "bucket", "left_anti") if (some := bool(hot.head(1))) else rows
    spans = spans_within_batches(texts).unionAll(copies).unionAll(block_spans(ordinary.repartition("bucket").sortWithinPartitions("bucket")))
    return spans.unionAll(hot_spans(rows.join(hot, "bucket", "left_semi"))) if some else spans


def without(raw: bytes, spans: list | None) -> tuple[bytes, int]:
    """The bytes outside the spans (start, end), and the number of maximal spans."""
    kept, at, count = [], 0, 0
    for start, end in sorted((x["start"], x["end"]) for x in spans or []):
        if start > at or not count:
            kept.append(raw[at:start])
            count += 1
        at = max(at, end)
    return b"".join([*kept, raw[at:]]), count


def own_spans(raw: bytes) -> list[dict]:
    """Spans of windows that equal an earlier one of the same text."""
    if len(raw) < LENGTH:
        return []
    anchors, starts, counts, _ = runs(raw)
    _, group, often = np.unique(anchors, return_inverse=True, return_counts=True)
    again = often[group.reshape(-1)] > 1
    n = counts[again]
    at = np.repeat(starts[again] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    if not len(at):
        return []
    start = at[first_equal(np.frombuffer(raw, dtype=np.uint8), at) != np.arange(len(at))]
    _, start, end = _spans_of(np.zeros_like(start), start, start + LENGTH)
    return [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def _texts(rows: DataFrame, text_col: str) -> DataFrame:
    return rows.select(F.col(KEY).alias("doc_id"), F.col(text_col).alias("text"))


def _spans_by_document(texts: DataFrame, hot_rows: int) -> DataFrame:
    return repeated_spans(texts.filter("doc_id IS NOT NULL"), hot_rows).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The input's rows and columns, with repeated bytes gone from the texts; a null text stays null."""
    rows = keyed(docs, id_col, text_col)
    spans = _spans_by_document(_texts(rows, text_col), hot_rows).select(F.col("doc_id").alias(KEY), F.col("spans").alias("__spans"))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = []
            for text, spans, alone in zip(*(batch.column(i).to_pylist() for i in (at, batch.num_columns - 2, batch.num_columns - 1)), strict=True):
                spans = own_spans(text.encode()) if alone and text is not None else spans
                texts.append(text if text is None or not spans else without(text.encode(), spans)[0].decode(errors="ignore"))
            columns = [batch.column(i) for i in range(batch.num_columns - 2)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-2])

    joined = rows.join(spans, KEY, "left").select(*docs.columns, "__spans", F.col(KEY).isNull().alias("__alone"))
    return joined.mapInArrow(run, docs.schema)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the bytes kept, and kept_text.

    ``kept_text`` leaves out what a cut within a letter leaves of it.
    """
    rows = keyed(docs, id_col, text_col)
    spans = _spans_by_document(_texts(rows, text_col), hot_rows).select(F.col("doc_id").alias(KEY), "spans")
    own = F.col(id_col).cast("long").alias("doc_id")

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text, spans_of in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode()
                left, count = without(raw, own_spans(raw) if doc_id is None else spans_of)
                for column, x in zip(out, (len(raw), len(raw) - len(left), count, hashlib.sha256(left).hexdigest(), left.decode(errors="ignore")), strict=True):
                    column.append(x)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
            )

    judged = rows.select(KEY, own, F.col(text_col).alias("text")).join(spans, KEY, "left").select("doc_id", "text", "spans")
    return judged.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
