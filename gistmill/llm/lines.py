"""Line dedup by an exact set-similarity join.

A line's set holds its distinct words.  Two lines match if their sets have a Jaccard
similarity of at least ``SIMILAR`` / ``OF``; a line is removed if a line before it, in the same or
another document, matches it, whether or not that one is itself removed.

Words are ordered by rarity: those outside a table of the ``FREQUENT`` most frequent
words come first, by hash, then those of the table, from rare to frequent.  Any fixed
order gives exact results, so the table, which bounds what is broadcast, costs no match.
Similar lines share a word of their prefixes under that order; pairs are further held
against bounds from their lengths and from the positions of the shared word, and what is left is
verified on the full sets, after a last bound from 64 parity bits of each set.

Only whether some earlier line matches has to be known.  So a bucket of lines that share
a prefix word is first held against its earliest line, which settles families of many
near copies with one comparison each; only lines that this leaves open are compared
with the others before them.  Small buckets give their possible pairs at once.

Sets of fewer than ``LEAST_JOINED`` words match only equal sets: they have no prefix, and the groups of
equal sets settle them.

Sets are equal if two independent 64-bit sums over their words' 44-bit hashes are: of lines whose sets differ in one word,
one pair in 2**44 is taken for equal.  Similar sets are verified on the words themselves.

Defined results: lines are parts between line feeds; words are runs without ASCII white
space, A-Z lower-cased; every line with a word takes part, lines without words stay; order is
by doc_id, then line number; null texts have no lines; an empty text has one
empty line; rows that repeat a doc_id are documents of their own, in the order of a hash of their text; rows without doc_id
keep their lines; a text may have any number of lines; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.lineage import written
from gistmill.llm.rows import KEY, keyed
from gistmill.llm.shingles import hashed_words, mixed

SIMILAR, OF = 80, 100
#: Lines with a word take part.
LEAST_WORDS = 1
#: The fewest words of a set that a larger one can match: n of n + 1 words reach the similarity.
LEAST_JOINED = -(-SIMILAR // (OF - SIMILAR))
FREQUENT = 100_000
#: A batch of documents names its words that occur so often in it.
OFTEN = 8
#: Buckets of at most so many lines are paired side by side, those of at most so many by a matrix.
SMALL, MEDIUM = 64, 2048
#: Bytes of asked line numbers, or of buckets' first lines, that are broadcast at most; beyond that joins shuffle.
BROADCAST_BYTES, HUB_BYTES = 48 << 20, 80
#: Sets of more words have a second word of parity bits.
LONG = 72
#: Bytes of text, and lines, that are handled together; a line's number within them takes 20 bits.
CHUNK, CHUNK_LINES = 1 << 20, 1 << 19
_SHIFT, _BITS = np.uint64(20), np.uint64(44)
_HASH = np.uint64((1 << 44) - 1)
_SECOND = np.uint64(0x9FB21C651E98DF25)


def _chunks(batch, size: int = CHUNK):
    """Runs of lines of about ``size`` bytes, and CHUNK_LINES lines at most: bytes, and doc_id and number of each line.

    Texts come with a line feed at their end, so that Arrow's buffer of them is the lines of all documents as they stand.
    """
    text = batch.column(1)
    wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
    offsets = np.frombuffer(text.buffers()[1], dtype=wide)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    ends = np.flatnonzero(raw == 10)
    first = np.searchsorted(ends, offsets - offsets[0])
    lines = np.diff(first)
    docs, numbers = np.repeat(batch.column(0).to_numpy(), lines), np.arange(len(ends)) - np.repeat(first[:-1], lines)
    at = start = 0
    while at < len(ends):
        to = min(max(at + 1, int(np.searchsorted(ends, start + size))), at + CHUNK_LINES)
        yield raw[start : ends[to - 1]], docs[at:to], numbers[at:to]
        at, start = to, int(ends[to - 1]) + 1


def _fed(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", F.concat("text", F.lit("\n")))


def frequent_words(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids, sorted, and ranks (from 1, rising with frequency) of at most FREQUENT words."""

    def run(batches):
        for batch in batches:
            found = [hashed_words(raw)[0] >> _SHIFT for raw, _, _ in _chunks(batch, 1 << 17)]
            word, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.array([], dtype=np.uint64), np.array([], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(word[n >= OFTEN].view(np.int64)), pa.array(n[n >= OFTEN])], names=["word", "n"])

    top = _fed(texts).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT).toPandas()
    words = top["word"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], (len(top) - np.arange(len(top)))[order].astype(np.uint64)


class Ranks:
    """Ranks of the frequent words: those that share leading bits lie side by side, and are few."""

    def __init__(self, words: np.ndarray, rank_of: np.ndarray, bits: int = 20):
        self.words, self.rank_of, self.down = np.append(words, _HASH), np.append(rank_of, np.uint64(0)), _BITS - np.uint64(bits)
        self.first = np.searchsorted(words, np.arange((1 << bits) + 1, dtype=np.uint64) << self.down).astype(np.int32)

    def __getitem__(self, word: np.ndarray) -> np.ndarray:
        """The rank of each word; 0 for others."""
        slot = (word >> self.down).astype(np.int64)
        place = self.first[slot]
        found = np.where(self.words[place] == word, self.rank_of[place], np.uint64(0))
        left = np.flatnonzero((found == 0) & (place + 1 < self.first[slot + 1]))
        while len(left):
            place[left] += 1
            at = place[left]
            found[left] = np.where(self.words[at] == word[left], self.rank_of[at], np.uint64(0))
            left = left[(found[left] == 0) & (at + 1 < self.first[slot[left] + 1])]
        return found


def line_table(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, line, set_key, set_key_2, n, parity, parity_2, later, prefix: all lines with words.

    ``later`` marks lines whose set an earlier line of the same chunk has; the others carry their prefix, which is empty for
    sets that match only equal ones.
    ``parity`` and ``parity_2`` have 64 bits each, telling whether an odd number of the set's words hash to a bit: two sets
    differ in at least as many words as their bits differ.  Sets of at most LONG words leave the second at 0.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def table(ranks: Ranks, raw: np.ndarray, docs: np.ndarray, numbers: np.ndarray):
        word, line = hashed_words(raw)
        packed = np.sort((line.astype(np.uint64) << _BITS) | (word >> _SHIFT))
        packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))] if len(packed) else packed
        word, line = packed & _HASH, (packed >> _BITS).astype(np.int64)
        n = np.bincount(line, minlength=len(docs))
        keep = n >= LEAST_WORDS
        mine = keep[line]
        word, line = word[mine], (np.cumsum(keep) - 1)[line[mine]]
        docs, numbers, n = docs[keep], numbers[keep], n[keep]
        if not len(n):
            return
        at = np.cumsum(n) - n
        hashed = mixed(word)
        keys = np.add.reduceat(hashed, at).view(np.int64)
        keys_2 = np.add.reduceat((hashed ^ (hashed >> _SHIFT)) * _SECOND, at).view(np.int64)
        bit = np.uint64(1) << (hashed >> np.uint64(58))
        second = (hashed & np.uint64(1 << 40) != 0) & np.repeat(n > LONG, n)
        parity, parity_2 = (np.bitwise_xor.reduceat(np.where(mine, bit, np.uint64(0)), at).view(np.int64) for mine in (~second, second))
        order = np.lexsort((numbers, docs, keys_2, keys))
        later = np.zeros(len(n), dtype=bool)
        later[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (keys_2[order[1:]] == keys_2[order[:-1]])
        rank = ranks[word]
        # by line, rank and hash: words come in by hash, so the leading bits suffice for a stable sort
        word = word[np.argsort((line.astype(np.uint64) << np.uint64(40)) | (rank << np.uint64(20)) | (word >> np.uint64(24)), kind="stable")].view(np.int64)
        size = np.where(later | (n < LEAST_JOINED), 0, n - (n * SIMILAR + OF - 1) // OF + 1)
        inside = np.arange(len(word)) - np.repeat(at, n) < np.repeat(size, n)
        ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(word[inside]))
        columns = [pa.array(docs), pa.array(numbers), pa.array(keys), pa.array(keys_2), pa.array(n), pa.array(parity), pa.array(parity_2), pa.array(later), prefix]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line", "set_key", "set_key_2", "n", "parity", "parity_2", "later", "prefix"])

    def run(batches):
        ranks = Ranks(*shared.value)
        for batch in batches:
            for chunk in _chunks(batch):
                yield from table(ranks, *chunk)

    return _fed(texts).mapInArrow(run, "doc_id long, line long, set_key long, set_key_2 long, n long, parity long, parity_2 long, later boolean, prefix array<long>")


_POS = (1 << 32) - 1
_ROW = ["word", "n", "pos", "parity", "parity_2", "doc_id", "line"]


def _possible(x: list[np.ndarray], i, j) -> np.ndarray:
    """Whether rows i and j, which share a word, may match: by lengths, its positions, and the bits that tell words apart."""
    n, m = x[1][i], x[1][j]
    both = n + m
    first, second = x[3][i] ^ x[3][j], x[4][i] ^ x[4][j]
    # sets of which only one is long are told apart by all bits together
    split = (n > LONG) == (m > LONG)
    bits = np.where(split, np.bitwise_count(first.view(np.uint64)).astype(np.int64) + np.bitwise_count(second.view(np.uint64)), np.bitwise_count((first ^ second).view(np.uint64)))
    differ = bits * (OF + SIMILAR) <= both * (OF - SIMILAR)
    length = np.minimum(n, m) * OF >= np.maximum(n, m) * SIMILAR
    return differ & length & (np.minimum(n - x[2][i], m - x[2][j]) * (OF + SIMILAR) >= both * SIMILAR)


def bucket_pairs(rows: DataFrame) -> DataFrame:
    """Of rows (word, n << 32 | pos, parity, parity_2, doc_id, line) that come by word, doc_id and line: possible pairs of lines, and rows of buckets that may hold many.

    A pair has the later line's row, ``word`` null, and the earlier line as other_doc and other_line; ``nth`` is 0 for the
    earliest possible partner in a bucket.  A row of a large bucket stays as it is, if it has a possible partner there.
    """

    def emit(x: list[np.ndarray], at, other=None, nth=None):
        columns = [pa.array(c[at]) for c in x]
        if other is None:
            more = [pa.nulls(len(columns[0]), pa.int64())] * 3
        else:
            columns[0], more = pa.nulls(len(at), pa.int64()), [pa.array(x[5][other]), pa.array(x[6][other]), pa.array(nth)]
        return pa.RecordBatch.from_arrays([*columns, *more], names=[*_ROW, "other_doc", "other_line", "nth"])

    def small(x: list[np.ndarray]):
        """Pairs within buckets of at most SMALL rows."""
        later, earlier = [], []
        for gap in range(1, min(SMALL, len(x[0]))):
            same = np.flatnonzero(x[0][gap:] == x[0][:-gap])
            if not len(same):
                break
            same = same[_possible(x, same, same + gap)]
            earlier.append(same)
            later.append(same + gap)
        if not later:
            return
        a, b = np.concatenate(earlier), np.concatenate(later)
        order = np.lexsort((a, b))
        a, b = a[order], b[order]
        nth = np.concatenate(([0], (b[1:] == b[:-1]).astype(np.int64))) if len(b) else b
        for i in range(0, len(a), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield emit(x, b[part], a[part], nth[part])

    def settle(x: list[np.ndarray]):
        at = np.flatnonzero(np.concatenate(([True], x[0][1:] != x[0][:-1])))
        size = np.diff(np.concatenate((at, [len(x[0])])))
        for i, n in zip(at[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            mine = np.arange(i, i + n)
            if n <= MEDIUM:
                some = _possible(x, mine[:, None], mine[None, :])
                np.fill_diagonal(some, False)
                mine = mine[some.any(axis=1)]
            if len(mine):
                yield emit(x, mine)
        each = np.repeat(size, size)
        keep = (each > 1) & (each <= SMALL)
        if keep.any():
            yield from small([c[keep] for c in x])

    def run(batches):
        held, large = [], None
        waiting = 0
        for batch in batches:
            c = [batch.column(k).to_numpy() for k in range(len(_ROW) - 1)]
            x = [c[0], c[1] >> 32, c[1] & _POS, *c[2:]]
            if large is not None:  # more of a bucket that is known to be large
                more = x[0] == large
                if more.any():
                    yield emit(x, more)
                    x = [c[~more] for c in x]
                if len(x[0]):
                    large = None
            if not len(x[0]):
                continue
            held.append(x)
            waiting += len(x[0])
            if waiting < 1 << 16:
                continue
            x = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = x[0] == x[0][-1]
            if not last.all():
                yield from settle([c[~last] for c in x])
            x = [c[last] for c in x]
            held, waiting = [x], len(x[0])
            if waiting > MEDIUM:
                large = int(x[0][0])
                yield emit(x, slice(None))
                held, waiting = [], 0
        if waiting:
            yield from settle([np.concatenate(c) for c in zip(*held, strict=True)])

    return rows.mapInArrow(run, ", ".join(f"{x} long" for x in [*_ROW, "other_doc", "other_line", "nth"]))


def _reaches(x: str, y: str) -> F.Column:
    """The same bounds for structs x and y with n, pos and parity."""
    n, m, i, j = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    length = F.least(n, m) * OF >= F.greatest(n, m) * SIMILAR
    first = F.col(f"{x}.parity").bitwiseXOR(F.col(f"{y}.parity"))
    second = F.col(f"{x}.parity_2").bitwiseXOR(F.col(f"{y}.parity_2"))
    bits = F.when((n > LONG) == (m > LONG), F.bit_count(first) + F.bit_count(second)).otherwise(F.bit_count(first.bitwiseXOR(second)))
    differ = bits * (OF + SIMILAR) <= (n + m) * (OF - SIMILAR)
    return length & (F.least(n - i, m - j) * (OF + SIMILAR) >= (n + m) * SIMILAR) & differ


def _lines_of(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """at (doc_id, line), words: the text of each line that ``wanted`` names by doc_id and line."""
    asked = written(wanted.groupBy("doc_id").agg(F.collect_set("line").alias("lines")))
    weight = asked.agg(F.sum(F.size("lines") * 8 + 48).alias("bytes")).first().bytes or 0
    if weight <= BROADCAST_BYTES:
        asked = F.broadcast(asked)
    # a generator, so that the optimizer leaves a text to be split once
    parts = texts.join(asked, "doc_id").select("doc_id", "lines", F.explode(F.array(F.split("text", "\n", -1))).alias("parts"))
    each = parts.select("doc_id", F.explode(F.transform("lines", lambda k: F.struct(k.alias("line"), F.element_at("parts", (k + 1).cast("int")).alias("words")))).alias("x"))
    return each.select(F.struct("doc_id", "x.line").alias("at"), "x.words")


def _matching(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, line of the later lines of pairs (a, b) that match."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                keep = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    one, other = (set((z or "").encode().lower().split()) for z in (x, y))
                    both = len(one & other)
                    keep.append(OF * both >= SIMILAR * (len(one) + len(other) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["doc_id", "line"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: lines.select(F.col("at").alias(x), F.col("words").alias(f"words_{x}"))
    full = pairs.join(side("b"), "b").join(side("a"), "a").select("b.doc_id", "b.line", "words_a", "words_b")
    return full.mapInArrow(run, "doc_id long, line long").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, line of the later lines of distinct pairs (a, b) that match."""
    pairs = written(pairs)
    ends = pairs.select("a.doc_id", "a.line").unionAll(pairs.select("b.doc_id", "b.line"))
    return written(_matching(pairs, written(_lines_of(ends, texts))))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, removed (sorted array of line numbers from 0) for documents that lose lines."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    table = written(line_table(texts, frequent_words(texts)))
    place = F.struct("doc_id", "line")
    both = ["set_key", "set_key_2"]
    firsts = written(table.filter("NOT later").groupBy(*both).agg(F.min(place).alias("first")))
    again = table.filter("NOT later").select(*both, "doc_id", "line").join(firsts, both).filter(place != F.col("first")).select("doc_id", "line")

    # each set that others may resemble once, where it comes first
    heads = table.filter(f"NOT later AND n >= {LEAST_JOINED}").join(firsts.select("first.doc_id", "first.line"), ["doc_id", "line"], "left_semi")
    rows = heads.select("n", "parity", "parity_2", "doc_id", "line", F.posexplode("prefix").alias("pos", "word"))
    packed = F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("n_pos")  # one column less to shuffle and sort
    rows = rows.select("word", packed, "parity", "parity_2", "doc_id", "line").repartition("word").sortWithinPartitions("word", "doc_id", "line")
    found = written(bucket_pairs(rows))
    pairs = found.filter("word IS NULL").select("nth", F.struct(F.col("other_doc").alias("doc_id"), F.col("other_line").alias("line")).alias("a"), place.alias("b"))

    large = found.filter("word IS NOT NULL").select("word", F.struct("doc_id", "line", "n", "pos", "parity", "parity_2").alias("x"))
    hubs = written(large.groupBy("word").agg(F.min("x").alias("hub")))
    # where the buckets' first lines are few they are broadcast, so that a hot word's rows stay where they are; AQE splits them otherwise
    if hubs.count() * HUB_BYTES <= BROADCAST_BYTES:
        hubs = F.broadcast(hubs)
    large = written(large.join(hubs, "word").filter("x != hub"))
    spot = lambda x: F.struct(F.col(f"{x}.doc_id").alias("doc_id"), F.col(f"{x}.line").alias("line"))
    star = large.filter(_reaches("hub", "x")).select(spot("hub").alias("a"), spot("x").alias("b"))
    # one comparison for each line: with the earliest of its possible partners
    settled = _confirmed(pairs.filter("nth = 0").drop("nth").unionAll(star).groupBy("b").agg(F.min("a").alias("a")), texts)

    # lines that are still open: their other possible partners, in large buckets all lines before them
    done = settled.select(place.alias("b"))
    y = large.select("word", spot("x").alias("b"), F.col("x").alias("y")).join(done, "b", "left_anti")
    before = (spot("x") < F.col("b")) & _reaches("x", "y")
    among = y.join(large.select("word", "x"), "word").filter(before).select(spot("x").alias("a"), "b")
    rest = pairs.select("a", "b").unionAll(star).join(done, "b", "left_anti").select("a", "b")
    more = _confirmed(among.unionAll(rest).distinct(), texts)
    gone = table.filter("later").select("doc_id", "line").unionAll(again).unionAll(settled).unionAll(more)
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, removed (line numbers from 0)."""
    rows = keyed(docs, id_col, text_col)
    removed = removed_lines(rows, KEY, text_col).select(F.col("doc_id").alias(KEY), "removed")
    n_lines = F.greatest(F.coalesce(F.size(F.split(F.col(text_col), "\n", -1)), F.lit(0)), F.lit(0)).cast("long")
    counted = rows.select(KEY, F.col(id_col).cast("long").alias("doc_id"), n_lines.alias("n_lines"))
    out = counted.join(removed, KEY, "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<bigint>")))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, with the removed lines gone from the texts."""
    rows = keyed(docs, id_col, text_col)
    removed = removed_lines(rows, KEY, text_col).select(F.col("doc_id").alias("__doc"), F.col("removed").alias("__removed"))
    joined = rows.join(removed, rows[KEY] == F.col("__doc"), "left")
    some = F.when(F.col("__removed").isNotNull(), F.split(F.col(text_col), "\n", -1))
    joined = joined.select("*", F.explode(F.array(some)).alias("__parts"))  # a generator, so that a text is split once
    kept = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("__parts") - F.lit(1).cast("long")), F.col("__removed"))
    lines = F.transform(kept, lambda i: F.get("__parts", i.cast("int")))
    text = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(F.array_join(lines, "\n"))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
