"""Language identification by n-gram filters with a bitmask of languages.

Texts are lower-cased and read as words: runs of letters and marks, with a boundary on each side.  The n-grams of ``SIZES`` characters of
the words, boundaries included, are counted for each language over all training documents.  An n-gram belongs to a language when it
makes up at least 1 / ``RARE`` of the language's n-grams of that size, and at least 1 / ``RATIO`` of the share that it has in
the language where it is most common; so a language has at most ``RARE`` n-grams of each size, however large the corpus.

The filter is a bit-sliced Bloom filter: each of its positions holds one bit for each language.  An n-gram has ``PROBES`` positions, and
the conjunction of their bitmasks gives all languages that contain it at once.  A text's n-grams are looked up and each
language's bits are counted.  A filter whose share of set bits is s answers yes for s^PROBES of the n-grams that it does not hold,
so of N lookups with c hits, (c - N s^PROBES) / (1 - s^PROBES) are expected to be true ones.  The language with most of them is
predicted; the score is its number over the sum of the best two.

Defined results: a null text, or one without letters, is ``UND`` with score 0, as is every text where no language was learned; a text whose
n-grams no language holds gets the language with most training n-grams, with score 0; ties go to the language with more training
n-grams, then to the lesser name.  Repeated rows count each, a repeated or null id is scored like any other; training rows without lang
teach nothing; a word of over ``PIECE`` characters is read as several.  An empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import unicodedata
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.lineage import written

FOLDS, HELD_OUT, UND = 3, 1, "und"
SIZES, RARE, RATIO = (1, 2, 3, 4, 5), 50_000, 16
#: Positions for each entry of the filter, and positions that an n-gram is looked up at.
ROOM, PROBES = 16, 4
#: Characters that are worked on at a time, and n-gram counts that a task holds before it hands them on.
PIECE, HOLD = 1 << 19, 1 << 21
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; rows of fold HELD_OUT teach nothing."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


@cache
def _kinds() -> np.ndarray:
    """For each code point: 2 for letters, 1 for marks, 0 else."""
    kinds = {"L": 2, "M": 1}
    return np.array([kinds.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], dtype=np.uint8)


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of lower-cased texts, each text ended by a line break, and the text of each; about PIECE characters at a time."""
    codes, owner, held = [], [], 0
    for k, text in enumerate(texts):
        if not text:
            continue
        whole = np.frombuffer((text.lower() + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = 0
        while at < len(whole):
            to = min(at + PIECE, len(whole))
            if to < len(whole):
                gap = np.flatnonzero(_kinds()[whole[at:to]] == 0)
                to = at + int(gap[-1]) + 1 if len(gap) else to
            codes.append(whole[at:to])
            owner.append(np.full(to - at, k))
            held += to - at
            at = to
            if held >= PIECE:
                yield np.concatenate(codes), np.concatenate(owner)
                codes, owner, held = [], [], 0
    if codes:
        yield np.concatenate(codes), np.concatenate(owner)


def grams(codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size: hashes of the n-grams within words, and the text of each."""
    inside = _kinds()[codes] > 0
    keep = inside | np.concatenate(([False], inside[:-1]))  # one boundary after each word
    codes, owner, inside = np.where(inside, codes, 0)[keep], owner[keep], inside[keep]
    if not len(codes):
        return
    # the boundary before the first word; later words begin at the one that ended the word before
    codes, owner, inside = (np.concatenate(([first], rest)) for first, rest in ((0, codes), (owner[0], owner), (False, inside)))
    codes = codes.astype(np.uint64) + np.uint64(1)
    sums, whole = np.zeros(len(codes), dtype=np.uint64), np.ones(len(codes), dtype=bool)
    for n in range(1, max(SIZES) + 1):
        to = len(codes) - n + 1
        if to <= 0:
            return
        sums = sums[:to] * _MIX[0] + codes[n - 1 :]
        # a boundary may be the first or the last character only, and not both or alone
        whole = whole[:to] & inside[n - 2 : n - 2 + to] if n > 2 else whole[:to]
        own = whole & (inside[:to] if n == 1 else inside[:to] | inside[1 : 1 + to] if n == 2 else True)
        if n in SIZES:
            at = np.flatnonzero(own)
            h = sums[at] + np.uint64(n)
            h = (h ^ (h >> np.uint64(30))) * _MIX[1]
            h = (h ^ (h >> np.uint64(27))) * _MIX[2]
            yield n, h ^ (h >> np.uint64(31)), owner[at + min(1, n - 1)]


def counts(docs: DataFrame) -> DataFrame:
    """lang, size, gram, n: how often documents of a language hold each n-gram; docs have lang and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, n), found in held.items():
                gram, times = _added(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(np.full(len(gram), n, dtype=np.int32)), pa.array(gram.view(np.int64)), pa.array(times)], names=["lang", "size", "gram", "n"])

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for start in range(0, batch.num_rows, 256):
                names, code = np.unique(langs[start : start + 256], return_inverse=True)
                for codes, owner in pieces(batch.column(1).slice(start, 256).to_pylist()):
                    for n, gram, text in grams(codes, owner):
                        for k in np.unique(code[text]):
                            new = np.unique(gram[code[text] == k], return_counts=True)
                            held.setdefault((names[k], n), []).append(new)
                            size += len(new[0])
                    if size > HOLD:
                        held = {key: [_added(found)] for key, found in held.items()}
                        size = sum(len(found[0][0]) for found in held.values())
                        if size > HOLD // 2:
                            yield from out()
                            held, size = {}, 0
        yield from out()

    found = docs.select("lang", "text").mapInArrow(run, "lang string, size int, gram long, n long")
    return found.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, where = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    times = np.zeros(len(gram), dtype=np.int64)
    np.add.at(times, where, np.concatenate([t for _, t in found]).astype(np.int64))
    return gram, times


@dataclass
class Filters:
    """Languages, best taught first, and for each position of the filter the languages whose bits are set, 64 to a column."""

    languages: list[str]
    bits: np.ndarray

    @classmethod
    def of(cls, languages: list[str], gram: np.ndarray, language: np.ndarray) -> Filters:
        """From pairs of an n-gram and the number of a language that it belongs to."""
        room = max(1024, ROOM * len(np.unique(gram)))
        columns = max(1, -(-len(languages) // 64))
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if columns > 1 or np.iinfo(k).bits >= len(languages))
        bits = np.zeros((columns, room), dtype=np.uint64 if columns > 1 else kind)
        own = cls(languages, bits)
        for at in own._positions(gram):
            np.bitwise_or.at(bits, (language // 64, at), (np.uint64(1) << (language % 64).astype(np.uint64)).astype(bits.dtype))
        return own

    def _positions(self, gram: np.ndarray) -> Iterator[np.ndarray]:
        step = (gram >> np.uint64(17)) | np.uint64(1)
        for i in range(PROBES):
            yield ((gram + np.uint64(i) * step) * _MIX[0] >> np.uint64(20)) % np.uint64(self.bits.shape[1])

    @property
    def false(self) -> np.ndarray:
        """For each language, the share of n-grams outside it that its filter answers yes for."""
        set_bits = [(self.bits[k // 64] >> self.bits.dtype.type(k % 64)) & self.bits.dtype.type(1) for k in range(len(self.languages))]
        return np.array([b.mean() for b in set_bits]) ** PROBES

    def hits(self, gram: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """How many of each text's n-grams each language's filter holds."""
        masks = None
        for at in self._positions(gram):
            found = self.bits[:, at.astype(np.int64)]
            masks = found if masks is None else masks & found
        one = self.bits.dtype.type(1)
        return np.stack([np.bincount(text, (masks[k // 64] >> self.bits.dtype.type(k % 64)) & one, minlength=texts) for k in range(len(self.languages))], axis=1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UND, 0.0)] * len(texts)
        hits, asked, false = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), self.false
        letters = np.zeros(len(texts), dtype=bool)
        for codes, owner in pieces(texts):
            letters[owner[_kinds()[codes] == 2]] = True
            for _, gram, text in grams(codes, owner):
                hits += self.hits(gram, text, len(texts))
                asked += np.bincount(text, minlength=len(texts))
        true = np.maximum(0.0, (hits - asked[:, None] * false) / np.maximum(1 - false, 1e-9))
        best = true.argmax(axis=1)
        top = -np.partition(-np.c_[true, np.zeros(len(texts))], 1, axis=1)[:, :2]
        score = top[:, 0] / np.maximum(top.sum(axis=1), 1e-300)
        return [(self.languages[k], float(s)) if has else (UND, 0.0) for k, s, has in zip(best, score, letters, strict=True)]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Filters:
    """Filters from all rows of docs that have a language."""
    docs = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    found = written(counts(docs))
    totals = written(found.groupBy("lang", "size").agg(F.sum("n").alias("total")))  # a row for each language and size
    order: dict[str, int] = {}
    for r in totals.collect():
        order[r.lang] = order.get(r.lang, 0) + r.total
    languages = sorted(order, key=lambda lang: (-order[lang], lang))
    if not languages:
        return Filters([], np.zeros((1, 1), dtype=np.uint8))
    shares = found.join(F.broadcast(totals), ["lang", "size"]).filter(F.col("n") * RARE >= F.col("total")).select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    most = F.max("share").alias("most")
    common = shares.groupBy("gram").agg(most, F.collect_list(F.struct("lang", "share")).alias("langs"))  # a language once
    kept = common.select("gram", F.explode("langs").alias("own"), "most").filter(F.col("own.share") * RATIO >= F.col("most"))
    # RARE n-grams at most for each size and language
    pairs = kept.select("gram", F.col("own.lang").alias("lang")).toPandas()
    number = {lang: k for k, lang in enumerate(languages)}
    return Filters.of(languages, pairs["gram"].to_numpy(dtype=np.int64).view(np.uint64), pairs["lang"].map(number).to_numpy(dtype=np.int64))


def predict(docs: DataFrame, model: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([lang for lang, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
