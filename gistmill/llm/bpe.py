"""BPE encoding and decoding by tree concatenation.

A text is cut at white space and by the vocabulary's split pattern into pieces.  A
piece of ordinary length is encoded once per worker and remembered.  A long unsplit
piece is halved down to leaves, the leaves are encoded on a thread pool, and
neighbours are concatenated pairwise up the tree: the tokens around each join are
encoded again in a window that doubles until its first token is one that the left
half also has there, and one of its later tokens is one that the right half also has
there.  Every pair of adjacent tokens of the result is then one that an encoding of
the library holds, which makes the concatenation the library's own encoding.

Defined results: null text counts as empty; an empty text has no ids and decodes to
an empty string; special-token strings inside a text are the special tokens, as in
the library with its defaults; repeated rows are encoded each on their own, also where they share a doc_id or have none; texts of any length
are encoded whole; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from concurrent.futures import ThreadPoolExecutor
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces up to this many byte characters are encoded whole.
LEAF = 1024
#: Pieces, and runs without white space, remembered by a worker; the common ones come first, so later ones are encoded anew.
REMEMBERED = 400_000

_LATIN = "À-ÖØ-öø-ÿ"
#: Texts of these characters are in NFC and split alike in every Unicode version.
_PLAIN = re.compile(f"[\\t-\\r -~{_LATIN}]*")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^\\t-\\r a-z{_LATIN}0-9]+")
_CONTROL = re.compile(r"<\|(?:startoftext|endoftext)\|>")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = [""] * 256, 0
    for b in range(256):
        if b in own:
            table[b] = chr(b)
        else:
            table[b] = chr(256 + n)
            n += 1
    return table


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, dtype=np.uint32)


class Encoder:
    """One vocabulary, with the pieces that this process has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.strings = [self.library.id_to_token(i) or "" for i in range(size)]
        self.lengths = [len(x.removesuffix("</w>")) for x in self.strings]
        self.alphabet = _byte_alphabet()
        self.pieces = _Remembered(self._piece)
        self.chunks = _Remembered(self._chunk)

    def _tokens(self, symbols: str) -> list[int]:
        return [t.id for t in self.model.tokenize(symbols)]

    def _piece(self, piece: str) -> bytes:
        """The ids of one piece that the split pattern leaves whole."""
        symbols = piece if piece.isascii() else "".join(map(self.alphabet.__getitem__, piece.encode()))
        return packed(self._tokens(symbols) if len(symbols) <= LEAF else self.tree(symbols))

    def tree(self, symbols: str, leaf: int = LEAF) -> list[int]:
        """Encode one long piece: leaves in parallel, then pairwise concatenation."""
        cuts = [symbols[i : i + leaf] for i in range(0, len(symbols), leaf)]
        with ThreadPoolExecutor(4) as pool:
            level = [*zip(cuts, pool.map(self._tokens, cuts), strict=True)]
        while len(level) > 1:
            level = [self._joined(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0][1]

    def _joined(self, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
        (a, x), (b, y) = left, right
        width = 8
        while True:
            i, j = max(0, len(x) - width), min(len(y), width)
            back = sum(map(self.lengths.__getitem__, x[i:]))
            ahead = sum(map(self.lengths.__getitem__, y[:j]))
            middle = self._tokens(a[len(a) - back :] + b[:ahead])
            if i == 0 or middle[0] == x[i]:
                if j == len(y):
                    return a + b, x[:i] + middle
                starts, at = {}, 0
                for p, token in enumerate(y[:j]):
                    starts[at] = (p, token)
                    at += self.lengths[token]
                at = -back
                agreed = None
                for q, token in enumerate(middle[:-1]):  # the last one carries the end of a word
                    if at in starts and starts[at][1] == token:
                        agreed = (q, starts[at][0])
                    at += self.lengths[token]
                if agreed:
                    return a + b, x[:i] + middle[: agreed[0]] + y[agreed[1] :]
            width *= 2

    def _chunk(self, raw: bytes) -> bytes:
        """The ids of one run without ASCII white space; no token of the vocabulary spans such white space."""
        if raw.isalpha():  # of bytes: A-Z and a-z only, which the split pattern leaves whole
            return self._piece(raw.lower().decode())
        chunk = raw.decode()
        if _PLAIN.fullmatch(chunk) and not ("<|" in chunk and _CONTROL.search(chunk)):
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(chunk.lower())))
        if len(chunk) <= LEAF:
            return packed(self.library.encode(chunk, add_special_tokens=False).ids)
        ids: list[int] = []
        at = 0
        for m in chain(_CONTROL.finditer(chunk), [None]):
            part = self.library.normalizer.normalize_str(chunk[at : m.start() if m else len(chunk)])
            for symbols, _ in self.library.pre_tokenizer.pre_tokenize_str(part):
                ids += self._tokens(symbols) if len(symbols) <= LEAF else self.tree(symbols)
            if m:
                ids.append(self.library.token_to_id(m[0]))
                at = m.end()
        return packed(ids)

    def encoded(self, text: str | None) -> bytes:
        """The ids of a text, four bytes each."""
        return b"".join(map(self.chunks.__getitem__, (text or "").encode().split()))

    def encode(self, text: str | None) -> list[int]:
        return unpacked(self.encoded(text)).tolist()

    def decode(self, ids) -> str:
        """As the library's decode without a decoder: token strings with one space between."""
        return " ".join(map(self.strings.__getitem__, ids))


class _Remembered(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < REMEMBERED:
            self[key] = value
        return value


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, ids array<int>, n_tokens, ids_sha256, decoded_sha256.

    No shuffle: rows stay where they were read.  ``with_ids=False`` leaves the arrays out.
    """
    path = path or vocabulary_path()
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        own = encoder(path)
        digits = [str(i) for i in range(len(own.strings))]
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                ids = own.encode(text)
                rows[0].append(len(ids))
                rows[1].append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                rows[2].append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                if with_ids:
                    rows[3].append(np.array(ids, dtype=np.int32))
            columns = [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(rows[3], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return source.mapInArrow(run, schema)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, text.  Null ids count as none; ids outside the vocabulary are left out, as in the library."""
    path = path or vocabulary_path()

    def run(batches):
        own = encoder(path)
        for batch in batches:
            texts = [own.decode([i for i in ids or [] if i is not None and 0 <= i < len(own.strings)]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
