"""Words and word shingles of texts, as numpy hashes."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHORT = np.uint64(0x5851F42D4C957F2D)
_DOWN = np.uint64(32)


class WordHashes(dict):
    """64-bit hashes of words, the same in every process; remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 400_000:
            self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _DOWN)) * _MIX
    x = (x ^ (x >> _DOWN)) * _MIX
    return x ^ (x >> _DOWN)


def word_hashes(text: str | None, memory: WordHashes) -> np.ndarray:
    """Hashes of the words of a text in order: runs without ASCII white space, with A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(memory.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(text: str | None, memory: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of the whole sequence where there are fewer words."""
    words = word_hashes(text, memory)
    if not len(words):
        return words
    n = max(1, len(words) - WORDS + 1)
    x = np.full(n, min(len(words), WORDS), dtype=np.uint64) * _SHORT
    for k in range(min(WORDS, len(words))):
        x = (x + words[k : k + n]) * _STEP
        x ^= x >> _DOWN
    return np.unique(mixed(x))


_BYTE_STEP = 0x9E3779B97F4A7C15
#: What a byte adds to a sum: its value plus one, with A-Z lower-cased.
_VALUES = np.arange(1, 257, dtype=np.uint64)
_VALUES[65:91] += np.uint64(32)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64, from 0 to n at least."""
    if len(_POWERS.get("up", ())) <= n:
        size = 1 << max(20, (n + 1).bit_length())
        for name, step in (("up", _BYTE_STEP), ("down", pow(_BYTE_STEP, -1, 1 << 64))):
            steps = np.full(size, step, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def hashed_words(text: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text, A-Z lower-cased, and the number of the line that each is in.

    Without a step for each word: a word's hash is the difference of two prefix sums of a polynomial in its bytes.
    """
    raw = np.frombuffer(text, dtype=np.uint8)
    space = np.ones(len(raw) + 2, dtype=bool)
    np.take(_SPACE, raw, out=space[1:-1], mode="clip")
    turns = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turns[::2], turns[1::2]
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    values = _VALUES[raw]
    values *= up[: len(raw)]
    np.cumsum(values, out=sums[1:])
    # the words before each line feed, which are fewer searches than the feeds before each word
    before = np.concatenate(([0], np.searchsorted(starts, np.flatnonzero(raw == 10)), [len(starts)]))
    return mixed((sums[ends] - sums[starts]) * down[starts]), np.repeat(np.arange(len(before) - 1), np.diff(before))
