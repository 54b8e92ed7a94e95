"""Word and shingle hashes over Arrow string columns, whole batches at a time in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes handled at once; a longer text is a segment of its own.
SEGMENT = 1 << 20
SPACE = bytes([0x20, *range(0x09, 0x0E)])


def fmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: a bijection that spreads every bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


class WordHasher:
    """Polynomial hashes modulo 2^64 of the words of a byte buffer.

    ``fold`` maps each byte before hashing, ``word`` says which bytes belong to words.
    """

    def __init__(self, fold: np.ndarray, word: np.ndarray):
        self.fold, self.word = fold, word
        self.table = fmix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))[fold]
        self.grow(SEGMENT)

    def grow(self, n: int) -> None:
        base = 0x2545F4914F6CDD1D
        both = np.empty((2, n + 1), U64)
        both[:, 0] = 1
        both[0, 1:], both[1, 1:] = U64(base), U64(pow(base, -1, 1 << 64))
        self.power, self.inverse = np.multiply.accumulate(both, axis=1)

    def words(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of all words, and for each text the index of its first word (one more at the end)."""
        if len(data) >= len(self.power):
            self.grow(len(data))
        inside = self.word[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        starts = np.flatnonzero(inside & (edge[:-1] | ~before))
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        ends = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=sums[1:])
        hashes = fmix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(U64))
        return starts, ends, hashes, np.searchsorted(starts, offsets)


def segments(offsets: np.ndarray, most: int = SEGMENT):
    """Ranges of texts of about ``most`` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, last
        first = last


def ascii_words() -> WordHasher:
    """Words between ASCII white space, A-Z folded to lower case."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    word = np.ones(256, bool)
    word[list(SPACE)] = False
    return WordHasher(fold, word)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` words in a row; fewer words count as one sequence of their own kind."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    out = np.full(n, size, U64)
    for i in range(size):
        out = fmix(out * U64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return out
