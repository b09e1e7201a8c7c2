"""Words and word shingles of whole Arrow batches as 64-bit hashes, in numpy.

A word is a maximal run of bytes that are no separators, after A-Z are
lower-cased; every separator is one ASCII byte, so UTF-8 text can be cut as
bytes. Hashes stand for words and shingles. A word's is the sum of its bytes,
each times a 64-bit coefficient of its place in the word (multilinear hashing,
coefficients from a seed), then mixed: two words that differ meet with a chance
of 2^-57 at most over the seeds, whatever the words.

A long text is cut piece by piece, so memory grows by the 8 bytes of each
word's hash, not by what cutting a byte takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SHINGLE = 5
SLICE_BYTES = 1 << 19
PART_ROWS = 1_000
SEED = 0x9E3779B97F4A7C15
_ROW = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True where a byte ends a word.
SPACE_CUTS = np.zeros(256, bool)
SPACE_CUTS[[32, 9, 10, 11, 12, 13]] = True
ALNUM_CUTS = np.zeros(256, bool)
ALNUM_CUTS[:128] = True
ALNUM_CUTS[[*range(48, 58), *range(97, 123)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Word hashes of some rows: those of row i are hashes[first[i]:first[i + 1]]."""

    rows: slice
    hashes: np.ndarray
    first: np.ndarray

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


class _Places:
    """The coefficients of the places of a word, made as far as the longest word needs."""

    def __init__(self):
        self.values = np.zeros(0, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            with np.errstate(over="ignore"):
                self.values = mix(np.arange(1, max(n, 256) + 1, dtype=np.uint64) * np.uint64(SEED))
        return self.values


_places = _Places()


def parts(batches, rows: int = PART_ROWS):
    """Record batches in parts of some rows, so that what is made of each stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def cut(texts: pa.Array | pa.ChunkedArray, cuts: np.ndarray) -> Iterator[Words]:
    """Words of the rows, some MB of text at a time; a null has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1)
        if to == at + 1 and ends[to] - ends[at] > SLICE_BYTES:
            found = [_cut(x, np.array([0, len(x)]), slice(at, to), cuts).hashes for x in _pieces(data[ends[at] : ends[to]], cuts)]
            yield Words(slice(at, to), np.concatenate(found), np.array([0, sum(map(len, found))]))
        else:
            yield _cut(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at], slice(at, to), cuts)
        at = to


def _pieces(raw: np.ndarray, cuts: np.ndarray) -> Iterator[np.ndarray]:
    """The bytes of one text in pieces of about SLICE_BYTES that end before a separator; a longer word is one piece."""
    at, n = 0, len(raw)
    while at < n:
        to = min(at + SLICE_BYTES, n)
        while to < n and not cuts[LOWER[raw[to]]]:
            more = np.flatnonzero(cuts[LOWER[raw[to : to + SLICE_BYTES]]])
            to = to + int(more[0]) if len(more) else min(to + SLICE_BYTES, n)
        yield raw[at:to]
        at = to


def _cut(raw: np.ndarray, ends: np.ndarray, rows: slice, cuts: np.ndarray) -> Words:
    size = len(raw)
    if not size:
        return Words(rows, np.zeros(0, np.uint64), np.zeros(len(ends), np.int64))
    low = LOWER[raw]
    inside = ~cuts[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = ends[:-1][ends[:-1] < size]
    begins[edge] = inside[edge]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = ends[1:][ends[1:] > 0] - 1
    stops[last] = inside[last]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    length = stop - start
    if not len(start):
        return Words(rows, np.zeros(0, np.uint64), np.zeros(len(ends), np.int64))
    word = np.flatnonzero(inside)
    first = np.cumsum(length) - length
    place = np.arange(len(word)) - np.repeat(first, length)
    total = np.add.reduceat((low[word].astype(np.uint64) + np.uint64(1)) * _places.upto(int(length.max()))[place], first)
    hashes = mix(total + length.astype(np.uint64))
    return Words(rows, hashes, np.searchsorted(start, ends))


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position (the last k - 1 positions are left out)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total += hashes[i : n + i] * _ROW[i]
    return mix(total)


def shingle_sets(texts, k: int = SHINGLE, cuts: np.ndarray = SPACE_CUTS) -> Iterator[tuple[int, np.ndarray]]:
    """For each row its number and its sorted distinct k-word shingles; fewer words make one shingle, none an empty set."""
    none = np.zeros(0, np.uint64)
    for w in cut(texts, cuts):
        every = rolled(w.hashes, k)
        for i in range(len(w.first) - 1):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= k:
                yield w.rows.start + i, np.unique(every[a : b - k + 1])
            else:
                yield w.rows.start + i, rolled(w.hashes[a:b], b - a) if b > a else none
