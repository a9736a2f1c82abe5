"""Vectorised words, word hashes and shingle hashes over Arrow string batches.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  The separators
are ASCII, so splitting the UTF-8 buffer splits the text exactly.  A word's
hash is a polynomial over a random byte table taken modulo 2**64 and then
mixed; all words of a slice of rows come from one prefix sum, without a Python
loop over words.  Hashes have 64 bits: two different sequences are taken for
equal with a probability of about 2**-64 per compared pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled in one vectorised step (a longer text is one step).
STEP_BYTES = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_COEF = _rng.integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slice:
    """Words of consecutive rows: byte positions in ``data``, hashes, and where each row's words begin."""

    def __init__(self, first_row: int, data: np.ndarray, row_ends: np.ndarray, lower: bool):
        self.first_row, self.data, self.row_ends = first_row, data, row_ends
        sep = _SEP[data]
        # A row's end also ends a word.
        inside = ~sep
        cut = np.zeros(len(data) + 1, bool)
        cut[row_ends] = True
        prev = np.concatenate(([False], inside[:-1]))
        begin = inside & (~prev | cut[:-1])
        after = np.concatenate((inside[1:], [False]))
        end = inside & (~after | cut[1:])
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(end) + 1
        power, inverse = _grown(len(data) + 1)
        table = _BYTE_LOWER if lower else _BYTE
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * power[: len(data)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))
        # row i has words word_at[i]:word_at[i + 1]
        self.word_at = np.concatenate(([0], np.searchsorted(self.start, row_ends)))

    @property
    def n_rows(self) -> int:
        return len(self.row_ends)


def slices(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[Slice]:
    """Walk a string array in steps of about STEP_BYTES; nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    n = len(texts)
    if n == 0:
        return
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    whole = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, "right")) - 1
        to = min(max(to, at + 1), n)
        yield Slice(at, whole[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at], lower)
        at = to


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, by the position of the first."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _COEF[0]
    for i in range(1, k):
        out += hashes[i : i + n] * _COEF[i]
    return mix(out + np.uint64(k))


def spans_hash(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of word sequences of any length, given by start and length."""
    power, inverse = _grown(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=total[1:])
    return mix((total[starts + lengths] - total[starts]) * inverse[starts] + lengths.astype(np.uint64) * _COEF[1])


def shingle_sets(texts: pa.Array | pa.ChunkedArray, k: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles, letters A-Z lowered; a shorter text is one shingle, a text without words none."""
    for part in slices(texts, lower=True):
        every = windows(part.hash, k)
        at = part.word_at
        for i in range(part.n_rows):
            a, b = at[i], at[i + 1]
            if b - a >= k:
                yield np.unique(every[a : b - k + 1])
            elif b > a:
                yield mix((part.hash[a:b] * _COEF[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(1000 + b - a))
            else:
                yield np.zeros(0, np.uint64)
