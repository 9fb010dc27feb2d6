"""Word and shingle hashes of whole Arrow batches, without a Python object per word.

A word's hash is a polynomial over its bytes, taken from one running sum over a chunk of the batch, so the cost
is a few NumPy passes over the bytes. Hashes have 64 bits; a pair of sets of s shingles meets a false match with
a probability of about s * s / 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; a longer text is a chunk of its own.
CHUNK = 1 << 19

_U = np.uint64
_ODD = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all others (a bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _table() -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    codes[65:91] += _U(32)  # A-Z as a-z
    return mix(codes * _U(0x9E3779B97F4A7C15) + _U(0x632BE59BD9B4E019))


_BYTE = _table()
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]
#: Bytes of words for separators ``[\x20\x09-\x0D]``.
WORD = np.ones(256, bool)
WORD[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words for separators ``[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]``.
LETTER = np.ones(256, bool)
LETTER[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            grown = np.full(max(n, CHUNK), base, np.uint64)
            grown[0] = 1
            _powers[i] = np.multiply.accumulate(grown)
    return _powers[0][:n], _powers[1][:n]


def spans(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of a string column: index of the first row, its bytes, and the rows' offsets in them. Null is as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1)
        j = min(j, len(column))
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def bounds(data: np.ndarray, off: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word of a chunk, and the byte after its last. No word crosses from row to row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = table[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = off[1:][off[1:] > 0] - 1
    after[ends] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def sums(data: np.ndarray) -> np.ndarray:
    """Running sums of a chunk's bytes times powers of the base, from which ``span_hashes`` takes any span's hash."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(len(data))[0], out=total[1:])
    return total


def span_hashes(total: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix((total[last] - total[first]) * _power(len(total))[1][first] + (last - first).astype(np.uint64))


def word_hashes(data: np.ndarray, off: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a chunk, in order, and where each row's words begin (one entry more than rows)."""
    first, last = bounds(data, off, table)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    return span_hashes(sums(data), first, last), np.searchsorted(first, off, "left")


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    total = np.full(max(len(words) - n + 1, 0), n, np.uint64)
    for j in range(n if len(total) else 0):
        total ^= words[j : len(words) - n + 1 + j]
        total *= _ODD[j % len(_ODD)]
        total ^= total >> _U(32)
    return mix(total)


def shingle_hashes(words: np.ndarray, begins: np.ndarray, n: int) -> list[np.ndarray]:
    """For each row of a chunk the hashes of all its runs of n words; if it has fewer, but some, of its whole sequence."""
    runs = _runs(words, n)
    return [runs[a : b - n + 1] if b - a >= n else _runs(words[a:b], b - a) if b > a else words[:0] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    hashes = np.sort(hashes)
    return hashes[np.append(True, hashes[1:] != hashes[:-1])] if len(hashes) else hashes
