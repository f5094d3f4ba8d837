"""Vectorised text primitives over Arrow string columns.

A word is a maximal run of ASCII letters, digits and bytes of non-ASCII characters in the
lower-cased text. Words get 64-bit hashes without being cut out: a polynomial prefix sum over
the bytes of a whole chunk, so that the cost is a few numpy passes per byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_pow: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    if not _pow or len(_pow[0]) <= n:
        size = max(n + 1, CHUNK_BYTES * 2)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _pow[:] = out
    return _pow[0], _pow[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads every bit over all 64."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def raw(arr: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and where each text starts; null is the empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if lower:
        arr = pc.utf8_lower(arr)
    _, offsets, data = arr.buffers()
    if not len(arr) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def word_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte + 1 of each word in the text as it stands; the same words as Words has."""
    data = np.frombuffer(text.encode(), np.uint8)
    is_word = np.concatenate([[False], _WORD[data | ((data >= 65) & (data <= 90)) * np.uint8(32)], [False]])
    change = np.flatnonzero(is_word[1:] != is_word[:-1])
    return change[::2], change[1::2]


class Words:
    """hash: 64 bits a word; off: the first word of each text, and the number of all; start, end: bytes."""

    def __init__(self, arr: pa.Array):
        data, self.bytes_off = raw(arr)
        self.data = data
        n = len(data)
        is_word = np.zeros(n + 1, bool)
        is_word[:n] = _WORD[data]
        first, last = is_word[:n].copy(), is_word[:n].copy()
        first[1:] &= ~is_word[: n - 1]
        last &= ~is_word[1:]
        inner = self.bytes_off[1:-1]
        inner = inner[(inner > 0) & (inner < n)]  # texts don't run into each other
        first[inner] = is_word[inner]
        last[inner - 1] = is_word[inner - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        p, self._inv = powers(n)
        self._total = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * p[:n], out=self._total[1:])
        self.hash = self.hashes(self.start, self.end)
        self.off = np.searchsorted(self.start, self.bytes_off)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes between."""
        return mix((self._total[end] - self._total[start]) * self._inv[start])

    def __len__(self) -> int:
        return len(self.off) - 1

    def count(self) -> np.ndarray:
        return np.diff(self.off)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), self.count())

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether these are all in its text."""
        n = len(self.hash)
        out = np.zeros(n, U)
        for j in range(k):
            out[: max(n - j, 0)] += self.hash[j:] * U((_BASE * (2 * j + 3)) % (1 << 64) | 1)
        whole = np.repeat(self.off[1:], self.count()) - np.arange(n) >= k
        return mix(out), whole


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by bytes of text: each has at most that many, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(sizes)])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(total, total[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for every i in turn."""
    total = np.cumsum(counts)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(starts - (total - counts), counts)


_LANES = np.zeros(256, U)
for _b in range(256):
    _LANES[_b] = sum(1 << (8 * _i) for _i in range(8) if _b >> _i & 1)


def bit_counts(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each group hashes[off[i]:off[i+1]], how many have each of the 64 bits set."""
    groups, out = len(off) - 1, np.zeros((len(off) - 1, 64), np.int64)
    sizes = np.diff(off)
    if not groups or not len(hashes):
        return out
    parts = -(-sizes // 255)  # a lane holds up to 255
    owner = np.repeat(np.arange(groups), parts)
    if not len(owner):
        return out
    cuts = off[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    columns = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    upto = int(off[-1])
    for j in range(8):
        lanes = np.add.reduceat(_LANES[columns[:upto, j]], cuts)
        split = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[owner[first], 8 * j : 8 * j + 8] = np.add.reduceat(split, first, axis=0)
    return out


def simhash(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each group: a bit is set where more than half of the hashes have it."""
    bits = 2 * bit_counts(hashes, off) > np.diff(off)[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(U).ravel()
