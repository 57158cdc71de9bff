"""Whole columns of texts as byte arrays: words, their 64-bit hashes and shingles without a Python loop over words.

Texts are taken in chunks of about CHUNK bytes (a longer text is a chunk of its own), so memory
follows the chunk and the longest text, not the Arrow batch. A word's hash is multilinear: the sum
over its bytes of (byte + 1) times a random 64-bit number of the byte's place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
U = np.uint64

_BYTES = np.arange(256)
#: A-Z as a-z, all else as it is.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: What words are made of: all but blanks; or ASCII letters and digits and whatever isn't ASCII.
NOT_BLANK = ~np.isin(_BYTES, (9, 10, 11, 12, 13, 32))
ALNUM = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))

_places = np.empty(0, U)


def places(n: int) -> np.ndarray:
    """Random odd numbers of the first n places; the same in every process."""
    global _places
    if len(_places) < n:
        _places = np.random.default_rng(20240229).integers(0, 2**64, size=max(256, 2 * n), dtype=U) | U(1)
    return _places


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


@dataclass
class Texts:
    """Some whole texts: the bytes, and where each text starts (one more entry than texts)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Texts]:
    """A string column's texts, null as empty; first is the row of the first one."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield Texts(lo, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


@dataclass
class Words:
    starts: np.ndarray
    stops: np.ndarray
    counts: np.ndarray  # of words in each text
    hashes: np.ndarray

    @property
    def texts(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def words(texts: Texts, kind: np.ndarray = NOT_BLANK) -> Words:
    """The words of ASCII-lowered texts, in order."""
    data, n = LOWER[texts.data], len(texts.data)
    none = np.zeros(0, np.int64)
    if not n:
        return Words(none, none, np.zeros(len(texts), np.int64), np.zeros(0, U))
    inside = kind[data]
    edge = np.zeros(n + 1, bool)
    edge[texts.offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:n]
    starts, stops = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    counts = np.diff(np.searchsorted(starts, texts.offsets))
    if not len(starts):
        return Words(none, none, counts, np.zeros(0, U))
    length = stops - starts
    begin = np.cumsum(length) - length
    place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(begin, length)
    hashes = np.add.reduceat((data[inside].astype(U) + U(1)) * places(int(length.max()))[place], begin)
    return Words(starts, stops, counts, mix(hashes + length.astype(U) * U(0x9E3779B97F4A7C15)))


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of a text, in order, and how many each text has. A text of 1 to k - 1 words has one shingle of them all."""
    n = len(hashes)
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(n)  # words from here to the text's end
    full, short = left >= k, (np.repeat(counts, counts) < k) & (left == np.repeat(counts, counts))
    total = np.zeros(n, U)
    factor = np.random.default_rng(7).integers(0, 2**64, size=k, dtype=U) | U(1)
    for j in range(k):
        part = np.zeros(n, U)
        part[: max(0, n - j)] = hashes[j:] * factor[j]
        total += np.where(left > j, part, U(j + 1))
    keep = full | short
    return mix(total[keep]), np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
