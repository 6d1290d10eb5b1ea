"""Words, windows and their hashes over Arrow text columns, a few array passes for each byte and no loop over words.

A slice of documents is one byte buffer with offsets. Words are maximal runs of
bytes other than ASCII white space, so they are those of ``[^\\x20\\x09-\\x0D]+``.
A slice's distinct words are told apart by their bytes, and each one's digest is
a seeded 128-bit hash (XXH3), as two lanes of 64 bits. Windows of words hash by halves: two
neighbours' hashes are joined by multiplications with shifts between them, so no sum
of powers can cancel out. One lane is enough where a hit is verified or counts within
a pair; what decides by itself takes both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from xxhash import xxh3_128_digest

#: Bytes of text that are worked on at a time (a longer document is one slice).
SLICE_BYTES = 2 << 20
#: The key of all word digests.
SEED = 0x5851F42D4C957F2D

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multipliers, two for each lane.
_JOIN = ((U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)), (U64(0xC2B2AE3D27D4EB4F), U64(0xFF51AFD7ED558CCD)))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def join(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """The hash of a sequence from those of its two parts."""
    one, two = _JOIN[lane]
    h = (a ^ (a >> U64(29))) * one + b
    h = (h ^ (h >> U64(32))) * two
    return h ^ (h >> U64(29))


def digest(word: bytes) -> bytes:
    """128 bits of a word."""
    return xxh3_128_digest(word, SEED)


@dataclass
class Words:
    """starts, ends: bytes of each word; first: each document's first word, and the number of words at the end."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        """Each word's document, by place in the slice."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def distinct(self, lower: bool = False) -> tuple[list[bytes], np.ndarray]:
        """The distinct words, and the place of each word among them."""
        steps = np.zeros(len(self.data) + 1, np.int8)
        steps[self.starts] += 1
        steps[self.ends] -= 1
        packed = self.data[np.cumsum(steps[:-1], dtype=np.int8).view(bool)]
        if lower:
            packed = _LOWER[packed]
        sizes = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        wide = len(packed) >= 1 << 31
        column = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(self.starts), [None, pa.py_buffer(sizes.astype(np.int64 if wide else np.int32)), pa.py_buffer(packed)])
        found = column.dictionary_encode()
        data, at = buffers(found.dictionary)
        raw, at = data.tobytes(), at.tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], found.indices.to_numpy(zero_copy_only=False)

    def digests(self, lower: bool = False) -> np.ndarray:
        """Both lanes of each word's digest: two rows."""
        words, at = self.distinct(lower)
        table = np.frombuffer(b"".join(map(digest, words)), U64).reshape(-1, 2)
        return np.ascontiguousarray(table[at].T)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return self.digests(lower)[0]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offset, data = column.buffers()
    if len(column) == 0 or offset is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offset, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES, columns: tuple[str, ...] = ("text",)) -> Iterator[pa.RecordBatch]:
    """The batches' rows in runs with at most limit bytes in the columns, or of one row."""
    for batch in batches:
        at = sum(buffers(batch.column(c))[1] for c in columns)
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def split_words(column: pa.Array, between: np.ndarray = _SPACE) -> Words:
    """The words of a text column; between: for each byte value, whether it stands between words."""
    data, offsets = buffers(column)
    solid = ~between[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True  # a document's end ends its last word
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


class Windows:
    """Hashes of any windows of consecutive words, from those of the windows of 1, 2, 4, ... words."""

    def __init__(self, hashes: np.ndarray, lane: int = 0):
        self.lane, self.levels = lane, [hashes]

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(join(last[:-half], last[half:], self.lane) if len(last) > half else np.zeros(0, U64))
        return self.levels[k]

    def __call__(self, starts: np.ndarray, length) -> np.ndarray:
        """Of the windows of length words (a number, or one for each start)."""
        if np.ndim(length):
            out = np.zeros(len(starts), U64)
            for n in np.unique(length).tolist():
                own = length == n
                out[own] = self(starts[own], n)
            return out
        h, at = None, starts
        for k in reversed(range(int(length).bit_length())):
            if length >> k & 1:
                part = self._level(k)[at]
                h = part if h is None else join(h, part, self.lane)
                at = at + (1 << k)
        return mix(h + U64(length)) if h is not None else np.zeros(len(starts), U64)


def window_starts(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The word each full window starts at, and each document's number of windows."""
    n = np.maximum(words.counts - length + 1, 0)
    return ranges(words.first[:-1], n), n


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then starts[1], ..."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return base + np.arange(total)


def shingles(words: Words, windows: Windows, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the shingles, document by document, and each document's first one (with the total at the end).

    A document with fewer words than length has one shingle, its whole sequence; one without words has none.
    """
    starts, size, first = shingle_places(words, length)
    return windows(starts, size), first


def shingle_places(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and number of words of each shingle, and each document's first shingle (with the total at the end)."""
    n = np.where(words.counts >= length, words.counts - length + 1, np.minimum(words.counts, 1))
    return ranges(words.first[:-1], n), np.repeat(np.minimum(words.counts, length), n), np.concatenate([[0], np.cumsum(n)])


def long_column(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's long."""
    return pa.array(values.view(np.int64) if values.dtype == U64 else values.astype(np.int64))


def ragged(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column from the flat values and each list's length."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
