"""Words, word hashes and n-gram hashes of whole Arrow text columns, in numpy.

No Python object is made per word of up to LONG bytes. A word's 64-bit hash is a one-to-one mix of bytes and length up to EXACT
bytes; above, eight bytes at a time are mixed into two independent lanes, non-linearly and with the length; words of over LONG
bytes are hashed by keyed BLAKE2b. A
text without words has none; null counts as empty.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

EXACT = 7  # bytes up to which no two words share a hash
LONG = 64  # bytes of a word over which BLAKE2b hashes it

_rng = np.random.Generator(np.random.PCG64(20240607))
LANES = _rng.integers(1, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
KEY = _rng.bytes(16)
ORDER = _rng.integers(1, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Byte classes. Lower-casing maps A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK_WORDS = np.ones(256, bool)  # [^\x20\x09-\x0D]+
BLANK_WORDS[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORDS = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the offsets of each (one more than there are texts)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    col = pc.fill_null(col, "").cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = col.buffers()
    offsets = np.frombuffer(at, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    start: np.ndarray  # byte of the first letter
    end: np.ndarray  # byte after the last letter
    hash: np.ndarray  # uint64
    first: np.ndarray  # of each text: its first word's number; one more entry than there are texts
    stems: tuple = ()  # for each length asked for: hashes of the words' first bytes, of which a word has at least one more

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = BLANK_WORDS, stems: tuple[int, ...] = ()) -> Words:
    """Words of each text, lower-cased (A-Z)."""
    size = len(data)
    inside = word_bytes[data]
    cut = np.zeros(size + 1, bool)
    cut[offsets] = True
    before = np.empty(size, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:size]))
    after = np.empty(size, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    del before, after, cut, inside
    low = padded(LOWER[data])
    hashes = hashed(low, start, end)
    short = tuple(hashed(low, start, np.minimum(start + k, end)) for k in stems)
    return Words(start, end, hashes, np.searchsorted(start, offsets), short)


def padded(data: np.ndarray) -> np.ndarray:
    """The bytes, and eight more, so that eight can be read at every place."""
    return np.concatenate([data, np.zeros(8, np.uint8)])


def _every(low: np.ndarray) -> np.ndarray:
    """The eight bytes at every place of padded bytes."""
    return np.ndarray(max(1, len(low) - 7), "<u8", low, strides=(1,))


def _first(value: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Eight bytes each, of which the first `length` (1 to 8) stay."""
    return value & (~np.uint64(0) >> ((8 - length) * 8).astype(np.uint64))


def eights(low: np.ndarray, start: np.ndarray, length: np.ndarray):
    """Of padded bytes: (rows, values) of the first, second, ... eight bytes of every range that has so many; missing bytes are 0."""
    every = _every(low)
    rows, at = np.flatnonzero(length > 0), 0
    while len(rows):
        left = length[rows] - at
        yield rows, _first(every[start[rows] + at], np.minimum(left, 8))
        at += 8
        rows = rows[left > 8]


def hashed(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ranges of padded bytes."""
    length = end - start
    out = mix(length.astype(np.uint64) << np.uint64(56))  # of no bytes
    few = np.flatnonzero((length > 0) & (length <= EXACT))
    out[few] = mix(_first(_every(low)[start[few]], length[few]) | (length[few].astype(np.uint64) << np.uint64(56)))
    more = np.flatnonzero((length > EXACT) & (length <= LONG))
    n = length[more].astype(np.uint64)
    a, b = mix(n * LANES[0]), mix(n * LANES[1])
    for rows, value in eights(low, start[more], length[more]):
        a[rows] = mix((a[rows] ^ value) * LANES[2])
        b[rows] = mix(b[rows] + value * LANES[3])
    out[more] = mix(a ^ ((b << np.uint64(29)) | (b >> np.uint64(35))))
    for k in np.flatnonzero(length > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(low[start[k] : end[k]], digest_size=8, key=KEY).digest(), "little")
    return out


def equal_ranges(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ranges of equal lengths hold the same bytes; a and b are padded."""
    same = np.ones(len(length), bool)
    long = np.flatnonzero(length > LONG)
    short = length if not len(long) else np.where(length > LONG, 0, length)
    for (rows, x), (_, y) in zip(eights(a, a_start, short), eights(b, b_start, short), strict=True):
        same[rows[x != y]] = False
    for k in long.tolist():
        n = int(length[k])
        same[k] = np.array_equal(a[a_start[k] : a_start[k] + n], b[b_start[k] : b_start[k] + n])
    return same


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words inside one text, and each window's first word."""
    h = words.hash
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = np.repeat(words.first[1:], words.counts)  # for each word: the end of its text
    at = np.flatnonzero(np.arange(n, len(h) + 1) <= last[: len(h) - n + 1])
    out = h[at] * ORDER[0]
    for k in range(1, n):
        out += h[at + k] * ORDER[k]
    return mix(out + np.uint64(n)), at


def batches(offsets: np.ndarray, limit: int = 1 << 22):
    """Ranges of texts whose bytes stay under the limit, or single longer texts."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 22):
    """A record batch in parts: each part, its text bytes and its offsets."""
    data, offsets = text_bytes(batch.column(column))
    for lo, hi in batches(offsets, limit):
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
