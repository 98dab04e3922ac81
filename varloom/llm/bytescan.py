"""Vectorised scanning of UTF-8 text columns inside tasks.

A text column of an Arrow batch becomes one byte array and the offsets of its rows; words are found and
hashed for all rows at once.  Null texts are empty.  Memory is bounded by handing out segments of half a
megabyte, whose arrays take many times that (a longer text is a segment of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are scanned at once.
SEGMENT = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xFF51AFD7ED558CCD)
_MIX_B = np.uint64(0xC4CEB9FE1A85EC53)
#: A random 64-bit value for each byte, fixed by a seed.
BYTE_CODE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

_libc = ctypes.CDLL(None)
_powers: dict[str, np.ndarray] = {}
#: What drops that which an operator keeps in a worker for its next tasks.
DROPS: list[Callable[[], None]] = []


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A boolean table of 256 entries, true within the (inclusive) ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Everything but ASCII white space: words `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Digits, letters and every byte of a non-ASCII character: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
ALNUM_LOWER = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = lower_ascii()


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the row offsets (int64, one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def segments(bounds: np.ndarray, limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each; a longer row stands alone."""
    low, rows = 0, len(bounds) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + limit, "right")) - 1)
        yield low, min(high, rows)
        low = min(high, rows)


def give_back() -> None:
    """Return freed memory to the system: workers live on, and several share an executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def begin() -> None:
    """For operators that keep nothing: workers live on, and what earlier operators keep in this one goes."""
    for drop in DROPS:
        drop()
    give_back()


def pieces(column: pa.Array, limit: int = SEGMENT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of each segment of a text column."""
    data, bounds = flat(column)
    for low, high in segments(bounds, limit):
        yield low, high, data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
    give_back()


def runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; a row's end always ends a run."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = bounds[(bounds > 0) & (bounds < len(mask))]
    before = np.empty_like(mask)
    before[0] = False
    before[1:] = mask[:-1]
    before[cut] = False
    starts = np.flatnonzero(mask & ~before)
    after = before
    after[-1] = False
    after[:-1] = mask[1:]
    after[cut - 1] = False
    return starts, np.flatnonzero(mask & ~after) + 1


def power(name: str, size: int) -> np.ndarray:
    """Powers of the hash base (`up`) or of its inverse modulo 2**64 (`down`)."""
    have = _powers.get(name)
    if have is None or len(have) < size:
        base = _BASE if name == "up" else np.uint64(pow(int(_BASE), -1, 1 << 64))
        steps = np.full(max(size, SEGMENT + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= _MIX_A
    h ^= h >> np.uint64(29)
    h *= _MIX_B
    h ^= h >> np.uint64(32)
    return h


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """A 64-bit hash of each byte span (spans in order, not overlapping), never 0."""
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        base = starts[low]
        high = max(low + 1, int(np.searchsorted(ends, base + SEGMENT, "right")))
        length = int(ends[high - 1] - base)
        sums = np.empty(length + 1, np.uint64)
        sums[0] = 0
        np.cumsum(code[data[base : base + length]] * power("up", length + 1)[:length], out=sums[1:])
        first, last = starts[low:high] - base, ends[low:high] - base
        out[low:high] = (sums[last] - sums[first]) * power("down", length + 1)[first]
        low = high
    out = mix(out)
    out[out == 0] = 1
    return out


def gram_hash(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` consecutive word hashes (across rows; the caller drops those)."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(size):
        out = out * _BASE + words[k : k + count]
    out = mix(out)
    out[out == 0] = 1
    return out


def row_of(bounds: np.ndarray, total: int) -> np.ndarray:
    """The row of each of `total` items, from the item offsets of the rows."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


class HashTable:
    """Open addressing from 64-bit hashes (not 0) to consecutive numbers, filled and read by arrays."""

    def __init__(self, bits: int = 21):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.count = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for those that are not there."""
        slot = (h >> self.shift).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.values[slot], np.int32(-1))
        left = np.flatnonzero((key != h) & (key != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            key, want = self.keys[slot], h[left]
            hit = key == want
            out[left[hit]] = self.values[slot[hit]]
            more = ~hit & (key != 0)
            left, slot = left[more], slot[more]
        return out

    def add(self, h: np.ndarray) -> None:
        """Number distinct new hashes in their order."""
        number = np.arange(self.count, self.count + len(h), dtype=np.int32)
        self.count += len(h)
        slot = (h >> self.shift).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            done = free & (self.keys[slot] == h)
            self.values[slot[done]] = number[done]
            h, slot, number = h[~done], (slot[~done] + 1) & self.mask, number[~done]
