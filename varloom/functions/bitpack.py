"""Bits and bytes of one bounded block, in numpy: packed matrices, permutations and bit-length vectors."""

from __future__ import annotations

import numpy as np


def width_of(most: int) -> int:
    """Bits that hold a number: 0 for 0, 2 for 3."""
    return int(most).bit_length()


def number_bytes(x: np.ndarray) -> bytes:
    """Signed numbers in the fewest whole bytes each that hold them all."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    return x.astype(next(f"<i{n}" for n in (1, 2, 4) if -(1 << 8 * n - 1) <= low and high < 1 << 8 * n - 1)).tobytes()


def numbers_of(raw: bytes, n: int) -> np.ndarray:
    """n numbers again."""
    return np.frombuffer(raw, f"<i{len(raw) // n if n else 1}")


def _digits(values: np.ndarray, width: int) -> np.ndarray:
    """The binary digits of each value, the most significant first."""
    return ((values[:, None].astype(np.uint64) >> np.arange(width - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)


def permutation_bytes(ids: np.ndarray) -> bytes:
    """Every id in the fewest bits for their number."""
    return np.packbits(_digits(np.asarray(ids), width_of(len(ids) - 1))).tobytes()


def permutation_of(raw: bytes, n: int) -> np.ndarray:
    """The ids of a permutation of n again."""
    width = width_of(n - 1)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8))[: n * width].reshape(n, width)
    ids = bits.astype(np.int64) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64)) if width else np.zeros(n, np.int64)
    if not (np.sort(ids) == np.arange(n)).all():
        raise ValueError("not a permutation")
    return ids


def lengths_bytes(lengths: np.ndarray) -> bytes:
    """Row bit counts: their number, the bits of an entry, then 0 for one, or 1 and the count less two."""
    lengths = np.asarray(lengths)
    if len(lengths) and lengths.min() < 1:
        raise ValueError("a row has at least one bit")
    most = int(lengths.max()) if len(lengths) else 0
    width = width_of(most - 2) if most > 1 else 0
    entry = np.concatenate([(lengths > 1).astype(np.uint8)[:, None], _digits(np.maximum(lengths - 2, 0), width)], 1)
    used = np.concatenate([np.ones((len(lengths), 1), bool), np.repeat((lengths > 1)[:, None], width, 1)], 1)
    return len(lengths).to_bytes(4, "big") + bytes([width]) + np.packbits(entry[used]).tobytes()


def lengths_of(raw: bytes) -> np.ndarray:
    """The row bit counts again.

    An entry tells by its first bit whether others follow.  The places of entries come from jumps that double: the first
    2**k places and the jump over 2**k entries give the next 2**k places.
    """
    count, width = int.from_bytes(raw[:4], "big"), raw[4]
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, offset=5))
    jump = np.minimum(np.arange(len(bits)) + 1 + width * bits.astype(np.int64), len(bits))
    jump, at = np.append(jump, len(bits)), np.zeros(min(count, 1), np.int64)
    while len(at) < count:
        at, jump = np.append(at, jump[at]), jump[jump]
    at = at[:count]
    if count and (at[-1] >= len(bits) or at[-1] + 1 + width * int(bits[at[-1]]) > len(bits)):
        raise ValueError("the bytes end within an entry")
    more = at[bits[at] == 1] if count else at
    out = np.ones(count, np.int64)
    places = more[:, None] + 1 + np.arange(width)
    out[bits[at] == 1] = 2 + (bits[places].astype(np.int64) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64)) if width else 0)
    return out


def matrix_bytes(bits: np.ndarray) -> bytes:
    """A matrix of bits row by row, without gaps between rows."""
    return np.packbits(np.ascontiguousarray(bits, np.uint8).ravel()).tobytes()


def matrix_of(raw: bytes, rows: int, columns: int) -> np.ndarray:
    if len(raw) != -(-rows * columns // 8):
        raise ValueError("the bytes do not fit the shape")
    return np.unpackbits(np.frombuffer(raw, np.uint8))[: rows * columns].reshape(rows, columns)
