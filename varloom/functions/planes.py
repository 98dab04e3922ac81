"""Vectors of small numbers as packed bit planes, and distances on the packed form.

A vector of length m with values below 2**depth becomes `depth` rows of 64-bit words, position k at bit k % 64 of word
k // 64.  Positions where two vectors differ are the union of the planes' exclusive ors, again as words.
"""

from __future__ import annotations

import numpy as np

#: Words of differing positions that are held at once.
AT_ONCE = 1 << 18
_ONE = np.uint64(1)
_TOP = np.uint64(63)


def packed(x: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Words (depth, vectors, words) of the rows of x."""
    x = np.asarray(x)
    if x.size and x.min() < 0:
        raise ValueError("packed numbers count from 0")
    if depth is None:
        depth = max(1, int(x.max()).bit_length()) if x.size else 1
    words = -(-x.shape[1] // 64)
    out = np.zeros((depth, len(x), words * 8), np.uint8)
    narrow = x.dtype in (np.int8, np.uint8)
    for b in range(depth):
        ones = x.view(np.uint8) & np.uint8(1 << b) if narrow and b < 8 else ((x >> b) & 1).astype(np.uint8)  # what is not zero is packed as one
        bits = np.packbits(ones, axis=1, bitorder="little")
        out[b, :, : bits.shape[1]] = bits
    return out.view("<u8").astype(np.uint64, copy=False)


def unpacked(words: np.ndarray, length: int) -> np.ndarray:
    """The vectors again."""
    bits = np.unpackbits(np.ascontiguousarray(words.astype("<u8")).view(np.uint8), axis=2, bitorder="little")[:, :, :length]
    return sum(bits[b].astype(np.int64) << b for b in range(len(words)))


def differing(words: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Words of the positions at which each vector of words (depth, vectors, words) differs from one (depth, words)."""
    found = words[0] ^ one[0]
    for b in range(1, len(words)):
        found |= words[b] ^ one[b]
    return found


def _ones(diff: np.ndarray) -> np.ndarray:
    """Ones of each vector's words."""
    found = np.bitwise_count(diff)
    return found[..., 0].astype(np.int64) if diff.shape[-1] == 1 else found.sum(-1, dtype=np.int64)


def _ham(diff: np.ndarray) -> np.ndarray:
    return _ones(diff)


def _ham_runs(diff: np.ndarray) -> np.ndarray:
    """A run starts at a position that differs while the one before it does not."""
    before = diff << _ONE
    before[..., 1:] |= diff[..., :-1] >> _TOP
    return _ones(diff & ~before)


def _ham_runs_parity(diff: np.ndarray) -> np.ndarray:
    """As `_ham_runs`, but a single difference at the first position counts 0."""
    only_first = (diff[..., 0] & _ONE).astype(bool) & (_ham(diff) == 1)
    return np.where(only_first, 0, _ham_runs(diff))


#: Distances from the words of differing positions (the last axis), by name; add one here to use it.
KINDS = {"ham": _ham, "ham_rl": _ham_runs, "ham_rl_parity": _ham_runs_parity}


#: Positions that a distance counts, of one word of differing positions and the word before it (or None), for distances that count positions.
MARKED = {"ham": lambda diff, before: diff, "ham_rl": lambda diff, before: diff & ~(diff << _ONE if before is None else diff << _ONE | before >> _TOP)}


def counted(words: np.ndarray, one: np.ndarray, kind: str) -> np.ndarray:
    """Distances of vectors laid out by words (words, depth, vectors) to one (words, depth): bytes for one word, else 16 bits."""
    total = before = None
    for word, own in zip(words, one, strict=True):
        diff = differing(word, own)
        ones = np.bitwise_count(MARKED[kind](diff, before))
        if total is None:
            total = ones if len(words) == 1 else ones.astype(np.uint16)
        else:
            total += ones
        before = diff
    return total


def to_one(words: np.ndarray, k: int, kind: str = "ham") -> np.ndarray:
    """Distances of all vectors to vector k: one row of the cost matrix."""
    return KINDS[kind](differing(words, words[:, k]))


def between(a: np.ndarray, b: np.ndarray, kind: str = "ham") -> np.ndarray:
    """Distances of each vector of a to each of b."""
    found = np.empty((a.shape[1], b.shape[1]), np.int64)
    step = max(1, AT_ONCE // max(1, b.shape[1] * b.shape[2]))
    for k in range(0, a.shape[1], step):
        found[k : k + step] = KINDS[kind](differing(b[:, None], a[:, k : k + step, None]))
    return found
