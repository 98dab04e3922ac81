"""A matrix of bits as the runs of ones of its rows, read, counted and compared without being unpacked.

A row becomes the places at which its bit changes, a 0 standing before and behind it: starts and ends of its runs of ones
in turn.  The changes of two rows' differing positions are those that only one of both has, so distances need no bits.  A
row whose changes take more bytes than its bits is kept as bits.

Bytes: which rows are kept as bits (a bit each), where each row begins (4 bytes each, and the end), then the rows; a
change takes 2 bytes, or 4 from 65,535 columns on.  The shape is kept outside, as with `bitpack.matrix_bytes`.
"""

from __future__ import annotations

import numpy as np


def _width(columns: int) -> int:
    """Bytes of a change, which may stand right behind the last column."""
    return 2 if columns < 0xFFFF else 4


def _edges(bits: np.ndarray) -> np.ndarray:
    """For each place and the one behind the last: whether the bit changes there."""
    found = np.zeros((len(bits), bits.shape[1] + 1), np.uint8)
    found[:, :-1] = bits
    found[:, 1:] ^= np.asarray(bits, np.uint8)
    return found


def encoded(bits: np.ndarray) -> bytes:
    """The bytes of a matrix of bits."""
    bits = np.ascontiguousarray(bits, np.uint8)
    rows, columns = bits.shape
    edges = _edges(bits)
    counts, width, plain = edges.sum(1, dtype=np.int64), _width(columns), -(-columns // 8)
    dense = counts * width > plain
    sizes = np.where(dense, plain, counts * width)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    if begins[-1] >= 1 << 32:
        raise ValueError("a matrix of runs takes less than 4 GiB")
    body = np.empty(begins[-1], np.uint8)
    kept = np.repeat(dense, sizes)
    body[kept] = np.packbits(bits[dense], axis=1).ravel()
    body[~kept] = np.nonzero(edges[~dense])[1].astype(f"<u{width}").view(np.uint8)
    return np.packbits(dense).tobytes() + begins.astype("<u4").tobytes() + body.tobytes()


class Runs:
    """A matrix of bits in that form; a row is read from its own bytes."""

    def __init__(self, raw: bytes, rows: int, columns: int) -> None:
        marks = -(-rows // 8)
        if len(raw) < marks + 4 * (rows + 1):
            raise ValueError("the bytes do not fit the shape")
        self.rows, self.columns = rows, columns
        self._dense = np.unpackbits(np.frombuffer(raw, np.uint8, marks))[:rows].astype(bool)
        self._begins = np.frombuffer(raw, "<u4", rows + 1, marks).astype(np.int64)
        self._body = np.frombuffer(raw, np.uint8, offset=marks + 4 * (rows + 1))
        sizes = np.diff(self._begins)
        if self._begins[0] or self._begins[-1] != len(self._body) or (sizes < 0).any() or (sizes[self._dense] != -(-columns // 8)).any() or (sizes[~self._dense] % (2 * _width(columns))).any():
            raise ValueError("the bytes do not fit the shape")

    def _bytes(self, k: int) -> np.ndarray:
        return self._body[self._begins[k] : self._begins[k + 1]]

    def row(self, k: int) -> np.ndarray:
        """The bits of one row."""
        if self._dense[k]:
            return np.unpackbits(self._bytes(k))[: self.columns]
        found = np.zeros(self.columns + 1, np.uint8)
        found[self.changes(k)] = 1
        return np.bitwise_xor.accumulate(found)[:-1]

    def changes(self, k: int) -> np.ndarray:
        """Starts and ends of the runs of ones of one row, in turn."""
        if self._dense[k]:
            return np.flatnonzero(_edges(self.row(k)[None])[0])
        return self._bytes(k).view(f"<u{_width(self.columns)}").astype(np.int64)

    def all_changes(self) -> tuple[np.ndarray, np.ndarray]:
        """The changes of all rows one after another, and where those of each row begin."""
        found = [self.changes(k) for k in range(self.rows)]
        return np.concatenate([*found, np.zeros(0, np.int64)]), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Ones and runs of ones of each row."""
        found, begins = self.all_changes()
        lengths = np.concatenate([[0], np.cumsum(found[1::2] - found[::2])])
        return np.diff(lengths[begins // 2]), np.diff(begins) // 2

    def decoded(self) -> np.ndarray:
        """All bits."""
        found, begins = self.all_changes()
        edges = np.zeros((self.rows, self.columns + 1), np.uint8)
        edges[np.repeat(np.arange(self.rows), np.diff(begins)), found] = 1
        return np.bitwise_xor.accumulate(edges, 1)[:, :-1]


def decoded(raw: bytes, rows: int, columns: int) -> np.ndarray:
    return Runs(raw, rows, columns).decoded()


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The changes of the positions at which two rows, given by their changes, differ."""
    return np.setxor1d(a, b, assume_unique=True)


def _ham(diff: np.ndarray) -> int:
    return int((diff[1::2] - diff[::2]).sum())


def _ham_runs(diff: np.ndarray) -> int:
    return len(diff) // 2


def _ham_runs_parity(diff: np.ndarray) -> int:
    """As `_ham_runs`, but a single difference at the first position counts 0."""
    return 0 if diff.tolist() == [0, 1] else _ham_runs(diff)


#: Distances from the changes of differing positions, by name; add one here to use it.
KINDS = {"ham": _ham, "ham_rl": _ham_runs, "ham_rl_parity": _ham_runs_parity}
