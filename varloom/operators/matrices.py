"""The matrices of one block: binarization, sorting and coding, and the way back.

These helpers see one block, whose size is bounded; `sources/store.py` applies them in a grouping by block.
"""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field, fields

import numpy as np

from varloom.functions import bitpack, runs
from varloom.operators import distance, tour


def _lzma(raw: bytes) -> bytes:
    """With a dictionary that holds these bytes, and no more: its buffers cost far more than the few bytes of a tile."""
    size = min(1 << 23, max(1 << 12, 1 << (len(raw) - 1).bit_length())) if raw else 1 << 12
    return lzma.compress(raw, filters=[{"id": lzma.FILTER_LZMA2, "preset": 6, "dict_size": size}])


#: Byte codecs by name: encode and decode; add one here to use it.
CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "raw": (bytes, bytes), "zlib": (zlib.compress, zlib.decompress), "lzma": (_lzma, lzma.decompress), "bz2": (bz2.compress, bz2.decompress),
}
#: Codecs of whole matrices by name: encode a matrix, decode bytes of a shape.  The format of access units has no number for them.
MATRIX_CODECS: dict[str, tuple[Callable[[np.ndarray], bytes], Callable[[bytes, int, int], np.ndarray]]] = {"runs": (runs.encoded, runs.decoded)}
#: Numbers of the binarizations in a parameter set.
BINARIZATIONS = {"bit_plane": 0, "row_split": 2}


@dataclass(frozen=True)
class EncodeOptions:
    """How blocks are made and coded.

    block_size: variants of a block; None keeps the blocks that rows are given in.  axis: planes are stacked by rows (0),
    by columns (1) or kept apart (2).  tile_samples: samples of a tile of the store; None keeps all samples together.  preset: the effort of a solver that knows any (`tour.PRESETS`); others refuse it.
    """

    block_size: int | None = 1024
    binarization: str = "bit_plane"
    axis: int = 2
    sort_rows: bool = False
    sort_cols: bool = False
    transpose: bool = False
    distance: str = "ham"
    solver: str = "nn"
    preset: int = 0
    coder: str = "zlib"
    tile_samples: int | None = None

    def __post_init__(self) -> None:
        known = {"binarization": BINARIZATIONS, "axis": (0, 1, 2), "distance": distance.KINDS, "solver": tour.SOLVERS, "preset": tour.PRESETS.get(self.solver, (0,)), "coder": CODECS | MATRIX_CODECS}
        for name, choices in known.items():
            if getattr(self, name) not in choices:
                raise ValueError(f"unknown {name}: {getattr(self, name)}")
        if self.block_size is not None and self.block_size < 1:
            raise ValueError("a block has at least one variant")
        if self.tile_samples is not None and self.tile_samples < 1:
            raise ValueError("a tile has at least one sample")


@dataclass
class Part:
    """One coded matrix, with the inverse orders of its rows and columns where they were sorted."""

    payload: bytes
    row_ids: bytes | None = None
    col_ids: bytes | None = None


@dataclass
class Payload:
    """What is stored of a block: coded allele matrices, bit lengths of rows, coded phases and replacement values."""

    alleles: list[Part] = field(default_factory=list)
    lengths: bytes | None = None
    phases: Part | None = None
    missing_rep: int | None = None
    absent_rep: int | None = None

    def sizes(self) -> dict[str, int]:
        """Bytes by component, length fields included."""
        of = lambda parts: sum(len(p) + 4 for p in parts if p is not None)
        phases = [self.phases] if self.phases else []
        return {
            "allele_matrices": of(p.payload for p in self.alleles), "allele_row_ids": of(p.row_ids for p in self.alleles), "allele_col_ids": of(p.col_ids for p in self.alleles), "row_lengths": of([self.lengths]),
            "phase_matrix": of(p.payload for p in phases), "phase_row_ids": of(p.row_ids for p in phases), "phase_col_ids": of(p.col_ids for p in phases), "replacements": sum(r is not None for r in (self.missing_rep, self.absent_rep)),
        }


SIZES = tuple(Payload().sizes())


def binarized(values: np.ndarray, depth: int, options: EncodeOptions) -> tuple[list[np.ndarray], np.ndarray | None]:
    """Bit matrices of a block's values, the least significant bit first, and for the row split the bits of each row."""
    if options.binarization == "row_split":
        lengths = np.array([max(1, bitpack.width_of(m)) for m in values.max(1).tolist()])
        row = np.repeat(np.arange(len(values)), lengths)
        bit = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return [((values[row] >> bit[:, None]) & 1).astype(np.uint8)], lengths
    planes = [((values >> b) & 1).astype(np.uint8) for b in range(max(1, depth))]
    return (planes if options.axis == 2 else [np.concatenate(planes, options.axis)]), None


def _holding(depth: int) -> np.dtype:
    """The smallest signed type for numbers of `depth` bits."""
    return np.min_scalar_type(-(1 << depth))


def from_binarized(found: list[np.ndarray], depth: int, axis: int, lengths: np.ndarray | None) -> np.ndarray:
    """The values again."""
    if lengths is not None:
        first = np.cumsum(lengths) - lengths
        bit = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        kind = _holding(int(lengths.max(initial=1)))
        return np.add.reduceat(found[0].astype(kind) << bit[:, None].astype(kind), first, 0, dtype=kind)
    planes, kind = found if axis == 2 else np.split(found[0], max(1, depth), axis), _holding(depth)
    values = planes[0].astype(kind)
    for b, p in enumerate(planes[1:], 1):
        values |= p.astype(kind) << kind.type(b)
    return values


def sort_matrix(bits: np.ndarray, options: EncodeOptions) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """A matrix with rows and columns in the solver's order, and the inverse orders.  Both orders come from the given matrix."""
    turned = bits.T if options.transpose else bits
    orders = [tour.SOLVERS[options.solver].order(m, options.distance, options.preset) if wanted else None for wanted, m in ((options.sort_rows, turned), (options.sort_cols, turned.T))]
    for axis, order in enumerate(orders):
        if order is not None:
            bits = turned = np.take(turned, order, axis)
    return turned, *(None if o is None else np.argsort(o) for o in orders)


def unsort_matrix(bits: np.ndarray, row_ids: np.ndarray | None, col_ids: np.ndarray | None, transpose: bool) -> np.ndarray:
    for axis, ids in enumerate((row_ids, col_ids)):
        if ids is not None:
            bits = np.take(bits, ids, axis)
    return bits.T if transpose else bits


def code(bits: np.ndarray, options: EncodeOptions) -> Part:
    """A matrix sorted, packed and coded; its shape goes ahead of its bytes."""
    bits, *ids = sort_matrix(bits, options)
    shape = b"".join(n.to_bytes(4, "big") for n in bits.shape)
    raw = MATRIX_CODECS[options.coder][0](bits) if options.coder in MATRIX_CODECS else CODECS[options.coder][0](bitpack.matrix_bytes(bits))
    return Part(shape + raw, *(None if i is None else bitpack.permutation_bytes(i) for i in ids))


def decode(part: Part, coder: str, transpose: bool, unsort: bool = True) -> np.ndarray | tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """The matrix again; with unsort=False as it was coded, with its inverse orders."""
    rows, columns = (int.from_bytes(part.payload[k : k + 4], "big") for k in (0, 4))
    raw = part.payload[8:]
    bits = MATRIX_CODECS[coder][1](raw, rows, columns) if coder in MATRIX_CODECS else bitpack.matrix_of(CODECS[coder][1](raw), rows, columns)
    ids = [None if raw is None else bitpack.permutation_of(raw, n) for raw, n in ((part.row_ids, rows), (part.col_ids, columns))]
    return unsort_matrix(bits, *ids, transpose) if unsort else (bits, *ids)


def encode_block(values: np.ndarray, phases: np.ndarray | None, depth: int, reps: tuple[int | None, int | None], options: EncodeOptions) -> Payload:
    """A block's payload from its recoded values and, if they differ, its phases."""
    found, lengths = binarized(values, depth, options)
    return Payload([code(m, options) for m in found], None if lengths is None else bitpack.lengths_bytes(lengths), None if phases is None else code(phases, options), *reps)


def decode_block(payload: Payload, depth: int, options: EncodeOptions) -> tuple[np.ndarray, np.ndarray | None]:
    """The recoded values and phases of a block."""
    found = [decode(p, options.coder, options.transpose) for p in payload.alleles]
    lengths = None if payload.lengths is None else bitpack.lengths_of(payload.lengths)
    values = from_binarized(found, depth, options.axis, lengths)
    return values, None if payload.phases is None else decode(payload.phases, options.coder, options.transpose)


OPTION_NAMES = tuple(f.name for f in fields(EncodeOptions))
