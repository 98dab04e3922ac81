"""Byte forms of the container: payloads, blocks, access units and parameter sets, written and read as rows.

All numbers are big-endian.  A unit is its type (0 parameter set, 1 access unit), its length with these five bytes,
and its content; the layouts of the contents stand at the functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from varloom.operators.matrices import BINARIZATIONS, Part, Payload

PARAMETER_SET, ACCESS_UNIT, HEADER = 0, 1, 5
CODER_IDS = {"raw": 0, "zlib": 1, "lzma": 2, "bz2": 3}


def _sized(raw: bytes) -> bytes:
    return len(raw).to_bytes(4, "big") + raw


def payload_bytes(p: Payload) -> bytes:
    """Each matrix with its row and column ids, bit lengths, phases in the same way, then the replacement values."""
    parts = [*p.alleles, *([p.phases] if p.phases else [])]
    fields = [b"".join(_sized(x) for x in (part.payload, part.row_ids, part.col_ids) if x is not None) for part in parts]
    if p.lengths is not None:
        fields.insert(len(p.alleles), _sized(p.lengths))
    reps = [r for r in (p.missing_rep, p.absent_rep) if r is not None]
    if any(r > 255 for r in reps):
        raise ValueError("a replacement value does not fit a byte")
    return b"".join([*fields, bytes(reps)])


def payload_of(raw: bytes, matrices: int, sort_rows: bool, sort_cols: bool, row_split: bool, phases: bool, missing: bool, absent: bool) -> Payload:
    """A payload from its bytes and the flags of its parameter set; bytes left over or missing raise."""
    at = 0

    def taken() -> bytes:
        nonlocal at
        size = int.from_bytes(raw[at : at + 4], "big")
        at += 4 + size
        if at > len(raw):
            raise ValueError("a field reaches behind the payload")
        return raw[at - size : at]

    def part() -> Part:
        return Part(taken(), taken() if sort_rows else None, taken() if sort_cols else None)

    found = Payload([part() for _ in range(matrices)])
    found.lengths = taken() if row_split else None
    found.phases = part() if phases else None
    reps = list(raw[at:])
    if len(reps) != missing + absent:
        raise ValueError("the payload's length does not fit its parameter set")
    found.missing_rep = reps[0] if missing else None
    found.absent_rep = reps[-1] if absent else None
    return found


def block_bytes(payload: bytes) -> bytes:
    """Content (0: genotypes), size and payload."""
    return b"\0" + _sized(payload)


def unit_bytes(unit: int, set_id: int, blocks: list[bytes]) -> bytes:
    """Header of the unit, its number, parameter set and number of blocks, and the blocks."""
    if not 0 < len(blocks) <= 255:
        raise ValueError("an access unit has 1 to 255 blocks")
    head = unit.to_bytes(4, "big") + bytes([set_id, len(blocks)])
    size = HEADER + len(head) + sum(len(x) for x in blocks)
    return b"".join([bytes([ACCESS_UNIT]), size.to_bytes(4, "big"), head, *blocks])


def unit_of(raw: bytes) -> tuple[int, int, list[bytes]]:
    """Number, parameter set and payloads of an access unit."""
    if raw[0] != ACCESS_UNIT or int.from_bytes(raw[1:5], "big") != len(raw):
        raise ValueError("not a whole access unit")
    unit, set_id, count, at, found = int.from_bytes(raw[5:9], "big"), raw[9], raw[10], 11, []
    for _ in range(count):
        size = int.from_bytes(raw[at + 1 : at + 5], "big")
        if raw[at] != 0 or at + 5 + size > len(raw):
            raise ValueError("not a whole block")
        found.append(raw[at + 5 : at + 5 + size])
        at += 5 + size
    if at != len(raw):
        raise ValueError("bytes behind the last block")
    return unit, set_id, found


_SET_FIELDS = "set_id long, any_missing int, any_absent int, ploidy int, binarization string, depth int, axis int, sort_rows boolean, sort_cols boolean, transpose boolean, coder string, phase int"
SET_NAMES = [x.split()[0] for x in _SET_FIELDS.split(", ")]


def matrices_of(binarization: str, depth: int, axis: int) -> int:
    """Coded allele matrices of a block."""
    return max(1, depth) if binarization == "bit_plane" and axis == 2 else 1


def set_bytes(r) -> bytes:
    """id, missing and absent flags, ploidy less one, binarization, planes and axis, then flags of each matrix, then those of
    the phases or the one phase; phase -1 says that phases are coded."""
    if r.coder not in CODER_IDS:
        raise ValueError(f"parameter sets have no number for the coder {r.coder}")
    flags = f"{int(r.sort_rows):b}{int(r.sort_cols):b}{int(r.transpose):b}{CODER_IDS[r.coder]:02b}"
    planes = f"{max(1, r.depth):08b}{r.axis:02b}" if r.binarization == "bit_plane" else ""
    bits = f"{r.set_id:08b}{r.any_missing:b}{r.any_absent:b}{r.ploidy - 1:08b}{BINARIZATIONS[r.binarization]:02b}{planes}{int(r.phase < 0):b}"
    bits += flags * matrices_of(r.binarization, r.depth, r.axis) + (flags if r.phase < 0 else f"{r.phase:b}")
    bits += "0" * (-len(bits) % 8)
    content = int(bits, 2).to_bytes(len(bits) // 8, "big")
    return bytes([PARAMETER_SET]) + (len(content) + HEADER).to_bytes(4, "big") + content


def set_of(raw: bytes) -> list:
    """The fields of a parameter set, in the order of SET_NAMES."""
    if raw[0] != PARAMETER_SET or int.from_bytes(raw[1:5], "big") != len(raw):
        raise ValueError("not a whole parameter set")
    bits, at = f"{int.from_bytes(raw[5:], 'big'):0{8 * (len(raw) - 5)}b}", 0

    def taken(n: int) -> int:
        nonlocal at
        at += n
        return int(bits[at - n : at], 2)

    set_id, missing, absent, ploidy, kind = taken(8), taken(1), taken(1), taken(8) + 1, taken(2)
    binarization = {n: name for name, n in BINARIZATIONS.items()}[kind]
    depth, axis = (taken(8), taken(2)) if binarization == "bit_plane" else (1, 0)
    coded = taken(1)
    flags = {(taken(1), taken(1), taken(1), taken(2)) for _ in range(matrices_of(binarization, depth, axis))}
    if coded:
        flags.add((taken(1), taken(1), taken(1), taken(2)))
    if len(flags) > 1:
        raise ValueError("matrices of one set are sorted and coded alike")
    rows, cols, transpose, coder = flags.pop()
    phase = -1 if coded else taken(1)
    if len(bits) - at >= 8 or "1" in bits[at:]:
        raise ValueError("bits behind the parameter set")
    return [set_id, missing, absent, ploidy, binarization, depth, axis, bool(rows), bool(cols), bool(transpose), {n: name for name, n in CODER_IDS.items()}[coder], phase]


def sets_to_bytes(sets: DataFrame) -> DataFrame:
    """set_id and unit, the bytes of each parameter set."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"set_id": f["set_id"], "unit": [set_bytes(r) for r in f.itertuples()]})

    return sets.select(*SET_NAMES).mapInPandas(run, "set_id long, unit binary")


def sets_from_bytes(units: DataFrame) -> DataFrame:
    """The parameter sets of units."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([set_of(bytes(raw)) for raw in f["unit"]], columns=SET_NAMES)

    return units.select("unit").mapInPandas(run, _SET_FIELDS)


def units_to_bytes(blocks: DataFrame) -> DataFrame:
    """au_id, set_id, n_blocks and unit of blocks(block_id, au_id, set_id, payload); a unit has at most 255 blocks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block_id")
        au_id, set_id = (table.column(c)[0].as_py() for c in ("au_id", "set_id"))
        made = unit_bytes(au_id, set_id, [block_bytes(x.as_py()) for x in table.column("payload")])
        return pa.table({"au_id": [au_id], "set_id": [set_id], "n_blocks": pa.array([table.num_rows]), "unit": pa.array([made], pa.binary())})

    # Groups come sorted, which can spill; a list of them as an aggregate could not.
    return blocks.select("block_id", "au_id", "set_id", "payload").groupBy("au_id", "set_id").applyInArrow(run, "au_id long, set_id long, n_blocks long, unit binary")


def units_from_bytes(units: DataFrame) -> DataFrame:
    """au_id, set_id, place (of the block in its unit, from 0) and payload."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["unit"]:
                unit, set_id, payloads = unit_of(bytes(raw))
                yield pd.DataFrame({"au_id": unit, "set_id": set_id, "place": range(len(payloads)), "payload": payloads})

    return units.select("unit").mapInPandas(run, "au_id long, set_id long, place long, payload binary")
