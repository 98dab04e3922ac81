"""Matrices of bits as runs of ones: round trips, single rows, counts and distances against the bits."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from varloom.functions import planes, runs
from varloom.operators import matrices, run_planes


def _matrix(rows, columns, share, seed):
    rng = np.random.default_rng(seed)
    bits = (rng.random((rows, columns)) < share).astype(np.uint8)
    if columns:  # rows of long runs beside rows that change at every place
        bits[::3] = np.sort(bits[::3], 1)
        bits[1::5] = np.arange(columns) % 2
    return bits


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 20), st.integers(0, 150), st.sampled_from([0, 0.02, 0.5, 1]), st.integers(0, 9))
def test_matrices_come_back(rows, columns, share, seed):
    bits = _matrix(rows, columns, share, seed)
    found = runs.Runs(runs.encoded(bits), rows, columns)
    assert (found.decoded() == bits).all() and found.decoded().shape == bits.shape
    ones, n = found.counts()
    assert ones.tolist() == bits.sum(1, dtype=int).tolist()
    assert n.tolist() == ((bits == 1) & (np.pad(bits, ((0, 0), (1, 0)))[:, :columns] == 0)).sum(1).tolist()
    for k in range(rows):
        assert (found.row(k) == bits[k]).all()


@pytest.mark.parametrize("kind", runs.KINDS)
@pytest.mark.parametrize("columns", [1, 2, 64, 130])
def test_distances_equal_those_of_planes(kind, columns):
    bits = _matrix(17, columns, 0.1, columns)
    bits[4], bits[5] = bits[3], bits[3]
    bits[5, 0] ^= 1  # a single difference at the first place
    found, words = runs.Runs(runs.encoded(bits), *bits.shape), planes.packed(bits, 1)
    cost = planes.between(words, words, kind)
    assert all(runs.KINDS[kind](runs.differing(found.changes(i), found.changes(j))) == cost[i, j] for i in range(17) for j in range(17))


@pytest.mark.parametrize("columns", [65534, 65535, 65536, 70000])
def test_changes_behind_the_last_column_fit(columns):
    bits = np.zeros((2, columns), np.uint8)
    bits[0, 3:] = bits[1, -1] = 1
    raw = runs.encoded(bits)
    assert (runs.decoded(raw, 2, columns) == bits).all() and len(raw) < 64


def test_a_row_is_read_from_its_own_bytes():
    bits = _matrix(200, 400, 0.01, 5)
    raw = runs.encoded(bits)
    found = runs.Runs(raw, 200, 400)
    found._body = np.full_like(found._body, 255)  # other rows' bytes are lost
    found._body[found._begins[7] : found._begins[8]] = runs.Runs(raw, 200, 400)._bytes(7)
    assert (found.row(7) == bits[7]).all()
    assert len(raw) < bits.size // 8


def test_bytes_of_another_shape_raise():
    raw = runs.encoded(_matrix(9, 50, 0.1, 1))
    for shape in ((8, 50), (10, 50), (9, 900)):
        with pytest.raises(ValueError, match="shape"):
            runs.Runs(raw, *shape)
    for damaged in (raw[:-1], raw + b"\0", b""):
        with pytest.raises(ValueError, match="shape"):
            runs.Runs(damaged, 9, 50)


def test_blocks_are_coded_with_runs():
    values = np.random.default_rng(2).integers(0, 5, (12, 30))
    for options in (matrices.EncodeOptions(coder="runs", sort_rows=True, sort_cols=True), matrices.EncodeOptions(coder="runs", binarization="row_split", transpose=True)):
        found = matrices.decode_block(matrices.encode_block(values, None, 3, (None, None), options), 3, options)
        assert (found[0] == values).all()


def test_rows_of_planes_in_spark(spark):
    x = np.random.default_rng(4).integers(0, 4, (2, 6, 11))
    rows = spark.createDataFrame([(b, i, x[b, i].tolist(), 2) for b in range(2) for i in range(6)], "block_id long, id long, x array<int>, depth int").repartition(5)
    found = run_planes.planes(rows)
    got = {(r.block_id, r.plane, r.row_in_block): r.bits for r in run_planes.read(found).collect()}
    assert got == {(b, p, i): ((x[b, i] >> p) & 1).tolist() for b in range(2) for p in range(2) for i in range(6)}
    near = {(r.block_id, r.plane, r.i, r.j): r.ham for r in run_planes.neighbours(found, ("ham",), reach=2).collect()}
    assert near == {(b, p, i, j): int((((x[b, i] ^ x[b, j]) >> p) & 1).sum()) for b in range(2) for p in range(2) for i in range(6) for j in (i + 1, i + 2) if j < 6}
    assert run_planes.counts(found.limit(0)).count() == 0
