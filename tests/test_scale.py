"""Tours and distances without square memory, the store in tiles, plans that broadcast no cells."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom import queries
from varloom.functions import bitpack, planes
from varloom.operators import access, binarize, blocks, distance, layout, recode, tour, verify
from varloom.plans.engine import Engine, EncodeOptions
from varloom.sources import store
from varloom.sources.cells import fixture_cells, fixture_rows

from plans import broadcasts

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", planes.KINDS)
@pytest.mark.parametrize(("n", "m", "most"), [(1, 5, 2), (2, 64, 2), (40, 63, 5), (33, 64, 3), (50, 65, 9), (20, 200, 2), (9, 1, 4)])
def test_packed_distances_equal_the_matrix(kind, n, m, most):
    x = np.random.default_rng(n + m).integers(0, most, (n, m))
    words = planes.packed(x)
    cost = distance.matrix(x, kind)
    assert (planes.unpacked(words, m) == x).all()
    assert (planes.between(words, words, kind) == cost).all()
    assert all((planes.to_one(words, k, kind) == cost[k]).all() for k in range(n))


def test_negative_numbers_are_refused():
    with pytest.raises(ValueError, match="from 0"):
        planes.packed(np.array([[0, -1]]))


@pytest.mark.parametrize("kind", planes.KINDS)
@pytest.mark.parametrize("most", [2, 5])
def test_direct_tour_equals_the_tour_by_matrix(kind, most):
    """Few different vectors, so that most steps tie."""
    for seed in range(6):
        rng = np.random.default_rng(seed)
        x = rng.integers(0, most, (12, 30))[rng.integers(0, 12, 90)] if seed % 2 else rng.integers(0, most, (70, 9))
        assert tour.SOLVERS["nn_direct"].order(x, kind).tolist() == tour.SOLVERS["nn"].order(x, kind).tolist()
    assert tour.SOLVERS["nn_direct"].order(np.zeros((1, 4), int)).tolist() == [0]


def test_turning_pieces_round_never_lengthens_a_tour():
    found = []
    for seed in range(8):
        words = planes.packed(np.random.default_rng(seed).integers(0, 2, (60, 40)))
        plain = tour.nearest_packed(words)
        for rounds in (1, 3):
            better = tour.improved(words, plain, rounds=rounds)
            assert sorted(better.tolist()) == list(range(60)) and better[0] == plain[0]
            found.append(tour.length(words, plain) - tour.length(words, better))
    assert min(found) >= 0 and max(found) > 0
    for n in (1, 2, 3):
        words = planes.packed(np.random.default_rng(n).integers(0, 2, (n, 8)))
        assert sorted(tour.improved(words, np.arange(n)).tolist()) == list(range(n))


def test_a_preset_is_applied_or_refused():
    assert EncodeOptions(solver="nn_two_opt", preset=2).preset == 2
    with pytest.raises(ValueError, match="preset"):
        EncodeOptions(solver="nn", preset=1)


def test_5008_columns_in_linear_memory(spark):
    """A matrix of distances would take 200 MB, and several copies of it; the packed columns take 0.6 MB."""
    rng = np.random.default_rng(7)
    founders = rng.integers(0, 2, (1024, 60))
    x = founders[:, rng.integers(0, 60, 5008)] ^ (rng.random((1024, 5008)) < 0.01)
    words, began = planes.packed(x.T), time.time()
    assert words.nbytes == 5008 * 1024 // 8
    order = tour.nearest_packed(words)
    assert sorted(order.tolist()) == list(range(5008)) and time.time() - began < 60
    assert tour.length(words, order) < tour.length(words, np.arange(5008)) / 4

    rows = spark.createDataFrame([(0, i, r.tolist()) for i, r in enumerate(x[:24])], "block_id long, id long, x array<int>")
    got = {r.id: (r.nearest, r.distance, r.total) for r in distance.nearest(rows, columns=True, tile=1024).where("id % 401 = 0").collect()}
    y = x[:24].T
    for k, (at, low, total) in got.items():
        d = (y != y[k]).sum(1)
        d_ = np.where(np.arange(5008) == k, 99, d)
        assert (at, low, total) == (d_.argmin(), d_.min(), d.sum())


@pytest.mark.parametrize("columns", [False, True])
@pytest.mark.parametrize("kind", ["ham", "ham_rl", "ham_rl_parity"])
def test_tiles_of_any_size_give_the_same(spark, kind, columns):
    rng = np.random.default_rng(3)
    shapes = {0: (13, 10), 1: (1, 7), 2: (6, 1), 5: (4, 5)}
    x = {b: rng.integers(0, 5, s) for b, s in shapes.items()}
    rows = spark.createDataFrame([(b, i, r.tolist()) for b, m in x.items() for i, r in enumerate(m)], "block_id long, id long, x array<int>").repartition(3)
    want, near = set(), set()
    for b, m in x.items():
        cost = distance.matrix(m.T if columns else m, kind)
        want |= {(b, i, j, int(cost[i, j])) for i in range(len(cost)) for j in range(len(cost))}
        for i in range(len(cost)) if len(cost) > 1 else ():
            d = [(int(cost[i, j]), j) for j in range(len(cost)) if j != i]
            near.add((b, i, min(d)[1], min(d)[0], int(cost[i].sum())))
    for tile in (1, 3, 4, 512):
        assert set(map(tuple, distance.pairs(rows, kind, columns, tile).collect())) == {r for r in want if r[1] < r[2]}
        whole = distance.pairs(rows, kind, columns, tile, whole=True).collect()
        assert len(whole) == len(want) and set(map(tuple, whole)) == want
        assert set(map(tuple, distance.nearest(rows, kind, columns, tile).collect())) == near


def test_no_task_holds_more_than_two_tiles(spark):
    rows = spark.createDataFrame([(0, i, list(range(100))) for i in range(8)], "block_id long, id long, x array<int>")
    packed = distance.tiles(rows, True, 16)
    assert sorted((r.tile, r.n) for r in packed.collect()) == [(t, 16) for t in range(6)] + [(6, 4)]
    with pytest.raises(KeyError):
        distance.pairs(rows, "unknown")


@pytest.mark.parametrize("lengths", [[1], [2], [9, 1, 1, 2, 3], [1] * 17, [2] * 9, [3, 1] * 40, []])
def test_lengths_are_read_by_doubling_jumps(lengths):
    raw = bitpack.lengths_bytes(np.array(lengths, np.int64))
    assert bitpack.lengths_of(raw).tolist() == lengths
    if len(raw) > 6:
        with pytest.raises(ValueError):
            bitpack.lengths_of(raw[:-1])


# --- the store in tiles


def tiled(spark, tmp_path, name="store", **options):
    path = str(tmp_path / name)
    Engine(spark, EncodeOptions(block_size=64, **options)).encode_rows(fixture_rows(spark, SF), path)
    return path


def bytes_read(df):
    """Bytes of the files that a scan of blocks opens, without the small tables."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = df.select("*")
        again.collect()
        leaves = again._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(k) for k in range(leaves.size())]
        found = [s.metrics().get("filesSize").get().value() for s in scans if "/blocks" in s.toString() or "payload" in s.toString()]
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    assert found
    return sum(found)


def test_named_samples_prune_the_scan(spark, tmp_path):
    path = tiled(spark, tmp_path, tile_samples=2, coder="raw")
    read = [bytes_read(store.scan(spark, path, columns=c)[0]) for c in ([3], [3, 2, 3], [3, 9], list(range(10)))]
    assert read[0] == read[1] < 0.3 * read[3] and read[0] < read[2] < 0.5 * read[3]
    plan = store.read(spark, path, columns=[3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tile" in plan or re.search(r"PartitionFilters: \[.*tile#\d+ (IN|= 1)", plan)
    assert "PushedFilters: [IsNotNull(min_pos)" in store.read(spark, path, 2000, 2100, columns=[3])._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("tile", [1, 3, 10, 50, None])
def test_tiles_give_the_rows_of_one_store(spark, tmp_path, tile):
    path = tiled(spark, tmp_path, tile_samples=tile, sort_cols=True)
    rows = fixture_rows(spark, SF)
    assert tuple(verify.row_summary(store.read(spark, path), rows).first()) == (4000, 4000, 0)
    for columns in ([4], [9, 0, 9, 5], [], list(range(10))):
        got = store.read(spark, path, 1500, 2200, columns=columns)
        want = access.pick(rows.where(F.col("pos").between(1500, 2200)), columns)
        assert verify.row_summary(got, want).first().n_differ == 0 and got.count() == want.count()
    r = store.counts(spark, path).first()
    n = -(-10 // (tile or 10))
    assert (r.n_variants, r.n_samples, r.n_blocks) == (200, 10, 4 * n)
    store.check(spark, path)
    units = store.blocks_of(spark, path).groupBy("au_id").agg(F.count_distinct("tile").alias("tiles"), F.count_distinct("set_id").alias("sets")).collect()
    assert {(u.tiles, u.sets) for u in units} == {(1, 1)}
    with pytest.raises(ValueError, match="outside"):
        store.read(spark, path, columns=[10])


def test_units_over_many_spans(spark, monkeypatch):
    rng = np.random.default_rng(1)
    sets = np.repeat(rng.integers(0, 3, 40), rng.integers(1, 30, 40)).tolist()
    named = spark.createDataFrame(list(enumerate(sets)), "block_id long, set_id long")
    want, unit, filled = {}, -1, 0
    for b, x in enumerate(sets):
        new = b == 0 or x != sets[b - 1] or filled == 5
        unit, filled = unit + new, 1 if new else filled + 1
        want[b] = unit
    assert {r.block_id: r.au_id for r in blocks.number_units(named, 5).collect()} == want
    monkeypatch.setattr(blocks, "SPAN", 16)
    assert {r.block_id: r.au_id for r in blocks.number_units(named, 5).collect()} == want


def test_empty_store(spark, tmp_path):
    path = str(tmp_path / "empty")
    store.write(fixture_rows(spark, SF).where("v < 0"), path)
    assert store.read(spark, path).count() == 0 and store.counts(spark, path).first().n_blocks == 0


def test_blocks_of_the_size_asked_for(spark, tmp_path):
    rows = fixture_rows(spark, SF)
    mixed = rows.withColumn("contig", F.when(F.col("v") < 90, "1").otherwise("2")).withColumns({
        "ploidy": F.when(F.col("v") % 7 == 0, 3).otherwise(2),
        "alleles": F.when(F.col("v") % 7 == 0, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda s: F.concat(F.slice("alleles", s * 2 + 1, 2), F.array(F.lit(1)))))).otherwise(F.col("alleles")),
        "phases": F.when(F.col("v") % 7 == 0, F.flatten(F.transform("phases", lambda p: F.array(p, F.lit(1))))).otherwise(F.col("phases")),
    })
    path, engine = str(tmp_path / "blocks"), Engine(spark, EncodeOptions(block_size=25))
    engine.encode_rows(mixed, path)
    index = store.index_of(spark, path).orderBy("block_id").collect()
    assert [r.n_rows for r in index] == [25, 25, 25, 15, 25, 25, 25, 25, 10] and [r.contig for r in index] == ["1"] * 4 + ["2"] * 5
    from varloom.operators import text

    got = {r.v: r.gts for r in engine.decode_rows(path).collect()}
    assert got == {r.v: r.gts for r in text.row_genotypes(mixed).collect()}
    kept = str(tmp_path / "kept")
    Engine(spark, EncodeOptions(block_size=None)).encode_rows(rows, kept)
    assert [r.n_rows for r in store.index_of(spark, kept).orderBy("block_id").collect()] == [64, 64, 64, 8]


def test_a_damaged_phase_or_position_is_found(spark, tmp_path):
    rows = fixture_rows(spark, SF)
    found = store.read(spark, tiled(spark, tmp_path))
    differ = lambda a: verify.row_summary(a, rows).first().n_differ
    assert differ(found) == 0
    assert differ(found.withColumn("phases", F.transform("phases", lambda x: 1 - x))) == 2000
    assert differ(found.withColumn("phases", F.when(F.col("v") == 7, F.transform("phases", lambda x, k: F.when(k == 3, 1 - x).otherwise(x))).otherwise(F.col("phases")))) == 1
    assert differ(found.withColumn("pos", F.when(F.col("v") == 7, -1).otherwise(F.col("pos")))) == 1
    assert differ(found.where("v <> 7")) == 20 + 10 + 1


# --- plans


def test_pick_cuts_samples_before_anything_is_exploded(spark):
    plan = queries.gt_range_sample_query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan  # the keys of the fixture are dealt out
    with pytest.raises(Exception, match="unknown sample"):
        access.select_samples(queries._samples(spark, SF), ["S7", "X"]).collect()


def test_cell_operators_do_not_broadcast_cells(spark):
    cells = fixture_cells(spark, SF)
    stats = blocks.statistics(cells)
    matrix = layout.flatten(recode.recode(cells, stats))
    rows = binarize.row_bits(matrix)
    order = tour.tour(distance.vectors(matrix, "col_id", "row_in_block"))
    split = binarize.row_split(matrix, rows)
    for df in (matrix, binarize.bit_planes(matrix, stats), split, binarize.from_row_split(split, rows), tour.apply(matrix, order, "col_id")):
        for part in broadcasts(df):
            assert "Generate" not in part, part
