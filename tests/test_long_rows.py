"""Rows of many samples: what a scan, a sort or a solver holds does not follow the length of a row."""

import lzma
import re

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from varloom import queries
from varloom.functions import planes
from varloom.operators import blocks, container, distance, matrices, tour, verify
from varloom.sources import cells, scratch, store
from varloom.sources.scratch import written


def _wide(spark, variants=128, samples=500):
    rng = np.random.default_rng(3)
    rows = [(v, "1", 7 * v, v // 64, v % 64, 2, rng.integers(-2, 3, 2 * samples).tolist(), rng.integers(0, 2, samples).tolist()) for v in range(variants)]
    return spark.createDataFrame(rows, store._ROWS), rows


def test_row_groups_of_long_rows_are_bounded(spark):
    own = lambda df: [pq.ParquetFile(f.removeprefix("file:")).metadata for f in written(df, "long", long_rows=True).inputFiles()]
    repeated = own(spark.range(0, 2500, 1, 1).select("id", F.expr("unhex(repeat(sha2(cast(id as string), 512), 40))").alias("x")))
    mixed = own(spark.range(0, 1500, 1, 1).select("id", F.expr("unhex(array_join(transform(sequence(1, 300), i -> sha2(cast(id * 1000 + i as string), 512)), ''))").alias("x")))  # 19 kB a row
    for found, rows in ((repeated, 2500), (mixed, 1500)):
        groups = [m.row_group(k) for m in found for k in range(m.num_row_groups)]
        assert sum(g.num_rows for g in groups) == rows and max(g.num_rows for g in groups) <= 1024
        assert max(g.total_byte_size for g in groups) < 16 << 20


def test_rows_are_stored_as_bytes(spark):
    df, rows = _wide(spark, 64)
    found = store._packed(df).orderBy("v").collect()
    assert all(len(r["alleles"]) == 1000 and np.frombuffer(r["alleles"], np.int8).tolist() == given[6] for r, given in zip(found, rows, strict=True))


def test_facts_are_measured_before_they_are_grouped(spark):
    df, rows = _wide(spark)
    found = blocks.facts(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    sorts = [x for x in plan.splitlines() if re.search(r"\bSort\b|SortAggregate", x)]
    assert "MapInArrow" in plan and not any("alleles" in x for x in sorts)
    for r in found.collect():
        own = np.array([x[6] for x in rows if x[3] == r["block_id"]])
        assert (r["max_allele"], r["any_missing"], r["any_absent"]) == (own.max(), int((own == -1).any()), int((own == -2).any()))


def test_a_tour_of_many_columns_holds_no_matrix(monkeypatch):
    x = np.random.default_rng(4).integers(0, 2, (tour.MOST_MATRIX + 50, 64)).astype(np.uint8)
    monkeypatch.setattr(distance, "matrix", lambda *a: (_ for _ in ()).throw(AssertionError("a matrix of all distances")))
    assert tour.SOLVERS["nn"].order(x).tolist() == tour.nearest_packed(planes.packed(x)).tolist()


def test_round_trips_move_bytes(spark):
    sf = "/root/testdata/sf0.001"
    packed, given = cells.fixture_packed(spark, sf), cells.fixture_rows(spark, sf)
    assert store.unpacked(packed).orderBy("v").collect() == given.orderBy("v").collect() == store.unpacked(store._packed(given)).orderBy("v").collect()
    arrays = lambda df: re.search(r"array<int>|alleles#\d+: array", df._jdf.queryExecution().analyzed().treeString())
    path = queries._stored(spark, sf, sort_rows=True)
    found = store.read(spark, path, packed=True)
    assert dict(found.dtypes)["alleles"] == dict(packed.dtypes)["alleles"] == "binary" and not arrays(found)
    assert store.unpacked(found).orderBy("v").collect() == store.read(spark, path).orderBy("v").collect()


def test_packed_rows_that_differ_are_counted(spark):
    df, rows = _wide(spark, 64)
    rows = [list(r) for r in rows]
    rows[3][6] = [300, *rows[3][6][1:]]  # needs two bytes a number
    rows[5][7] = [1 - x for x in rows[5][7]]
    rows[9][2] += 1
    other = spark.createDataFrame([tuple(r) for r in rows[:63]], store._ROWS)  # the last is missing: 1,000 alleles, 500 phases and its place
    found = verify.packed_summary(store._packed(df), store._packed(other), store.unpacked).collect()
    assert found == verify.row_summary(df, other).collect() and found[0]["n_differ"] == 1 + 500 + 1 + 1501


def test_units_are_not_lists_of_an_aggregate(spark):
    blocks_ = spark.createDataFrame([(b, b // 3, 0, bytes([b]) * 50) for b in (4, 0, 5, 2, 1, 3)], "block_id long, au_id long, set_id long, payload binary")
    units = container.units_to_bytes(blocks_)
    plan = units._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
    found = {r["au_id"]: container.unit_of(bytes(r["unit"])) for r in units.collect()}
    assert found == {u: (u, 0, [bytes([b]) * 50 for b in range(3 * u, 3 * u + 3)]) for u in (0, 1)}
    joined = queries.units_roundtrip(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("payload" in x for x in joined.splitlines() if "Window" in x)


def test_small_matrices_take_small_dictionaries():
    x = np.random.default_rng(5).integers(0, 2, (64, 14)).astype(np.uint8)
    encode, decode = matrices.CODECS["lzma"]
    for raw in (b"", b"x", x.tobytes(), bytes(100_000)):
        assert decode(encode(raw)) == raw
        assert lzma.decompress(encode(raw), memlimit=1 << 20) == raw  # eight times this for the usual dictionary


def test_tours_by_words_keep_their_order():
    rng = np.random.default_rng(6)
    for bits in (5, 64, 65, 130, 192, 256, 300):
        for depth in (1, 2):
            words = planes.packed(rng.integers(0, 1 << depth, (80, bits)), depth)
            for kind in planes.KINDS:
                cost = np.array([planes.to_one(words, k, kind) for k in range(80)])
                assert tour.nearest_packed(words, kind, 3).tolist() == tour.nearest(cost, 3).tolist()
                if kind in planes.MARKED:
                    by_word = np.ascontiguousarray(np.moveaxis(words, 2, 0))
                    assert planes.counted(by_word, by_word[..., 7], kind).tolist() == cost[7].tolist()


def test_what_a_task_sorts_is_bounded_by_bytes(spark, monkeypatch, tmp_path):
    df, _ = _wide(spark, 320)  # 5 blocks of 64 rows of 1,500 bytes
    monkeypatch.setattr(scratch, "TASK_BYTES", 1 << 14)
    dealt, own = [], store.spread
    monkeypatch.setattr(store, "spread", lambda *a, **k: dealt.append(own(*a, **k).rdd.getNumPartitions()) or own(*a, **k))
    for name, options in (("whole", {}), ("tiles", {"tile_samples": 100})):
        path = f"{tmp_path}/{name}"
        store.write(df, path, matrices.EncodeOptions(block_size=64, coder="raw", **options), block_size=64)
        assert dealt.pop() >= 320 * 1500 >> 14
        found = store.read(spark, path)
        assert found.orderBy("v").collect() == df.orderBy("v").collect()
        assert not dealt or dealt.pop() > 4  # tiles of a block meet by a shuffle
        columns = [450, 3, 450]
        some = store.read(spark, path, 700, 2100, columns=columns).orderBy("v").collect()
        assert [r["pos"] for r in some] == [7 * v for v in range(100, 301)]
        given = {r["v"]: r["alleles"] for r in df.collect()}
        assert all(r["alleles"] == [given[r["v"]][2 * c + k] for c in columns for k in (0, 1)] for r in some)
        dealt.clear()
