"""Hand-checked values on a five by three matrix, edge cases, and the path from VCF text to a store and back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.operators import access, binarize, blocks, codec, container, distance, layout, matrices, recode, text, tour, verify
from varloom.plans.engine import Engine, EncodeOptions
from varloom.sources import store, vcf

ALLELES = ["000130", "310211", "310212", "000131", "00mm31"]
MIXED = ["101", "010", "010", "101", "101"]


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(v, s, k, 0, v, v, -1 if a[2 * s + k] == "m" else int(a[2 * s + k]), int(MIXED[v][s])) for v, a in enumerate(ALLELES) for s in range(3) for k in range(2)]
    return spark.createDataFrame(rows, "v long, s long, k int, block_id long, row_in_block long, pos long, allele int, phased int").cache()


def matrix(cells):
    stats = blocks.statistics(cells)
    return layout.flatten(recode.recode(cells, stats)), stats


def grid(df, row, value="bit"):
    found = {}
    for r in df.collect():
        found.setdefault(r[row], {})[r["col_id"]] = r[value]
    return ["".join(str(c[k]) for k in sorted(c)) for _, c in sorted(found.items())]


def test_statistics(cells):
    r = blocks.statistics(cells).first()
    assert (r.max_allele, r.any_missing, r.any_absent, r.missing_rep, r.absent_rep, r.depth) == (3, 1, 0, 4, None, 3)


def test_planes_and_rows(cells):
    m, stats = matrix(cells)
    planes = binarize.bit_planes(m, stats)
    assert grid(planes.where("plane = 0"), "row_in_block") == ["000110", "110011", "110010", "000111", "000011"]
    assert grid(planes.where("plane = 2"), "row_in_block") == ["000000", "000000", "000000", "000000", "001100"]
    rows = binarize.row_bits(m)
    assert [r.bits for r in rows.orderBy("row_in_block").collect()] == [2, 2, 2, 2, 3]
    split = binarize.row_split(m, rows)
    assert grid(split, "bit_row") == ["000110", "000010", "110011", "100100", "110010", "100101", "000111", "000010", "000011", "000010", "001100"]
    assert codec.lengths_hex(rows).first().hex == "0000000501aac0"
    for back in (binarize.from_row_split(split, rows), binarize.from_bit_planes(planes)):
        assert grid(back, "row_in_block", "allele") == grid(m, "row_in_block", "allele")


def test_distances_and_tour(cells):
    m, _ = matrix(cells)
    split = binarize.row_split(m)
    found = distance.vectors(split, "bit_row", "col_id", "bit")
    first = lambda kind: [r.distance for r in distance.pairs(found, kind).where("i = 0").orderBy("j").collect()]
    assert first("ham") == [1, 4, 2, 3, 3, 1, 1, 2, 1, 2]
    assert first("ham_rl") == [1, 3, 2, 2, 2, 1, 1, 2, 1, 2]
    order = tour.tour(found)
    assert [r.id for r in order.orderBy("step").collect()] == [0, 1, 7, 9, 8, 6, 5, 3, 10, 4, 2]
    assert [r.id for r in tour.inverse(order).orderBy("step").collect()] == [0, 1, 10, 7, 9, 6, 5, 2, 4, 3, 8]
    moved = tour.apply(split, order, "bit_row")
    assert grid(tour.undo(moved, order, "bit_row"), "bit_row") == grid(split, "bit_row")


@pytest.mark.parametrize(("ids", "expected"), [([0, 1, 2, 3, 4], "0538"), ([4, 2, 0, 1, 3], "8816"), ([0], "")])
def test_permutation_bytes(spark, ids, expected):
    order = spark.createDataFrame([(0, k, i) for k, i in enumerate(ids)], "block_id long, step long, id long")
    assert codec.permutation_hex(order).first().hex == expected


def test_parameter_bytes(spark):
    sets = spark.createDataFrame([(0, 1, 0, 3, -1)], "set_id int, any_missing int, any_absent int, depth int, phase int")
    assert codec.parameter_hex(sets).first().hex == "000000000b008040320000"


def test_byte_forms_come_back(spark):
    order = spark.createDataFrame([(0, k, i) for k, i in enumerate([4, 2, 0, 1, 3])], "block_id long, step long, id long")
    assert sorted(map(tuple, codec.permutation_ids(codec.permutation_hex(order).withColumn("n", F.lit(5))).collect())) == sorted(map(tuple, order.collect()))
    rows = spark.createDataFrame([(0, k, b, 0) for k, b in enumerate([2, 1, 9, 2, 3])], "block_id long, row_in_block long, bits long, first_row long")
    assert [(r.bits, r.first_row) for r in codec.lengths_rows(codec.lengths_hex(rows)).orderBy("row_in_block").collect()] == [(2, 0), (1, 2), (9, 3), (2, 12), (3, 14)]


@pytest.mark.parametrize("values", [[-1, -1], [-2, -2], [0, 0], [9, 10], [127, -1]])
def test_recode_round_trip(spark, values):
    cells = spark.createDataFrame([(0, k, a) for k, a in enumerate(values)], "block_id long, k int, allele int")
    assert [r.allele for r in recode.undo(recode.recode(cells)).orderBy("k").collect()] == values


def test_single_difference(spark):
    df = spark.createDataFrame([([0, 1, 1], [1, 1, 1]), ([0, 0, 0], [1, 1, 1]), ([1, 1, 1], [1, 1, 1])], "a array<int>, b array<int>")
    assert [tuple(r) for r in df.select(distance.run_length("a", "b"), distance.run_length("a", "b", parity=True)).collect()] == [(1, 0), (1, 1), (0, 0)]


@pytest.mark.parametrize(("start", "end", "expected"), [(1, 150, [0]), (1, 350, [0, 1, 2]), (150, 260, [0, 1]), (500, 600, []), (200, 200, [0])])
def test_pruning(spark, start, end, expected):
    index = spark.createDataFrame([(0, 100, 200), (1, 201, 300), (2, 301, 400)], "block_id long, min_pos long, max_pos long")
    assert [r.block_id for r in access.prune_blocks(index, start, end).orderBy("block_id").collect()] == expected


def test_samples(spark):
    known = spark.createDataFrame([(0, "A"), (1, "B")], "s long, name string")
    assert [r.s for r in access.select_samples(known, ["B", "A", "B"]).orderBy("ord").collect()] == [1, 0, 1]
    assert access.select_samples(known, ["X"], "ignore").count() == 0
    with pytest.raises(Exception, match="unknown sample"):
        access.select_samples(known, ["X"]).collect()


HEAD = "##fileformat=VCFv4.2\n##source=test\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\tC\n"


def vcf_of(path, records):
    path.write_text(HEAD + "".join(f"{c}\t{p}\t.\tA\tC\t.\t.\t.\t" + "\t".join(g) + "\n" for c, p, *g in records))
    return str(path)


@pytest.fixture(scope="module")
def mixed_vcf(tmp_path_factory):
    records = [
        ("1", 100, "GT", "0|1", "1/0", "./."), ("1", 110, "GT:DP", "10|2:7", "1:3", "0|0:1"), ("1", 120, "DP:GT", "4:.|.", "4:0/3", "4:2|2"),
        ("2", 50, "GT", "0", "1", "1"), ("2", 115, "GT", "1", ".", "0"), ("2", 300, "GT", "0|1|0", "1|1/1", "0/0|1"),
    ]
    return vcf_of(tmp_path_factory.mktemp("vcf") / "mixed.vcf", records)


LINES = ["0|1\t1/0\t./.", "10|2\t1\t0|0", ".|.\t0/3\t2|2", "0\t1\t1", "1\t.\t0", "0|1|0\t1|1/1\t0/0|1"]


@pytest.mark.parametrize("options", [{}, {"binarization": "row_split", "sort_rows": True, "sort_cols": True, "coder": "lzma"}, {"axis": 0, "sort_cols": True, "transpose": True, "distance": "ham_rl", "coder": "raw"}])
def test_vcf_to_store_and_back(spark, mixed_vcf, tmp_path, options):
    path, engine = str(tmp_path / "store"), Engine(spark, EncodeOptions(block_size=2, **options))
    engine.encode_vcf(mixed_vcf, path)
    assert [r.line for r in engine.decode_lines(path).orderBy("v").collect()] == LINES
    assert [r.name for r in spark.read.parquet(f"{path}/samples").orderBy("s").collect()] == ["A", "B", "C"]
    assert [r.value for r in spark.read.parquet(f"{path}/header").orderBy("line_no").collect()] == HEAD.splitlines()
    # the third block of contig 1 ends it: blocks hold one contig, each with its own ploidy
    assert [(r.contig, r.n_rows, r.ploidy) for r in store.index_of(spark, path).orderBy("block_id").collect()] == [("1", 2, 2), ("1", 1, 2), ("2", 2, 1), ("2", 1, 3)]
    some = engine.decode(path, (105, 125), ["C", "A", "C"], contig="1")
    assert [(r.v, r.s, r.gt) for r in some.orderBy("v", "s").collect()] == [(1, 0, "0|0"), (1, 1, "10|2"), (1, 2, "0|0"), (2, 0, "2|2"), (2, 1, ".|."), (2, 2, "2|2")]
    assert [(r.contig, r.pos) for r in engine.decode_rows(path, (105, 125)).orderBy("v").collect()] == [("1", 110), ("1", 120), ("2", 115)]
    assert engine.decode_rows(path, (400, 500)).count() == 0
    assert engine.compare_vcf(path, mixed_vcf).count() == 0
    cells = vcf.cells_of(vcf.read_variants(spark, mixed_vcf), 2)
    assert engine.compare(path, cells).count() == 0
    assert verify.differences(cells, cells.withColumn("allele", F.lit(0))).count() > 0
    with pytest.raises(Exception, match="unknown sample"):
        engine.decode(path, samples=["S0"]).collect()
    sets, units = store.write_units(spark, path)
    assert sorted(map(tuple, container.sets_from_bytes(sets).drop("depth").collect())) == sorted(map(tuple, spark.read.parquet(f"{path}/parameters").drop("depth").collect()))
    parsed = [bytes(r.payload) for r in container.units_from_bytes(units).orderBy("au_id", "place").collect()]
    assert parsed == [bytes(r.payload) for r in store.blocks_of(spark, path).orderBy("block_id").collect()]


def test_vcf_names_and_lines(spark, mixed_vcf, tmp_path):
    assert [r.name for r in vcf.read_samples(spark, mixed_vcf).orderBy("s").collect()] == ["A", "B", "C"]
    with pytest.raises(ValueError, match="not a VCF"):
        vcf.read_variants(spark, "x.txt")
    rows = vcf.rows_of(vcf.read_variants(spark, mixed_vcf), 2)
    vcf.write_lines(text.genotypes(layout.cells(rows)), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 6


def test_numbering_with_small_adaptive_partitions(spark):
    df = spark.range(20_000, numPartitions=7).select(((F.col("id") * 7919) % 20_000).alias("pos"), F.repeat(F.lit("x"), 200).alias("gt"))
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        found = vcf.numbered(df, ["pos"])
        assert found.where("v <> pos").count() == 0 and found.count() == 20_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rows_fill_gaps_and_refuse_collisions(spark):
    schema = "v long, s long, k int, block_id long, row_in_block long, pos long, allele int, phased int"
    some = [(0, 1, 0, 0, 0, 5, 1, 0), (0, 3, 0, 0, 0, 5, 2, 0), (0, 3, 1, 0, 0, 5, 3, 1)]
    row = layout.rows(spark.createDataFrame(some, schema), 5).first()
    assert (row.alleles, row.phases) == ([-2, -2, 1, -2, -2, -2, 2, 3, -2, -2], [0, 0, 0, 1, 0])
    for bad in ([*some, some[1]], [*some, (0, 5, 0, 0, 0, 5, 1, 0)]):
        with pytest.raises(Exception, match="collide"):
            layout.rows(spark.createDataFrame(bad, schema), 5).collect()


@pytest.mark.parametrize("bad", [{"binarization": "x"}, {"axis": 3}, {"distance": "x"}, {"solver": "x"}, {"coder": "x"}, {"preset": 5}, {"block_size": 0}])
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        EncodeOptions(**bad)


def test_wide_block_packs_in_seconds():
    import time

    values, began = np.random.default_rng(1).integers(0, 4, (1024, 5008)), time.time()
    options = EncodeOptions(coder="raw")
    payload = container.payload_of(container.payload_bytes(matrices.encode_block(values, None, 2, (None, None), options)), 2, False, False, False, False, False, False)
    assert (matrices.decode_block(payload, 2, options)[0] == values).all() and time.time() - began < 20


@pytest.mark.parametrize("cut", [0, 1, -1])
def test_damaged_bytes_raise(cut):
    unit = container.unit_bytes(0, 0, [container.block_bytes(b"abc")])
    bad = unit[:-1] if cut == -1 else unit + b"x" if cut else b"\2" + unit[1:]
    with pytest.raises(ValueError):
        container.unit_of(bad)


def test_distances_by_hand():
    x = np.random.default_rng(2).integers(0, 4, (7, 9))
    for kind in distance.KINDS:
        cost = distance.matrix(x, kind)
        for i in range(7):
            for j in range(7):
                d = (x[i] != x[j]).astype(int)
                runs = int(((d == 1) & (np.append(0, d[:-1]) == 0)).sum())
                want = int(d.sum()) if kind == "ham" else 0 if kind == "ham_rl_parity" and d.sum() == 1 and d[0] else runs
                assert cost[i, j] == want


def test_unreadable_allele_raises(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        text.parse(spark.createDataFrame([(0, "0|x")], "v long, line string")).collect()


def test_access_unit_limit(spark):
    rows = [(b, 0, 0, b, 0, b, 1, 1) for b in range(256)]
    cells = spark.createDataFrame(rows, "v long, s long, k int, block_id long, row_in_block long, pos long, allele int, phased int")
    assert [r["count"] for r in blocks.access_units(blocks.parameters(cells)).groupBy("au_id").count().orderBy("au_id").collect()] == [255, 1]
