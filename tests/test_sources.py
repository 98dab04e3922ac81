"""Block-compressed VCF as a data source, digests in comparisons, the decoder in SQL."""

import gzip
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.operators import layout, text, verify
from varloom.plans.engine import Engine, EncodeOptions
from varloom.sources import bgzf, store, table_function, vcf, vcf_format
from varloom.sources.cells import fixture_cells, fixture_rows

SF = "/root/testdata/sf0.001"
HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n"


def text_of(n=3000, seed=0):
    rng = np.random.default_rng(seed)
    gts = ["0|1", "1/0", ".", "./.", "0|1|2", "10|3"]
    lines = []
    for k in range(n):
        extra = k % 3
        own = [gts[i] + (":7" if extra == 1 else "") for i in rng.integers(0, len(gts), 2)]
        keys = ("GT", "GT:DP", "DP:GT")[extra]
        own = [f"4:{x}" for x in own] if extra == 2 else own
        lines.append(f"{1 + k // 1200}\t{10 + k % 1200}\t.\t{'ACGT'[k % 4] * int(rng.integers(1, 60))}\tT\t.\t.\t.\t{keys}\t" + "\t".join(own))
    return HEAD + "\n".join(lines) + "\n"


def written(path, raw, kind="bgzf", member=None):
    if kind == "bgzf":
        step = member or bgzf.MEMBER
        data = b"".join(bgzf.member(raw[k : k + step]) for k in range(0, len(raw), step)) + bgzf.END
    else:
        data = gzip.compress(raw) if kind == "gzip" else raw
    path.write_bytes(data)
    return str(path)


def test_members_are_gzip():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 200_000).astype(np.uint8).tobytes() + b"a" * 100_000
    data = b"".join(bgzf.compressed(iter([raw[:70_000], b"", raw[70_000:]])))
    assert gzip.decompress(data) == raw and data.endswith(bgzf.END)
    file = io.BytesIO(data)
    places = [at for at, _ in bgzf.members(file, 0)]
    assert b"".join(x for _, x in bgzf.members(file, 0)) == raw and len(places) == 6
    for start in (0, 1, places[2], places[2] + 1, places[-1]):
        assert bgzf.first_member(file, start) == next(p for p in places if p >= start)
    assert bgzf.first_member(file, len(data) - 5) is None
    with pytest.raises(ValueError):
        list(bgzf.members(io.BytesIO(data[:1000]), 0))


@pytest.mark.parametrize("kind", ["plain", "bgzf"])
@pytest.mark.parametrize("end", ["\n", ""])
def test_every_line_belongs_to_one_split(tmp_path, kind, end):
    """Splits of every size, lines of any length, members that begin or end at a line feed."""
    rng = np.random.default_rng(4)
    lines = ["x" * int(n) for n in rng.choice([0, 1, 5, 40, 300], 120)]
    raw = ("\n".join(lines) + end).encode()
    want = [x.encode() for x in (lines if end or lines[-1] else lines[:-1])]
    for member in (7, 41, 400):
        path = written(tmp_path / "a.vcf.gz", raw, kind, member)
        size = len((tmp_path / "a.vcf.gz").read_bytes())
        for step in (1 if kind == "plain" else 97, 64, 150, 1000, size, size + 5):
            got = []
            with open(path, "rb") as file:
                for k, low in enumerate(range(0, size, step)):
                    got += list(vcf_format.lines_of(file, vcf_format.Split(k, 0, path, kind, low, min(low + step, size))))
            assert got == want, (member, step)


@pytest.mark.parametrize("kind", ["plain", "bgzf", "gzip"])
def test_rows_of_any_split_size(spark, tmp_path, kind):
    raw = text_of().encode()
    name = str(tmp_path / "a.vcf") if kind == "plain" else str(tmp_path / "a.vcf.gz")
    written(tmp_path / name.rsplit("/", 1)[1], raw, kind, 5000)
    (tmp_path / "b.vcf").write_bytes(raw)
    want = [(r.v, r.contig, r.pos, tuple(r.gt)) for r in vcf.read_variants(spark, str(tmp_path / "b.vcf")).orderBy("v").collect()]
    for size in (3000, 20_000, 1 << 20):
        df = vcf_format.read(spark, name, splitBytes=size)
        found = df.orderBy("file", "place").collect()
        assert sorted((r.contig, r.pos, tuple(r.gt)) for r in found) == sorted(w[1:] for w in want)
        assert [(r.contig, r.pos) for r in found] == [w[1:3] for w in want]
        tasks = df.rdd.getNumPartitions()
        assert tasks == 1 if kind == "gzip" else tasks > 5 if size == 3000 else True
    got = vcf.read_variants(spark, name)
    assert [(r.v, r.contig, r.pos, tuple(r.gt)) for r in got.orderBy("v").collect()] == want
    assert [r.name for r in vcf.read_samples(spark, name).orderBy("s").collect()] == ["A", "B"]
    assert [r.value for r in vcf.read_header(spark, name).orderBy("line_no").collect()] == HEAD.splitlines()


@pytest.mark.parametrize("sorted_", ["false", "true"])
def test_conditions_reach_the_reader(spark, tmp_path, sorted_):
    path = written(tmp_path / "a.vcf.gz", text_of().encode(), "bgzf", 4000)
    every = vcf_format.read(spark, path).collect()
    cases = {
        "contig = '2' AND pos BETWEEN 100 AND 110": lambda r: r.contig == "2" and 100 <= r.pos <= 110,
        "contig IN ('1', '3') AND pos < 12": lambda r: r.contig in "13" and r.pos < 12,
        "pos = 50 OR contig = '9'": lambda r: r.pos == 50, "contig = '2' AND pos > 1205 AND size(gt) = 2": lambda r: r.contig == "2" and r.pos > 1205,
        "contig > '2' AND pos >= 600": lambda r: r.contig > "2" and r.pos >= 600, "contig IS NULL": lambda r: False,
    }
    for where, keep in cases.items():
        df = vcf_format.read(spark, path, splitBytes=5000, sorted=sorted_).where(where)
        assert sorted((r.contig, r.pos) for r in df.collect()) == sorted((r.contig, r.pos) for r in every if keep(r)), where
    plan = vcf_format.read(spark, path).where("contig = '2' AND pos < 100")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "out.vcf.gz")
    rows = fixture_rows(spark, SF)
    vcf.write_vcf(text.row_genotypes(rows), path, [f"N{k}" for k in range(10)], files=3)
    names = sorted(p.name for p in (tmp_path / "out.vcf.gz").iterdir())
    assert len(names) == 3 and all(n.endswith(".vcf.gz") for n in names)
    assert gzip.open(f"{path}/{names[0]}").readline() == b"##fileformat=VCFv4.2\n"
    store_path = str(tmp_path / "store")
    Engine(spark, EncodeOptions(block_size=64)).encode_vcf(path, store_path)
    texts = lambda df: {r.v: (r.pos, r.gts) for r in text.row_genotypes(df).collect()}
    assert texts(store.read(spark, store_path)) == texts(rows)
    with pytest.raises(Exception, match="FileExists"):
        vcf.write_vcf(text.row_genotypes(rows), path, ["N"] * 10)
    broken = text.row_genotypes(rows).withColumn("gts", F.when(F.col("v") == 150, F.raise_error(F.lit("broken")).cast("array<string>")).otherwise(F.col("gts")))
    with pytest.raises(Exception, match="broken"):
        vcf.write_vcf(broken, str(tmp_path / "bad.vcf.gz"), ["N"] * 10, files=2)
    assert not (tmp_path / "bad.vcf.gz").exists() or not list((tmp_path / "bad.vcf.gz").glob("*.gz"))
    with pytest.raises(Exception, match="FileNotFound|No such file"):
        vcf.read_variants(spark, str(tmp_path / "none.vcf.gz")).count()


# --- digests


def test_digests_do_not_depend_on_order_and_see_every_change(spark):
    cells = fixture_cells(spark, SF)
    same = lambda a, b: [r.differ for r in verify.spans(a, b, verify._CELL).orderBy("span").collect()]
    assert same(cells, cells.repartition(3).orderBy(F.rand(1))) == [False]
    for changed in (cells.where("v <> 3"), cells.unionByName(cells.where("v = 3 AND s = 2")), cells.withColumn("allele", F.when((F.col("v") == 3) & (F.col("s") == 1), None).otherwise(F.col("allele"))), cells.where("v < 0")):
        assert same(cells, changed) == [True] == same(changed, cells)
    twice = cells.where("v = 3")
    assert same(cells, cells.unionByName(twice).unionByName(twice)) == [True]  # hashes cancel, counts do not


def test_equal_spans_are_not_joined(spark, monkeypatch):
    monkeypatch.setattr(verify, "SPAN", 10)
    cells = fixture_cells(spark, SF)
    changed = cells.withColumn("allele", F.when(F.col("v").isin(3, 155), F.col("allele") + 7).otherwise(F.col("allele")))
    found = verify.spans(cells, changed, verify._CELL)
    assert sorted(r.span for r in found.where("differ").collect()) == [0, 15] and found.count() == 20
    assert verify._within(cells, found).count() == 2 * 10 * 20
    assert sorted((r.v, r.s, r.k) for r in verify.differences(cells, changed).collect()) == [(v, s, k) for v in (3, 155) for s in range(10) for k in range(2)]
    assert tuple(verify.summary(cells, changed.where("v < 190")).first()) == (4000, 3800, 40 + 200)
    lines = lambda df: text.lines(text.genotypes(df))
    assert sorted(r.v for r in verify.line_differences(lines(cells), lines(changed)).collect()) == [3, 155]


def test_rows_compared_by_digests(spark, tmp_path):
    rows, path = fixture_rows(spark, SF), str(tmp_path / "s")
    engine = Engine(spark, EncodeOptions(block_size=64, tile_samples=4))
    engine.encode_rows(rows, path)
    assert engine.compare_rows(path, rows).count() == 0
    assert sorted(map(tuple, engine.compare_rows(path, rows.withColumn("contig", F.when(F.col("v") == 9, "X").otherwise(F.col("contig")))).collect())) == [(9, 1)]
    assert engine.compare(path, layout.cells(rows)).count() == 0


# --- the decoder in SQL


@pytest.mark.parametrize("tile", [None, 3])
def test_table_function_equals_the_reader(spark, tmp_path, tile):
    path = str(tmp_path / "s")
    Engine(spark, EncodeOptions(block_size=64, tile_samples=tile)).encode_rows(fixture_rows(spark, SF), path)
    table_function.register(spark)
    table_function.view(spark, path, "packed", 1500, 2000)
    by = "PARTITION BY (block_id)" if tile else ""
    got = spark.sql(f"SELECT * FROM decode_blocks(TABLE(packed) {by}, 1500L, 2000L)")
    want = store.read(spark, path, 1500, 2000)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.schema == want.schema
    table_function.view(spark, path, "everything")
    assert spark.sql(f"SELECT v FROM decode_blocks(TABLE(everything) {by})").count() == 200


# --- the container as files


def test_container_files(spark, tmp_path):
    from varloom.sources import container_format as cf

    path, out = str(tmp_path / "s"), str(tmp_path / "out")
    Engine(spark, EncodeOptions(block_size=8, sort_rows=True, coder="raw")).encode_rows(fixture_rows(spark, SF), path)
    cf.write(spark, path, out, files=3)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(names) > 1 and all(n.endswith(".units") for n in names)
    sets = sorted(map(str, store.parameters_of(spark, path).drop("depth").collect()))
    assert sorted(map(str, cf.read_sets(spark, out).drop("depth").collect())) == sets
    want = [bytes(r.payload) for r in store.blocks_of(spark, path).orderBy("block_id").collect()]
    for size in (500, 1 << 20):
        got = cf.read_blocks(spark, out, splitBytes=size).orderBy("au_id", "place").collect()
        assert [bytes(r.payload) for r in got] == want
    assert cf.read(spark, out, splitBytes=500).rdd.getNumPartitions() > cf.read(spark, out).rdd.getNumPartitions()
    order = cf.read(spark, out).orderBy("file", "offset").collect()
    assert [r.kind for r in order] == sorted(r.kind for r in order) and {r.offset for r in order if r.file == 0} >= {0}
    with pytest.raises(Exception, match="FileExists"):
        cf.write(spark, path, out)
    whole = b"".join((tmp_path / "out" / n).read_bytes() for n in names)
    (tmp_path / "one.units").write_bytes(whole)
    assert cf.read(spark, str(tmp_path / "one.units")).count() == len(order)
    for bad in (whole[:-1], b"\7" + whole[1:], whole + b"\0"):
        (tmp_path / "bad.units").write_bytes(bad)
        with pytest.raises(Exception, match="no whole data unit"):
            cf.read(spark, str(tmp_path / "bad.units")).count()
