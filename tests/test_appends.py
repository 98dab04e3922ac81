"""Appends to a store and streams into one: any cut gives the blocks of one write."""

import random

import pytest
from pyspark.sql import functions as F

from varloom.operators import text, verify
from varloom.operators.matrices import EncodeOptions
from varloom.plans.engine import Engine
from varloom.sources import store, versions
from varloom.sources.cells import fixture_rows
from varloom.streaming import blocks as streamed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    """Two contigs; a third copy in some variants of the second."""
    made = fixture_rows(spark, SF).withColumn("contig", F.when(F.col("v") < 90, "1").otherwise("2"))
    long = (F.col("v") > 150) & (F.col("v") % 7 == 0)
    third = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda s: F.concat(F.slice("alleles", s * 2 + 1, 2), F.array(F.lit(1)))))
    made = made.withColumns({"ploidy": F.when(long, 3).otherwise(2), "alleles": F.when(long, third).otherwise(F.col("alleles")), "phases": F.when(long, F.flatten(F.transform("phases", lambda p: F.array(p, F.lit(1))))).otherwise(F.col("phases"))})
    return made.cache()


def stored(spark, path):
    """What a store holds of each block, bytes included."""
    names = ("block_id", "contig", "min_pos", "max_pos", "first_v", "n_rows", "tile", "au_id", "set_id", "positions", "payload")
    return sorted(str(r) for r in store.blocks_of(spark, path).select(*names).collect()), sorted(str(r) for r in store.parameters_of(spark, path).join(store.blocks_of(spark, path).select("set_id").distinct(), "set_id", "left_semi").collect())


def lines(df):
    return {r.v: (r.contig, r.pos, r.gts) for r in text.row_genotypes(df).collect()}


def in_pieces(engine, rows, path, cuts):
    cuts = [0, *cuts, 200]
    for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = rows.where(F.col("v").between(low, high - 1))
        (engine.append_rows if k else engine.encode_rows)(part if k % 2 else part.withColumn("v", F.col("v") - low), path)


@pytest.mark.parametrize("cuts", [[1, 3], [88, 90, 91, 199], [90, 90, 150]])
def test_appends_equal_one_write(spark, tmp_path, rows, cuts):
    engine = Engine(spark, EncodeOptions(block_size=25, sort_cols=True, solver="nn_direct"))
    engine.encode_rows(rows, str(tmp_path / "once"))
    in_pieces(engine, rows, str(tmp_path / "pieces"), cuts)
    assert stored(spark, str(tmp_path / "pieces")) == stored(spark, str(tmp_path / "once"))
    assert lines(store.read(spark, str(tmp_path / "pieces"))) == lines(rows)
    store.check(spark, str(tmp_path / "pieces"))


def test_units_go_on_until_they_are_full(spark, tmp_path, rows):
    """Blocks of one variant with one set: more than a unit's blocks."""
    same = rows.where("v < 90").withColumns({"alleles": F.transform("alleles", lambda a: F.lit(1)), "phases": F.transform("phases", lambda a: F.lit(1))})
    many = same.unionByName(same.withColumns({"v": F.col("v") + 90, "pos": F.col("pos") + 5000})).unionByName(same.withColumns({"v": F.col("v") + 180, "pos": F.col("pos") + 9000})).cache()
    engine = Engine(spark, EncodeOptions(block_size=1, coder="raw"))
    engine.encode_rows(many.where("v < 200"), str(tmp_path / "s"))
    engine.append_rows(many.where("v >= 200"), str(tmp_path / "s"))
    assert [r["count"] for r in store.blocks_of(spark, str(tmp_path / "s")).groupBy("au_id").count().orderBy("au_id").collect()] == [255, 15]


def test_tiles_take_appends(spark, tmp_path, rows):
    engine, path = Engine(spark, EncodeOptions(block_size=32, tile_samples=4)), str(tmp_path / "s")
    in_pieces(engine, rows, path, [50, 120])
    assert lines(store.read(spark, path)) == lines(rows)
    got = engine.decode_rows(path, (1400, 2000), ["S9", "S0"])
    assert {r.v: r.gts for r in got.collect()} == {r.v: [r.gts[9], r.gts[0]] for r in text.row_genotypes(rows.where(F.col("pos").between(1400, 2000))).collect()}
    store.check(spark, path)


def test_versions_switch_at_once(spark, tmp_path, rows):
    engine, path = Engine(spark, EncodeOptions(block_size=25)), str(tmp_path / "s")
    engine.encode_rows(rows.where("v < 60"), path)
    before, version = stored(spark, path), versions.current(spark, path)
    bad = rows.where("v >= 60").withColumn("alleles", F.when(F.col("v") == 190, F.raise_error(F.lit("broken")).cast("array<int>")).otherwise(F.col("alleles")))
    with pytest.raises(Exception, match="broken"):
        engine.append_rows(bad, path)
    assert stored(spark, path) == before
    # Tables of an attempt that was never committed are not seen.
    store.blocks_of(spark, path).withColumn("part", F.lit(7)).write.mode("append").partitionBy("part", "tile").parquet(f"{path}/blocks")
    assert stored(spark, path) == before
    engine.append_rows(rows.where("v >= 60"), path)
    assert lines(store.read(spark, path)) == lines(rows)
    with pytest.raises(ValueError, match="by another"):
        versions.commit(spark, path, version | {"number": 1})
    assert versions.current(spark, path)["number"] == 1 and not [p for p in (tmp_path / "s" / "log").iterdir() if p.name.startswith("_")]


def test_rows_must_follow(spark, tmp_path, rows):
    engine, path = Engine(spark, EncodeOptions(block_size=25)), str(tmp_path / "s")
    with pytest.raises(ValueError, match="no store"):
        engine.append_rows(rows, path)
    engine.encode_rows(rows.where("v < 120"), path)
    for late in ("v BETWEEN 100 AND 130", "v BETWEEN 10 AND 20"):
        with pytest.raises(ValueError, match="follow|ended"):
            engine.append_rows(rows.where(late), path)
    engine.append_rows(rows.where("v < 0"), path)
    assert store.read(spark, path).count() == 120
    kept = str(tmp_path / "kept")
    Engine(spark, EncodeOptions(block_size=None)).encode_rows(fixture_rows(spark, SF), kept)
    with pytest.raises(ValueError, match="of its own"):
        engine.append_rows(rows, kept)


def test_a_stream_gives_the_blocks_of_one_write(spark, tmp_path, rows):
    """Batches of any cut, one of them run again after the store had it."""
    names = ["v", "contig", "pos", "ploidy", "alleles", "phases"]
    options = EncodeOptions(block_size=25, sort_cols=True)
    Engine(spark, options).encode_rows(rows, str(tmp_path / "once"))
    source, path = tmp_path / "source", str(tmp_path / "stream")
    cuts = [0, *sorted(random.Random(5).sample(range(1, 200), 3)), 200]
    for low, high in zip(cuts, cuts[1:], strict=False):
        rows.where(F.col("v").between(low, high - 1)).select(*names).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(rows.select(*names).schema).parquet(str(source))
        query = streamed.encode_stream(stream, path, str(tmp_path / "state"), options)
        query.processAllAvailable()
        query.stop()
        assert store.read(spark, path).count() == high
    assert stored(spark, path) == stored(spark, str(tmp_path / "once"))
    number = versions.current(spark, path)["batch"]
    store.append(rows.where("v >= 150"), path, number)
    assert store.read(spark, path).count() == 200 and verify.row_summary(store.read(spark, path), store.read(spark, str(tmp_path / "once"))).first().n_differ == 0
