"""Streams of cells: stores of micro-batches, batches run again, and running statistics."""

import pytest

from varloom.operators import blocks
from varloom.sources import store
from varloom.streaming import blocks as streamed

SCHEMA = "v long, s long, k int, block_id long, row_in_block long, pos long, allele int, phased int"


@pytest.fixture
def source(spark, tmp_path):
    rows = [(v, s, k, v // 2, v % 2, 10 * v, (v * s + k) % 3 - (v == 3), (v + s) % 2) for v in range(6) for s in range(3) for k in range(2)]
    path = str(tmp_path / "cells")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    return path


def test_batches_become_stores(spark, source, tmp_path):
    out, cells = str(tmp_path / "stores"), spark.read.parquet(source)
    for attempt in ("first", "again"):  # a new checkpoint runs batch 0 once more
        query = streamed.encode_batches(spark.readStream.schema(SCHEMA).parquet(source), out, str(tmp_path / attempt))
        query.processAllAvailable()
        query.stop()
        found = store.read_cells(spark, f"{out}/batch=0").select(*cells.columns)
        assert sorted(found.collect()) == sorted(cells.collect())


def test_running_statistics(spark, source, tmp_path):
    stats = streamed.running_statistics(spark.readStream.schema(SCHEMA).parquet(source))
    query = stats.writeStream.format("memory").queryName("block_statistics").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    want = blocks.statistics(spark.read.parquet(source))
    assert sorted(map(str, spark.table("block_statistics").collect())) == sorted(map(str, want.collect()))
