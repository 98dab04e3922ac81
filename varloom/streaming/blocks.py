"""Cells and variant rows from a file stream: blocks over micro-batches of any cut, and running statistics of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from varloom.operators import blocks, layout
from varloom.operators.matrices import EncodeOptions
from varloom.sources import store, versions


def running_statistics(cells: DataFrame) -> DataFrame:
    """Block statistics of a stream of cells, kept as state (use the complete or update mode)."""
    return blocks.statistics(cells)


def encode_batches(cells: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of whole blocks becomes a store of its own, `path`/batch=<number>.

    A batch that is run again, after a failure halfway too, replaces its own tables, so no block is stored twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        samples = batch.agg(F.max("s")).first()[0]
        store.write(layout.rows(batch, 0 if samples is None else samples + 1), f"{path}/batch={number}", mode="overwrite")

    return cells.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def encode_stream(rows: DataFrame, path: str, checkpoint: str, options: EncodeOptions | None = None) -> StreamingQuery:
    """A stream of variant rows becomes one store, whatever its micro-batches hold.

    rows: v, contig, pos, ploidy, alleles and phases; each batch holds the next variants.  A block that a batch leaves
    unfinished is the stream's state, and it lies in the store: the next batch completes it, so readers see every row as
    soon as its batch is committed.  The store's version keeps the number of the last batch, so one that is run again is
    stored once.
    """
    options = options or EncodeOptions()
    if options.block_size is None:
        raise ValueError("a stream has no blocks of its own")

    def run(batch: DataFrame, number: int) -> None:
        version = versions.current(batch.sparkSession, path)
        if version is not None:
            store.append(batch, path, number)
        elif not batch.isEmpty():
            given = batch.withColumns({"block_id": F.lit(0).cast("long"), "row_in_block": F.lit(0).cast("long")})
            store.write(given, path, options, mode="overwrite", block_size=options.block_size, batch=number)

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
