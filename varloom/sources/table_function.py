"""The block decoder as a table function of SQL: SELECT * FROM decode_blocks(TABLE(...), start, end)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from varloom.sources import store


class DecodeBlocks:
    """Variant rows of stored blocks (`store.scan`) given as a table, of positions start to end, or all.

    The tiles of a block must follow each other: TABLE(...) PARTITION BY (block_id) does that for a store in several tiles.
    """

    def __init__(self) -> None:
        self.held: list[Row] = []
        self.range: tuple[int | None, int | None] = (None, None)

    def eval(self, row: Row, start: int | None = None, end: int | None = None) -> Iterator[tuple]:
        self.range = (start, end)
        if self.held and self.held[-1].block_id != row.block_id:
            yield from self._decoded()
        self.held.append(row)

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            yield from self._decoded()

    def _decoded(self) -> Iterator[tuple]:
        tiles, self.held = sorted(self.held, key=lambda r: r.tile), []
        for r in store.decoded_rows(tiles, *self.range, None).itertuples(index=False):
            yield int(r.v), r.contig, int(r.pos), int(r.block_id), int(r.row_in_block), int(r.ploidy), r.alleles.tolist(), r.phases.tolist()


def register(spark: SparkSession, name: str = "decode_blocks") -> None:
    spark.udtf.register(name, F.udtf(DecodeBlocks, returnType=store._ROWS))


def view(spark: SparkSession, path: str, name: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """A temporary view of a store's blocks for SQL; blocks outside of the range are left out."""
    found = store.scan(spark, path, start, end)[0]
    found.createOrReplaceTempView(name)
    return found
