"""Comparison of cells, variant rows and lines.

Both sides are first digested by spans of variants: digests are counts and sums of hashes, so they do not depend on order,
rows that are there twice do not cancel, and they are combined in the tasks.  Only spans whose digests differ are joined; what is equal is never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.sources.scratch import written

if TYPE_CHECKING:
    from varloom.sources.cells import Block

#: Variants of a span, and spans that are broadcast at most.
SPAN, MOST_SPANS = 1024, 1 << 18

_CELL = ("v", "s", "k", "allele")
_ROW = ("v", "contig", "pos", "ploidy", "alleles", "phases")


def _span(size: int | None = None) -> Column:
    size = SPAN if size is None else size
    return F.floor(F.col("v") / size) if size > 1 else F.col("v")


def digests(df: DataFrame, columns: tuple[str, ...], weight: Column | None = None, size: int | None = None) -> DataFrame:
    """span, n (rows, or the sum of a weight), and an order-free digest of the columns of each span of variants."""
    marked = [x for c in columns for x in (F.col(c), F.col(c).isNull())]  # the hash passes over nulls
    # Ends of two hashes, 28 bits each: their sums hold 2**35 rows of a span.
    ends = {f"{name}{k}": F.sum(end) for name, seed in (("x", 1), ("y", 2)) for h in (F.xxhash64(F.lit(seed), *marked),) for k, end in enumerate((h.bitwiseAND((1 << 28) - 1), F.shiftrightunsigned(h, 36)))}
    n = F.count("*") if weight is None else F.coalesce(F.sum(weight), F.lit(0))
    found = df.groupBy(_span(size).alias("span")).agg(F.count("*").alias("rows"), n.cast("long").alias("n"), *(total.alias(name) for name, total in ends.items()))
    return found.select("span", "n", F.struct("rows", *ends).alias("digest"))


def spans(left: DataFrame, right: DataFrame, columns: tuple[str, ...], weight: Column | None = None, size: int | None = None) -> DataFrame:
    """span, n_left, n_right and whether the sides differ there: a written table with a short row a span."""
    a, b = (digests(df, columns, weight, size).withColumnsRenamed({"n": f"n_{side}", "digest": side}) for df, side in ((left, "left"), (right, "right")))
    both = a.join(b, "span", "full")
    n = lambda side: F.coalesce(f"n_{side}", F.lit(0)).alias(f"n_{side}")
    return written(both.select("span", n("left"), n("right"), (~F.col("left").eqNullSafe(F.col("right"))).alias("differ")), "spans")


def _within(df: DataFrame, found: DataFrame, size: int | None = None) -> DataFrame:
    """The rows of spans that differ."""
    odd = found.where("differ").select(F.col("span").alias("_span"))
    few = odd.limit(MOST_SPANS + 1).count() <= MOST_SPANS
    return df.join(F.broadcast(odd) if few else odd.hint("merge"), _span(size) == F.col("_span"), "left_semi")


def _cell_differences(left: DataFrame, right: DataFrame, found: DataFrame) -> DataFrame:
    a, b = (_within(df, found).select("v", "s", "k", F.col("allele").alias(f"{side}_allele")) for df, side in ((left, "left"), (right, "right")))
    return a.join(b, ["v", "s", "k"], "full").where(~F.col("left_allele").eqNullSafe(F.col("right_allele")))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """v, s, k and both alleles where the tables of cells differ or only one has a cell."""
    return _cell_differences(left, right, spans(left, right, _CELL))


#: What `changed_cells` and `changed_counts` give.
CHANGED, COUNTED = "v long, s long, k int, left_allele int, right_allele int", "n_left long, n_right long, n_differ long"

#: A block's tiles to a function that makes what each of them is compared with, cell by cell.
Change = Callable[["Block"], Callable[[np.ndarray], np.ndarray]]


def changed_cells(change: Change) -> Callable[[Block], pa.Table]:
    """`differences` of a block's cells (`cells.fixture_blocks`) and what a change makes of them.

    Both sides of a cell stand in one task, so nothing is digested or joined.  A variant that is there several times meets itself that often, as in a join by v, s and k.
    """

    def run(block: Block) -> pa.Table:
        made, found = change(block), []
        for low, alleles in block.tiles():
            other = made(alleles)
            k, row, s = np.nonzero(alleles != other) if other is not alleles else np.zeros((3, 0), np.int64)
            each = np.repeat(np.arange(len(k)), block.times[row] ** 2)
            k, row, s = k[each], row[each], s[each]
            columns = (block.v[row], low + s, k.astype(np.int32), alleles[k, row, s].astype(np.int32), other[k, row, s].astype(np.int32))
            found.append(pa.Table.from_arrays([pa.array(x) for x in columns], [f.split()[0] for f in CHANGED.split(", ")]))
        return pa.concat_tables(found)

    return run


def changed_counts(change: Change) -> Callable[[Block], pa.Table]:
    """`summary` of a block's cells and what a change makes of them: a row a block, to be added up."""

    def run(block: Block) -> pa.Table:
        made, sums = change(block), np.zeros(3, np.int64)
        for _, alleles in block.tiles():
            other = made(alleles)
            sides = [x.shape[0] * x.shape[2] * int(block.times.sum()) for x in (alleles, other)]
            odd = (alleles != other).sum((0, 2)) if other is not alleles else np.zeros(len(block.times), np.int64)
            sums += [*sides, int((odd * block.times**2).sum())]
        return pa.Table.from_arrays([pa.array(x) for x in sums[:, None]], [f.split()[0] for f in COUNTED.split(", ")])

    return run


def _summed(found: DataFrame, n_differ: DataFrame) -> DataFrame:
    """n_left and n_right of the spans and n_differ of a frame, as one row."""
    sides = found.agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right")).withColumn("n_differ", F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    return sides.unionByName(n_differ.select(zero.alias("n_left"), zero.alias("n_right"), "n_differ")).agg(*(F.sum(c).alias(c) for c in ("n_left", "n_right", "n_differ")))


def summary(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells on either side and how many of them differ: one row."""
    found = spans(left, right, _CELL, F.col("allele").isNotNull().cast("long"))
    return _summed(found, _cell_differences(left, right, found).agg(F.count("*").alias("n_differ")))


def row_differences(left: DataFrame, right: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """v and n_differ of variant rows that differ: alleles, phases, and one for a contig, position or ploidy that differs.

    A variant's arrays meet once.  Places that only one side has differ too.
    """
    found = spans(left, right, _ROW) if found is None else found
    return _row_differences(_within(left, found), _within(right, found))


def _row_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = (df.select("v", F.struct(*_ROW[1:]).alias(side)) for df, side in ((left, "l"), (right, "r")))
    none = F.array().cast("array<int>")

    def differ(name: str) -> Column:
        x, y = (F.coalesce(F.col(side)[name], none) for side in ("l", "r"))
        return F.size(F.filter(F.zip_with(x, y, lambda c, d: ~c.eqNullSafe(d)), lambda d: d)).cast("long")

    place = F.lit(False)
    for name in ("contig", "pos", "ploidy"):
        place = place | ~F.col("l")[name].eqNullSafe(F.col("r")[name])
    n_differ = differ("alleles") + differ("phases") + place.cast("long")
    return a.join(b, "v", "full").select("v", n_differ.alias("n_differ")).where("n_differ > 0")


def row_summary(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells on either side of variant rows, and what differs (`row_differences`) in all: one row."""
    found = spans(left, right, _ROW, F.size("alleles").cast("long"))
    return _summed(found, row_differences(left, right, found).agg(F.coalesce(F.sum("n_differ"), F.lit(0)).alias("n_differ")))


def packed_summary(left: DataFrame, right: DataFrame, unpacked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`row_summary` of rows whose arrays are bytes (`store.PACKED`): equal arrays have equal bytes, so the bytes are digested, and only rows of spans that differ are unpacked."""
    found = spans(left, right, (*_ROW[:4], "n_alleles", *_ROW[4:]), F.col("n_alleles").cast("long"))
    a, b = (unpacked(_within(df, found)) for df in (left, right))
    return _summed(found, _row_differences(a, b).agg(F.coalesce(F.sum("n_differ"), F.lit(0)).alias("n_differ")))


def line_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """v and both lines of variants whose lines differ, or which only one side has.

    A line is long beside its digest, so each variant has one of its own, and only lines of variants that differ are joined.
    """
    found = spans(left, right, ("v", "line"), size=1)
    a, b = (_within(df, found, 1).select("v", F.col("line").alias(f"{side}_line")) for df, side in ((left, "left"), (right, "right")))
    return a.join(b, "v", "full").where(~F.col("left_line").eqNullSafe(F.col("right_line")))
