"""Reshapes of the cell table: flattening, its inverse, and transposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten(cells: DataFrame, order: str = "sample", samples: int | None = None, ploidy: int = 2) -> DataFrame:
    """col_id of each cell: sample-major (s0k0, s0k1, s1k0, ...) or allele-major (s0k0, s1k0, ..., s0k1, ...; needs `samples`)."""
    if order not in ("sample", "allele"):
        raise ValueError(f"unknown order: {order}")
    if order == "allele" and samples is None:
        raise ValueError("the allele-major order needs the number of samples")
    col = F.col("s") * ploidy + F.col("k") if order == "sample" else F.col("k") * F.lit(samples) + F.col("s")
    return cells.withColumn("col_id", col.cast("long"))


def unflatten(matrix: DataFrame, ploidy: int = 2) -> DataFrame:
    """s and k from sample-major columns."""
    return matrix.withColumn("s", F.floor(F.col("col_id") / ploidy)).withColumn("k", (F.col("col_id") % ploidy).cast("int"))


def transpose(matrix: DataFrame) -> DataFrame:
    turned = {"row_in_block": "col_id", "col_id": "row_in_block"}
    return matrix.select(*(F.col(c).alias(turned.get(c, c)) for c in matrix.columns))


def _filled(places: str, width: Column, empty: int) -> Column:
    """Values `x` of an ordered array column of structs with the place `c`, with `empty` in the places that are not there."""
    before = lambda i: F.coalesce(F.get(places, i - 1)["c"], F.lit(-1))
    gaps = F.transform(places, lambda x, i: F.concat(F.array_repeat(F.lit(empty), (x["c"] - before(i) - 1).cast("int")), F.array(x["x"])))
    last = F.coalesce(F.get(places, F.size(places) - 1)["c"], F.lit(-1))
    return F.concat(F.flatten(gaps), F.array_repeat(F.lit(empty), (width - last - 1).cast("int")))


def rows(cells: DataFrame, samples: int) -> DataFrame:
    """One row a variant: v, contig, pos, block_id, row_in_block, ploidy (of the block), alleles and phases, sample-major.

    Cells that are not there are absent copies.  A second cell in one place, or a sample beyond `samples`, raises.
    """
    if "contig" not in cells.columns:
        cells = cells.withColumn("contig", F.lit("1"))
    made = cells.groupBy("block_id", "row_in_block", "v", "contig", "pos").agg(F.array_sort(F.collect_list(F.struct("s", "k", "allele", "phased"))).alias("copies"), F.max("k").alias("last"))
    ploidy = made.groupBy("block_id").agg((F.max("last") + 1).cast("int").alias("ploidy"))
    made = made.join(ploidy.hint("merge"), "block_id")
    p = F.col("ploidy")
    alleles = F.transform("copies", lambda x: F.struct((x["s"] * p + x["k"]).cast("long").alias("c"), x["allele"].cast("int").alias("x")))
    phases = F.transform(F.filter("copies", lambda x: x["k"] > 0), lambda x: F.struct((x["s"] * (p - 1) + x["k"] - 1).cast("long").alias("c"), x["phased"].cast("int").alias("x")))
    # The places are columns of their own: an expression would be evaluated again for each of them.
    placed = made.select("v", "contig", "pos", "block_id", "row_in_block", "ploidy", alleles.alias("alleles"), phases.alias("phases"))
    found = placed.withColumns({"alleles": _filled("alleles", p * samples, -2), "phases": _filled("phases", (p - 1) * samples, 0)})
    whole = (F.size("alleles") == F.col("ploidy") * samples) & (F.size("phases") == (F.col("ploidy") - 1) * samples)
    return found.withColumn("alleles", F.when(whole, F.col("alleles")).otherwise(F.raise_error(F.lit("cells collide or lie outside of the samples")).cast("array<int>")))


def cells(rows_: DataFrame) -> DataFrame:
    """The cells of variant rows, one for each sample and copy; the first copy has the mark of the second, or 0."""
    p = F.col("ploidy")
    # The outer form: for the inner one Spark infers a filter on the array, which it evaluates early, expression and all.
    each = rows_.select("v", "contig", "pos", "block_id", "row_in_block", "ploidy", "phases", F.posexplode_outer("alleles").alias("at", "allele")).where("at IS NOT NULL")
    s, k = F.floor(F.col("at") / p), F.col("at") % p
    mark = F.get("phases", (s * (p - 1) + F.greatest(k - 1, F.lit(0))).cast("int"))
    return each.select("v", s.alias("s"), k.cast("int").alias("k"), "block_id", "row_in_block", "pos", "contig", "allele", F.when(p > 1, mark).otherwise(0).cast("int").alias("phased"))


def concatenate(planes: DataFrame, axis: int, rows: int, columns: int) -> DataFrame:
    """Planes of a block side by side: 0 stacks rows, 1 columns, 2 keeps them apart.

    rows: name of the column with the block's number of rows; columns: its width.
    """
    if axis == 0:
        return planes.withColumn("row_in_block", F.col("plane") * F.col(rows) + F.col("row_in_block"))
    if axis == 1:
        return planes.withColumn("col_id", F.col("plane") * columns + F.col("col_id"))
    if axis == 2:
        return planes
    raise ValueError(f"unknown axis: {axis}")
