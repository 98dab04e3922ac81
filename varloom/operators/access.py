"""Random access: block pruning, position ranges and sample columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prune_blocks(index: DataFrame, start: int, end: int) -> DataFrame:
    """Blocks whose position range overlaps [start, end]."""
    if start > end:
        raise ValueError("start lies behind end")
    return index.where((F.col("min_pos") <= end) & (F.col("max_pos") >= start))


def rows_in_range(cells: DataFrame, start: int, end: int) -> DataFrame:
    """Rows with a position in [start, end]; where the position is a stored column, the filter reaches the scan."""
    if start > end:
        raise ValueError("start lies behind end")
    return cells.where(F.col("pos").between(start, end))


def select_samples(samples: DataFrame, names: list[str], unknown: str = "raise") -> DataFrame:
    """ord (place in the request), name and s of requested samples, in request order, repeats kept.

    samples: s, name.  A name that is not there raises, or is left out with unknown="ignore".
    """
    wanted = samples.sparkSession.createDataFrame(list(enumerate(names)), "ord int, name string")
    found = wanted.join(samples.select("name", "s"), "name", "left")
    if unknown == "ignore":
        return found.where("s IS NOT NULL").select("ord", "name", "s")
    lost = F.raise_error(F.concat(F.lit("unknown sample: "), F.col("name"))).cast("long")
    return found.select("ord", "name", F.coalesce("s", lost).alias("s"))


def expand_columns(selected: DataFrame, ploidy: int) -> DataFrame:
    """The columns (s * ploidy + k) of selected samples, in order."""
    found = selected.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(ploidy - 1))))
    return found.select("ord", "k", (F.col("s") * ploidy + F.col("k")).alias("col_id"))


def pick(rows: DataFrame, samples: list[int]) -> DataFrame:
    """Variant rows with the arrays of the given samples alone, in that order, repeats kept: no cell is made of any other."""
    p, wanted = F.col("ploidy"), F.array(*(F.lit(s) for s in samples)) if samples else F.array().cast("array<int>")
    cut = lambda name, n: F.flatten(F.transform(wanted, lambda s: F.slice(name, s * n + 1, n)))
    return rows.withColumns({"alleles": cut("alleles", p), "phases": cut("phases", p - 1)})
