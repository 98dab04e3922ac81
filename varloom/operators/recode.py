"""Replacement of the missing and absent marks by ordinary values, block by block, and its inverse."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.operators import blocks


def _replaced(a: Column) -> Column:
    return F.when(a == -1, F.col("missing_rep")).when(a == -2, F.col("absent_rep")).otherwise(a).cast("int")


def _restored(a: Column) -> Column:
    return F.when(a == F.col("absent_rep"), -2).when(a == F.col("missing_rep"), -1).otherwise(a).cast("int")


def recode(cells: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    reps = (blocks.statistics(cells) if statistics is None else statistics).select("block_id", "missing_rep", "absent_rep")
    return blocks.beside(cells, reps).withColumn("allele", _replaced(F.col("allele")))


def undo(recoded: DataFrame) -> DataFrame:
    return recoded.withColumn("allele", _restored(F.col("allele"))).drop("missing_rep", "absent_rep")


def recode_rows(rows: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Variant rows with replaced alleles, and of their block missing_rep, absent_rep, depth and n_rows: arrays, before anything is exploded."""
    facts = (blocks.facts(rows) if facts is None else facts).select("block_id", "missing_rep", "absent_rep", "depth", "n_rows")
    return blocks.beside(rows, facts).withColumn("alleles", F.transform("alleles", _replaced))


def undo_rows(recoded: DataFrame) -> DataFrame:
    return recoded.withColumn("alleles", F.transform("alleles", _restored)).drop("missing_rep", "absent_rep", "depth", "n_rows")


def replacements_of(tiles: Iterable[np.ndarray]) -> tuple[int | None, int | None]:
    """missing_rep and absent_rep (`blocks.replacements`) of a block's alleles, given in tiles."""
    most, missing, absent = -1, False, False
    for alleles in tiles:
        most = max(most, int(alleles.max(initial=-1)))
        if alleles.min(initial=0) < 0:
            missing, absent = missing or bool((alleles == -1).any()), absent or bool((alleles == -2).any())
    missing_rep = most + 1 if missing else None
    return missing_rep, (most if missing_rep is None else missing_rep) + 1 if absent else None


def replaced(alleles: np.ndarray, reps: tuple[int | None, int | None]) -> np.ndarray:
    """Alleles with replaced marks, of a type that holds the replacement values; the same array where the block has no marks."""
    for mark, rep in zip((-1, -2), reps, strict=True):
        if rep is not None:
            alleles = np.where(alleles == mark, np.array(rep, np.promote_types(alleles.dtype, np.min_scalar_type(-1 - rep))), alleles)
    return alleles


def restored(recoded: np.ndarray, reps: tuple[int | None, int | None]) -> np.ndarray:
    """The marks again."""
    for mark, rep in zip((-1, -2), reps, strict=True):
        if rep is not None:
            recoded = np.where(recoded == rep, np.array(mark, recoded.dtype), recoded)
    return recoded
