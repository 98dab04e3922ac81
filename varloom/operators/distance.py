"""Distances between the rows or columns of a block.

Vectors are cut into tiles, packed as bit planes, and each pair of tiles of a block is a task's group: whatever the number
of vectors, a task holds two tiles and their distances.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import planes
from varloom.sources.scratch import spread, written

if TYPE_CHECKING:
    from varloom.sources.cells import Block

#: Vectors of a tile.
TILE = 1024


def vectors(matrix: DataFrame, of: str, along: str, value: str = "allele") -> DataFrame:
    """block_id, id and the ordered values of each row or column."""
    found = matrix.groupBy("block_id", F.col(of).alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col(along).alias("at"), F.col(value).alias("x")))).alias("cells"))
    return found.select("block_id", "id", F.transform("cells", lambda c: c["x"]).alias("x"))


def _differs(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: (x != y).cast("int"))


def hamming(a: str, b: str) -> Column:
    """Positions that differ, of two array columns."""
    return F.aggregate(_differs(a, b), F.lit(0), lambda n, d: n + d).cast("long")


def run_length(a: str, b: str, parity: bool = False) -> Column:
    """Maximal runs of positions that differ.  parity: a single difference at the first position counts 0."""
    d = _differs(a, b)
    runs = F.aggregate(F.zip_with(d, F.concat(F.array(F.lit(0)), F.slice(d, 1, F.greatest(F.size(d) - 1, F.lit(0)))), lambda x, before: F.when((x == 1) & (before == 0), 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    if parity:
        runs = F.when((hamming(a, b) == 1) & (F.get(d, F.lit(0)) == 1), 0).otherwise(runs)
    return runs.cast("long")


def _equal(codes: np.ndarray) -> np.ndarray:
    """At how many positions each two rows are equal: a product of matrices for each value."""
    total = np.zeros((len(codes), len(codes)), np.float32)
    for value in np.unique(codes):
        one = (codes == value).astype(np.float32)
        total += one @ one.T
    return total.astype(np.int64)


def _ham(x: np.ndarray) -> np.ndarray:
    return x.shape[1] - _equal(x)


def _ham_runs(x: np.ndarray) -> np.ndarray:
    """A run starts where a position differs and the one before does not, so single and adjacent equal positions give its count."""
    value = np.unique(x, return_inverse=True)[1].reshape(x.shape)
    edges = sum((value[:, k][:, None] == value[:, k]).astype(np.int64) for k in (0, -1))
    return 1 + _equal(value) - edges - _equal(value[:, 1:] * (int(value.max()) + 1) + value[:, :-1])


def _ham_runs_parity(x: np.ndarray) -> np.ndarray:
    """As `_ham_runs`, but a single difference at the first position counts 0."""
    first = x[:, 0][:, None] != x[:, 0]
    return np.where(first & (_ham(x) == 1), 0, _ham_runs(x))


#: Distances of all rows of a matrix by name; add one here to use it.
KINDS = {"ham": _ham, "ham_rl": _ham_runs, "ham_rl_parity": _ham_runs_parity}


def matrix(x: np.ndarray, kind: str = "ham") -> np.ndarray:
    """Distances of each row of x to each other (the cost matrix); at most 2**24 positions, where products stay exact."""
    return KINDS[kind](np.asarray(x))


def stacked(frame: pd.DataFrame, columns: bool) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of a block's rows, or of their columns, which are numbered from 0."""
    frame = frame.sort_values("id")
    x = np.stack(frame["x"].to_numpy())
    return (np.arange(x.shape[1]), x.T) if columns else (frame["id"].to_numpy(), x)


_TILES = "block_id long, tile int, n long, length long, depth int, ids binary, words binary"


def _bytes_of(ids: np.ndarray, x: np.ndarray, depth: int) -> dict[str, list]:
    return {"n": [len(x)], "length": [x.shape[1]], "depth": [depth], "ids": [ids.astype("<i8").tobytes()], "words": [planes.packed(x, depth).astype("<u8").tobytes()]}


def tiles(found: DataFrame, columns: bool = False, tile: int = TILE) -> DataFrame:
    """Tiles of the vectors of blocks, found(block_id, id, x): at most `tile` vectors, packed as bit planes.

    columns: the vectors are the columns of the given rows.  Each row is then cut first, so a task gathers the rows of a
    block for one tile of columns only.
    """
    if columns:
        width = F.ceil(F.size("x") / tile).cast("int")
        cut = F.transform(F.sequence(F.lit(0), width - 1), lambda t: F.slice("x", t * tile + 1, tile))
        pieces = found.where(F.size("x") > 0).select("block_id", "id", F.posexplode_outer(cut).alias("tile", "x"))
    else:
        pieces = found.withColumn("tile", F.floor(F.col("id") / tile).cast("int")).select("block_id", "id", "tile", "x")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, x = stacked(frame, columns)
        one = frame.iloc[0]
        if columns:
            ids = ids + int(one["tile"]) * tile
        return pd.DataFrame({"block_id": [one["block_id"]], "tile": [one["tile"]], **_bytes_of(ids, x, max(1, int(x.max()).bit_length()))})

    return spread(pieces, "block_id", "tile").groupBy("block_id", "tile").applyInPandas(run, _TILES)


def _tile(r: pd.Series) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids, words and length of a tile."""
    return np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["words"], "<u8").reshape(r["depth"], r["n"], -1).astype(np.uint64, copy=False), int(r["length"])


def _deeper(words: np.ndarray, depth: int) -> np.ndarray:
    return np.concatenate([words, np.zeros((depth - len(words), *words.shape[1:]), np.uint64)]) if depth > len(words) else words


def over_tiles(found: DataFrame, kind: str, columns: bool, tile: int, each: Callable[[np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """What `each` makes of the ids of two tiles and the matrix of their distances, for every pair of tiles of a block.

    A tile goes to as many tasks as its block has tiles; the number of pairs grows with the square of that, as the
    distances do, and each pair is a task of its own size.
    """
    KINDS[kind]  # an unknown kind raises here
    packed = written(tiles(found, columns, tile), "tiles")  # used twice, and a fraction of the vectors' size
    counts = packed.groupBy("block_id").agg((F.max("tile") + 1).alias("_tiles"))
    # Tiles know how many they are from their block's row alone: a join of tiles and blocks, neither of which holds cells.
    met = packed.join(counts.hint("merge"), "block_id").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    met = met.withColumn("_low", F.least("tile", "_other")).withColumn("_high", F.greatest("tile", "_other")).drop("_tiles", "_other")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("tile")
        (ids, a, _), (others, b, _) = _tile(frame.iloc[0]), _tile(frame.iloc[-1])
        depth = max(len(a), len(b))
        made = each(ids, others, planes.between(_deeper(a, depth), _deeper(b, depth), kind))
        made.insert(0, "block_id", frame["block_id"].iloc[0])
        return made

    return spread(met, "block_id", "_low", "_high").groupBy("block_id", "_low", "_high").applyInPandas(run, schema)


def pairs(found: DataFrame, kind: str = "ham", columns: bool = False, tile: int = TILE, whole: bool = False) -> DataFrame:
    """block_id, i, j and the distance of all pairs of rows (or columns) of a block with i < j.

    whole: both directions, and each vector with itself: the cost matrix.
    """

    def each(ids: np.ndarray, others: np.ndarray, cost: np.ndarray) -> pd.DataFrame:
        if whole:
            i, j = (x.ravel() for x in np.indices(cost.shape))
            made = pd.DataFrame({"i": ids[i], "j": others[j], "distance": cost.ravel()})
            return made if ids[0] == others[0] else pd.concat([made, made.rename(columns={"i": "j", "j": "i"})])[["i", "j", "distance"]]
        i, j = np.triu_indices(len(ids), 1) if ids[0] == others[0] else (x.ravel() for x in np.indices(cost.shape))
        return pd.DataFrame({"i": ids[i], "j": others[j], "distance": cost[i, j]})

    return over_tiles(found, kind, columns, tile, each, "block_id long, i long, j long, distance long")


PAIRS = "block_id long, i long, j long, distance long"


def row_pairs(block: Block) -> pa.Table:
    """The Hamming distances of `pairs` of a block's rows, from tiles of its cells (`cells.fixture_blocks`): a task holds its block's distances and a tile, packed.

    Replacement values are values that no other allele of the block has, so marks differ from alleles with or without them.  A row that is there several times has
    its pairs as often.
    """
    total = np.zeros((len(block.rows),) * 2, np.int64)
    for _, alleles in block.tiles():
        low = int(alleles.min(initial=0))
        values = (alleles - low if low else alleles).view(np.uint8)
        depth = max(1, int(values.max(initial=0)).bit_length())
        words = np.concatenate([planes.packed(x, depth) for x in values], axis=2)
        for k in range(len(total) - 1):
            total[k, k + 1 :] += planes.KINDS["ham"](planes.differing(words[:, k + 1 :], words[:, k]))
    total += total.T
    each = np.repeat(np.arange(len(block.rows)), block.times)
    i, j = (each[x] for x in np.triu_indices(len(each), 1))
    return pa.table({"block_id": np.full(len(i), block.block_id), "i": block.rows[i], "j": block.rows[j], "distance": total[i, j]})


def nearest(found: DataFrame, kind: str = "ham", columns: bool = False, tile: int = TILE) -> DataFrame:
    """block_id, id, nearest (lowest on ties), distance to it and total, the sum of all distances, of each row or column of a block.

    Each pair of tiles gives its vectors' nearest one there and their sums, which are merged.  A block of one vector has
    no row.
    """

    def side(ids: np.ndarray, others: np.ndarray, cost: np.ndarray, total: np.ndarray) -> pd.DataFrame:
        at = cost.argmin(1)
        return pd.DataFrame({"id": ids, "nearest": others[at], "distance": cost[np.arange(len(ids)), at], "total": total})

    def each(ids: np.ndarray, others: np.ndarray, cost: np.ndarray) -> pd.DataFrame:
        total = cost.sum(1)
        if ids[0] != others[0]:
            return pd.concat([side(ids, others, cost, total), side(others, ids, np.ascontiguousarray(cost.T), cost.sum(0))])
        np.fill_diagonal(cost, np.iinfo(np.int64).max)
        return side(ids, others, cost, total).iloc[: len(ids) if len(ids) > 1 else 0]

    found = over_tiles(found, kind, columns, tile, each, "block_id long, id long, nearest long, distance long, total long")
    best = F.min(F.struct("distance", "nearest"))
    merged = found.groupBy("block_id", "id").agg(best.alias("best"), F.sum("total").alias("total"))
    return merged.select("block_id", "id", "best.nearest", "best.distance", "total")


def cost_matrix(half: DataFrame) -> DataFrame:
    """Both directions and the zero diagonal of pairs; `pairs(..., whole=True)` makes them without another shuffle."""
    both = half.unionByName(half.select("block_id", F.col("j").alias("i"), F.col("i").alias("j"), "distance"))
    own = both.select("block_id", "i").distinct().select("block_id", "i", F.col("i").alias("j"), F.lit(0).cast("long").alias("distance"))
    return both.unionByName(own)
