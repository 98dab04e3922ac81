"""Orders of a block's rows or columns by a nearest-neighbour tour, and permutations.

A solver is given either the matrix of all distances, or the vectors themselves.  The second kind holds the packed
vectors and one row of distances at a time, so its memory grows with the vectors and not with their square.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions import planes
from varloom.operators import distance
from varloom.sources.scratch import spread

_FAR = np.iinfo(np.int64).max
#: Neighbours in the tour within which the improving solver looks for a better place.
REACH = 32
#: Vectors whose matrix of distances is held; its bytes are 16 times the square of their number.
MOST_MATRIX = 2048


def nearest(cost: np.ndarray, start: int = 0) -> np.ndarray:
    """From `start` always to the nearest unvisited vector, by a matrix of distances; ties go to the lowest number."""
    cost, order = cost.astype(np.int64), [start]
    for _ in range(len(cost) - 1):
        cost[:, order[-1]] = _FAR
        order.append(int(cost[order[-1]].argmin()))
    return np.array(order)


#: Words of vectors that a tour measures one after another, at most; more are measured at once.
FEW_WORDS = 4


def nearest_packed(words: np.ndarray, kind: str = "ham", start: int = 0) -> np.ndarray:
    """The same tour from packed vectors.

    Each step measures the current vector against those that are left; visited ones are taken out of the packed form
    whenever they are half of it, so a tour reads about three quarters of the square of the vectors' number.
    """
    by_word = words.shape[2] <= FEW_WORDS and kind in planes.MARKED
    if by_word:
        words = np.ascontiguousarray(np.moveaxis(words, 2, 0))  # (words, depth, vectors): vectors side by side
    number = words.shape[2 if by_word else 1]
    ids, order = np.arange(number), [start]
    visited, at, gone = np.zeros(number, bool), start, 0
    here = words[..., start].copy() if by_word else words[:, start]
    for _ in range(number - 1):
        visited[at] = True
        gone += 1
        if 2 * gone > len(ids):
            words, ids = np.ascontiguousarray(words[..., ~visited] if by_word else words[:, ~visited]), ids[~visited]
            visited, gone = np.zeros(len(ids), bool), 0
        if by_word:
            found = planes.counted(words, here, kind)  # far below the upper bit
            found |= visited.astype(found.dtype) << found.dtype.type(8 * found.itemsize - 1)
        else:
            found = planes.KINDS[kind](planes.differing(words, here))
            found[visited] = _FAR
        at = int(found.argmin())
        here = words[..., at].copy() if by_word else words[:, at].copy()
        order.append(int(ids[at]))
    return np.array(order)


def length(words: np.ndarray, order: np.ndarray, kind: str = "ham") -> int:
    """The sum of distances along an order of packed vectors."""
    diff = np.bitwise_or.reduce(words[:, order[1:]] ^ words[:, order[:-1]], 0) if len(order) > 1 else np.zeros((0, words.shape[2]), np.uint64)
    return int(planes.KINDS[kind](diff).sum()) if len(diff) else 0


def improved(words: np.ndarray, order: np.ndarray, kind: str = "ham", rounds: int = 1) -> np.ndarray:
    """An order with pieces turned round (2-opt) where that shortens the tour, among ends at most REACH places apart.

    The first vector stays first.  Each round passes once over the order; the tour never gets longer.
    """
    order = order.copy()
    for _ in range(rounds):
        changed = False
        for i in range(len(order) - 2):
            span = order[i : i + REACH + 2]
            a, b, inner = span[0], span[1], span[1:]
            to_a, to_b = (planes.KINDS[kind](planes.differing(words[:, inner], words[:, x])) for x in (a, b))
            steps = planes.KINDS[kind](np.bitwise_or.reduce(words[:, inner[1:]] ^ words[:, inner[:-1]], 0)) if len(inner) > 1 else np.zeros(0, np.int64)
            # Turning inner[0..j]: a now meets inner[j], and b meets inner[j + 1] (nothing, at the tour's end).
            ends = np.append(to_b[1:], 0) if i + 1 + len(inner) == len(order) else to_b[1:]
            was = np.append(steps, 0) if len(ends) > len(steps) else steps
            gain = (to_a[0] + was) - (to_a[: len(ends)] + ends)
            if len(gain) and gain.max() > 0:
                j = int(gain.argmax())
                order[i + 1 : i + 2 + j] = order[i + 1 : i + 2 + j][::-1].copy()
                changed = True
        if not changed:
            break
    return order


@dataclass(frozen=True)
class Solver:
    """How an order is found.  needs_matrix: `solve` gets the matrix of distances and the preset; otherwise packed vectors, the kind of distance and the preset."""

    needs_matrix: bool
    solve: Callable[..., np.ndarray]

    def order(self, x: np.ndarray, kind: str = "ham", preset: int = 0) -> np.ndarray:
        """The order of the rows of x."""
        if self.needs_matrix and len(x) > MOST_MATRIX:
            return nearest_packed(planes.packed(x), kind)  # the same tour
        if self.needs_matrix:
            return self.solve(distance.matrix(x, kind), preset)
        return self.solve(planes.packed(x), kind, preset)


#: Solvers by name; add one here to use it.  preset: effort beyond the plain tour, where a solver knows any.
SOLVERS: dict[str, Solver] = {
    "nn": Solver(True, lambda cost, preset: nearest(cost)),
    "nn_direct": Solver(False, lambda words, kind, preset: nearest_packed(words, kind)),
    "nn_two_opt": Solver(False, lambda words, kind, preset: improved(words, nearest_packed(words, kind), kind, rounds=1 + preset)),
}
#: Solvers for which a preset other than 0 means something.
PRESETS = {"nn_two_opt": (0, 1, 2)}


def tour(vectors: DataFrame, solver: str = "nn", kind: str = "ham", columns: bool = False, preset: int = 0) -> DataFrame:
    """block_id, step and id: the order in which a block's rows (or columns) are visited.

    A tour goes step by step, so a block is one group.  With `nn` its task holds the square of the vectors' number up to MOST_MATRIX vectors;
    beyond, and with the other solvers, the packed vectors alone.
    """
    chosen = SOLVERS[solver]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, x = distance.stacked(frame, columns)
        order = chosen.order(x, kind, preset)
        return pd.DataFrame({"block_id": frame["block_id"].iloc[0], "step": np.arange(len(order), dtype=np.int64), "id": ids[order]})

    return spread(vectors, "block_id").groupBy("block_id").applyInPandas(run, "block_id long, step long, id long")


def lengths(vectors: DataFrame, orders: DataFrame, kind: str = "ham", columns: bool = False) -> DataFrame:
    """block_id and the sum of distances along each block's order."""

    def run(frame: pd.DataFrame, order: pd.DataFrame) -> pd.DataFrame:
        ids, x = distance.stacked(frame, columns)
        at = np.searchsorted(ids, order.sort_values("step")["id"].to_numpy())
        return pd.DataFrame({"block_id": [frame["block_id"].iloc[0]], "total": [length(planes.packed(x), at, kind)]})

    return vectors.groupBy("block_id").cogroup(orders.groupBy("block_id")).applyInPandas(run, "block_id long, total long")


def inverse(order: DataFrame) -> DataFrame:
    """The permutation that undoes an order."""
    return order.select("block_id", F.col("id").alias("step"), F.col("step").alias("id"))


def apply(matrix: DataFrame, order: DataFrame, column: str) -> DataFrame:
    """Rows or columns of a matrix placed by an order: what stands at `id` comes to `step`.

    An order has a row for each row or column of a block, so both sides are shuffled; neither is broadcast.
    """
    places = order.select("block_id", F.col("id").alias(column), "step")
    return matrix.join(places.hint("merge"), ["block_id", column]).drop(column).withColumnRenamed("step", column)


def undo(matrix: DataFrame, order: DataFrame, column: str) -> DataFrame:
    return apply(matrix, inverse(order), column)


def apply_to_rows(rows: DataFrame, order: DataFrame) -> DataFrame:
    """block_id, id and x of rows whose columns are placed by an order: a block's rows and its order meet in one task."""

    def run(frame: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        at = places.sort_values("step")["id"].to_numpy()
        return frame.assign(x=[np.asarray(x)[at] for x in frame["x"]])

    own = rows.select("block_id", "id", "x")
    return own.groupBy("block_id").cogroup(order.groupBy("block_id")).applyInPandas(run, own.schema)
