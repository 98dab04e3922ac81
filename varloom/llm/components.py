"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.shared import discard, written

#: Links that a task joins up at once.
SHARE = 1 << 19


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of links and the smallest id that each reaches by these links."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            return ids, ids[root]
        root = new


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task as stars around the smallest id, so that long chains are short from the start."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars() -> pa.RecordBatch:
        ids, least = roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        real = ids != least
        return pa.RecordBatch.from_pydict({"u": pa.array(ids[real], pa.int64()), "v": pa.array(least[real], pa.int64())})

    for batch in batches:
        held.append(tuple(batch.column(n).to_numpy() for n in ("u", "v")))
        if sum(len(u) for u, _ in held) >= SHARE:
            yield stars()
    if held:
        yield stars()


def _is_done(links: DataFrame) -> bool:
    """Whether each id has one smaller neighbour at most, and those have none."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id in links(a, b).

    Links are first joined up inside tasks.  Each step after that is grouped minima and joins, so a hub of any
    degree stays spread over the cluster; tables are written between the steps.  Links to oneself and nulls are
    dropped; the steps end when all links lead to the smallest id.
    """
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    links = written(links.mapInArrow(_joined_up, "u long, v long").distinct(), "links")
    while not _is_done(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        # Where the smallest neighbour was one of several, u keeps its own link to it as well.
        done, links = links, written(small.where("u <> v"), "links")
        discard(done)
    found = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    found = found.unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    found.written_path = links.written_path
    return found
