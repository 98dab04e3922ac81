"""Bit planes of blocks as runs of ones: rows are read, counted and compared on the compressed form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from varloom.functions import runs
from varloom.sources.scratch import spread

_PLANE = "block_id long, plane int, n_rows long, n_cols long, runs binary"


def planes(rows: DataFrame) -> DataFrame:
    """block_id, plane, n_rows, n_cols and runs of each bit plane of recoded rows(block_id, id, x, depth).

    A group is a block, whose rows are bounded by its size.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame.sort_values("id")["x"].to_numpy())
        found = [runs.encoded((x >> b) & 1) for b in range(max(1, int(frame["depth"].iloc[0])))]
        return pd.DataFrame({"block_id": frame["block_id"].iloc[0], "plane": range(len(found)), "n_rows": x.shape[0], "n_cols": x.shape[1], "runs": found})

    return spread(rows, "block_id").groupBy("block_id").applyInPandas(run, _PLANE)


def _each(found: DataFrame, make, columns: str) -> DataFrame:
    """What `make` gives, a frame for each plane, behind the plane's block_id and number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                made = make(runs.Runs(bytes(r.runs), r.n_rows, r.n_cols), r)
                made.insert(0, "block_id", r.block_id)
                made.insert(1, "plane", r.plane)
                yield made

    return found.mapInPandas(run, f"block_id long, plane int, {columns}")


def counts(found: DataFrame) -> DataFrame:
    """Ones and runs of ones of each row of the planes."""

    def make(plane: runs.Runs, _) -> pd.DataFrame:
        ones, n = plane.counts()
        return pd.DataFrame({"row_in_block": np.arange(plane.rows), "n_ones": ones, "n_runs": n})

    return _each(found, make, "row_in_block long, n_ones long, n_runs long")


def read(found: DataFrame, wanted: str | None = None) -> DataFrame:
    """row_in_block and bits of rows of the planes: of those that the array column `wanted` numbers, or of all.

    Only the bytes of wanted rows are decoded; a number that a block does not have raises.
    """

    def make(plane: runs.Runs, r) -> pd.DataFrame:
        rows = range(plane.rows) if wanted is None else getattr(r, wanted).tolist()
        return pd.DataFrame({"row_in_block": rows, "bits": [plane.row(k).astype(np.int32) for k in rows]})

    return _each(found, make, "row_in_block long, bits array<int>")


def neighbours(found: DataFrame, kinds: tuple[str, ...] = ("ham", "ham_rl"), reach: int = 1) -> DataFrame:
    """i, j and distances of each row of the planes and the `reach` rows behind it, a column for each kind."""
    of = {kind: runs.KINDS[kind] for kind in kinds}

    def make(plane: runs.Runs, _) -> pd.DataFrame:
        at, begins = plane.all_changes()
        rows = np.split(at, begins[1:-1]) if plane.rows else []
        met = [(i, j, runs.differing(rows[i], rows[j])) for i in range(plane.rows) for j in range(i + 1, min(plane.rows, i + reach + 1))]
        return pd.DataFrame({"i": [i for i, _, _ in met], "j": [j for _, j, _ in met], **{kind: [f(d) for _, _, d in met] for kind, f in of.items()}})

    return _each(found, make, "i long, j long" + "".join(f", {kind} long" for kind in kinds))
