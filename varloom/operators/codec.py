"""Byte forms as rows: permutations, bit-length vectors, parameter sets, packed planes and their sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import bitpack
from varloom.functions.bits import bits_to_hex, number_hex
from varloom.operators.matrices import CODECS
from varloom.sources.scratch import spread


def _hex(raw: str | Column) -> Column:
    return F.lower(F.hex(raw))


def permutation_hex(order: DataFrame) -> DataFrame:
    """Each block's permutation: every id in the fewest bits for their number, in order of steps."""
    found = order.groupBy("block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "id"))), lambda x: x["id"]).alias("ids"))

    @F.pandas_udf("binary")
    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: bitpack.permutation_bytes(np.asarray(x)))

    return found.select("block_id", _hex(run("ids")).alias("hex"))


def permutation_ids(packed: DataFrame) -> DataFrame:
    """block_id, step and id of packed(block_id, n, hex) again."""

    @F.pandas_udf("array<long>")
    def run(raw: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([bitpack.permutation_of(bytes(r), k) for r, k in zip(raw, n, strict=True)])

    found = packed.select("block_id", F.posexplode(run(F.unhex("hex"), "n")).alias("step", "id"))
    return found.withColumn("step", F.col("step").cast("long"))


def lengths_hex(rows: DataFrame) -> DataFrame:
    """Each block's row bit counts: their number, the bits of an entry, then 0 for one or 1 and the count less two."""
    found = rows.groupBy("block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_in_block", "bits"))), lambda x: x["bits"]).alias("bits"))

    @F.pandas_udf("binary")
    def run(bits: pd.Series) -> pd.Series:
        return bits.map(lambda x: bitpack.lengths_bytes(np.asarray(x)))

    return found.select("block_id", _hex(run("bits")).alias("hex"))


def lengths_rows(packed: DataFrame) -> DataFrame:
    """block_id, row_in_block, bits and first_row of the bit counts of blocks again."""

    @F.pandas_udf("array<struct<bits:long,first_row:long>>")
    def run(raw: pd.Series) -> pd.Series:
        found = (bitpack.lengths_of(bytes(r)) for r in raw)
        return pd.Series([[{"bits": b, "first_row": f} for b, f in zip(x.tolist(), (np.cumsum(x) - x).tolist(), strict=True)] for x in found])

    found = packed.select("block_id", F.posexplode(run(F.unhex("hex"))).alias("row_in_block", "x"))
    return found.select("block_id", F.col("row_in_block").cast("long").alias("row_in_block"), "x.bits", "x.first_row")


def parameter_hex(sets: DataFrame, ploidy: int = 2) -> DataFrame:
    """Header and fields of each bit-plane parameter set (planes stacked by rows, unsorted), as bytes."""
    encoded = F.col("phase") < 0
    flag = lambda c: F.when(c, F.lit("1")).otherwise(F.lit("0"))
    bits = F.concat(
        F.lpad(F.bin("set_id"), 8, "0"), flag(F.col("any_missing") == 1), flag(F.col("any_absent") == 1), F.lpad(F.bin(F.lit(ploidy - 1)), 8, "0"), F.lit("00"),
        F.lpad(F.bin("depth"), 8, "0"), F.lit("00"), flag(encoded), F.lit("00000"), F.when(encoded, F.lit("00000")).otherwise(F.bin("phase")),
    )
    content = bits_to_hex(bits)
    return sets.select("set_id", F.concat(F.lit("00"), number_hex(5 + F.length(content) / 2, 4), content).alias("hex"))


def packed_planes(rows: DataFrame) -> DataFrame:
    """block_id, plane, n_rows, n_cols and hex of each bit plane of recoded rows(block_id, id, x, depth), row by row."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame.sort_values("id")["x"].to_numpy())
        planes = [bitpack.matrix_bytes((x >> b) & 1) for b in range(max(1, int(frame["depth"].iloc[0])))]
        return pd.DataFrame({"block_id": frame["block_id"].iloc[0], "plane": range(len(planes)), "n_rows": x.shape[0], "n_cols": x.shape[1], "raw": planes})

    found = spread(rows, "block_id").groupBy("block_id").applyInPandas(run, "block_id long, plane int, n_rows long, n_cols long, raw binary")
    return found.select("block_id", "plane", "n_rows", "n_cols", _hex("raw").alias("hex"))


def unpacked_planes(packed: DataFrame) -> DataFrame:
    """block_id, plane, row_in_block, col_id and bit again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                bits = bitpack.matrix_of(bytes(r.raw), r.n_rows, r.n_cols)
                yield pd.DataFrame({"block_id": r.block_id, "plane": r.plane, "row_in_block": np.repeat(np.arange(r.n_rows), r.n_cols), "col_id": np.tile(np.arange(r.n_cols), r.n_rows), "bit": bits.ravel()})

    return packed.select("block_id", "plane", "n_rows", "n_cols", F.unhex("hex").alias("raw")).mapInPandas(run, "block_id long, plane int, row_in_block long, col_id long, bit int")


def coded(packed: DataFrame, codec: str = "zlib") -> DataFrame:
    """The packed matrices with `payload`, their bytes through a codec."""
    encode = CODECS[codec][0]

    @F.pandas_udf("binary")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: encode(bytes(x)))

    return packed.withColumn("payload", run(F.unhex("hex"))).drop("hex")


def decoded(payloads: DataFrame, codec: str = "zlib") -> DataFrame:
    decode = CODECS[codec][1]

    @F.pandas_udf("binary")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: decode(bytes(x)))

    return payloads.withColumn("hex", F.lower(F.hex(run("payload")))).drop("payload")


def payload_sizes(facts: DataFrame, n_cols: int) -> DataFrame:
    """Bytes of each block's packed planes (`packed_planes`), with a length field of four bytes each: the shape and depth of a block give them, so no plane is made."""
    n = F.greatest("depth", F.lit(1)).cast("long")
    found = facts.select("block_id", n.alias("n_matrices"), F.ceil(F.col("n_rows") * n_cols / 8).cast("long").alias("_size"))
    return found.select("block_id", "n_matrices", (F.col("n_matrices") * F.col("_size")).alias("matrix_bytes"), (F.col("n_matrices") * (F.col("_size") + 4)).alias("payload_bytes"))
