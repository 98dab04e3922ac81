"""The encoded store: Parquet tables under one path.  Blocks of variants may be cut into tiles of samples as well.

log         the versions of the store (`versions`): which parts are live, and how blocks are made
blocks      one row a block and tile: where it lies, its access unit and parameter set, its payload's bytes and their sizes;
            a folder a part and tile, and in it blocks by number, hence by contig and position
index       one row a block and tile: contig, positions, ploidy, replacement values, depth; a folder a part and tile
tiles       one row a tile: its first sample and their number
parameters  the parameter sets that blocks refer to; a version with more of them has a table of its own
samples     s and name
header      lines of the source's header

Every tile is coded on its own, with its own replacement values, depth, phases and orders, so what is read for named
samples is their tiles' folders, and in those the blocks of the range.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import asdict
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.functions import bitpack
from varloom.operators import blocks, container, layout, matrices
from varloom.operators.matrices import EncodeOptions
from varloom.sources import versions
from varloom.sources.scratch import LONG_ROWS, discard, spread, tasks, written

if TYPE_CHECKING:
    from varloom.sources.cells import Block

TABLES = ("blocks", "index", "tiles", "parameters", "samples", "header")
#: A parameter set's number is one byte.
MOST_SETS = 256

_BLOCK = "block_id long, contig string, min_pos long, max_pos long, first_v long, n_rows long, n_samples long, positions array<long>, payload binary, " + ", ".join(f"{n} long" for n in matrices.SIZES)
_ROWS = "v long, contig string, pos long, block_id long, row_in_block long, ploidy int, alleles array<int>, phases array<int>"
_COPIED = ("block_id", "contig", "min_pos", "max_pos", "first_v", "n_rows", "n_samples")


PACKED = "v long, contig string, pos long, block_id long, row_in_block long, ploidy int, n_alleles int, alleles binary, phases binary"
_FACTS = "ploidy int, max_allele int, any_missing int, any_absent int, phase int, missing_rep int, absent_rep int, depth int"


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_CODED = pa.schema([(n, _ARROW[kind]) for n, kind in (x.split() for x in f"{_BLOCK}, {_FACTS}".split(", "))])


def _packed(rows: DataFrame) -> DataFrame:
    """Variant rows with their arrays as bytes, of the fewest bytes a number that hold a row: Spark moves, sorts and scans these instead of arrays of integers.

    Rows that are packed already stay as they are.
    """
    if "n_alleles" in rows.columns:
        return rows.select(*_names(PACKED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {}
            if any(batch.column(n).null_count or batch.column(n).flatten().null_count for n in ("alleles", "phases")):
                raise ValueError("a row has no alleles or phases, or null ones")
            for name in ("alleles", "phases"):
                sizes, flat = (x.to_numpy(zero_copy_only=False) for x in (batch.column(name).value_lengths(), batch.column(name).flatten()))
                each = np.split(flat.astype(np.int32, copy=False), np.cumsum(sizes)[:-1])
                made[name] = pa.array([bitpack.number_bytes(x) for x in each], pa.binary())
            made["n_alleles"] = batch.column("alleles").value_lengths()
            yield pa.RecordBatch.from_pydict({n: made[n] if n in made else batch.column(n) for n in _names(PACKED)})

    return rows.select("v", "contig", "pos", "block_id", "row_in_block", F.col("ploidy").cast("int").alias("ploidy"), "alleles", "phases").mapInArrow(run, PACKED)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _stacked(raw: list[bytes], own: list[int], samples: int, ploidy: int, less: int, value: int) -> np.ndarray:
    """Numbers (rows, samples, copies less `less`) of a block's rows; rows of a lower ploidy are filled up with a value."""
    each = (bitpack.numbers_of(x, samples * (p - less)).reshape(samples, p - less) for x, p in zip(raw, own, strict=True))
    return np.stack([np.pad(x, ((0, 0), (0, ploidy - p)), constant_values=value) if p < ploidy else x for x, p in zip(each, own, strict=True)])


def _encoder(options: EncodeOptions, stride: int):
    """One block's rows to its payloads and facts, a row a tile.  A block is measured where it is coded, so its rows move once."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_in_block")
        c = {n: table.column(n).to_pylist() for n in ("n_alleles", "ploidy", "_own", "alleles", "phases")}
        block, at, v = table.column("block_id")[0].as_py(), table.column("row_in_block").to_numpy(), table.column("v").to_numpy()
        ploidy, contigs = max(c["ploidy"]), set(table.column("contig").to_pylist())
        samples = {n // max(p, 1) for n, p in zip(c["n_alleles"], c["_own"], strict=True)}
        if len(contigs) > 1 or len(samples) > 1 or (at != np.arange(len(at))).any() or (v - at != v[0]).any():
            raise ValueError(f"block of several contigs or sample counts, or with gaps: {block}")
        n = samples.pop()
        alleles = _stacked(c["alleles"], c["_own"], n, ploidy, 0, -2)
        phases = _stacked(c["phases"], c["_own"], n, ploidy, 1, 0)
        pos = table.column("pos").to_numpy()
        size = options.tile_samples or max(n, 1)
        found = [_coded(alleles[:, low : low + size], phases[:, low : low + size], options) for low in range(0, max(n, 1), size)]
        k = len(found)
        rest = {
            "block_id": block + stride * np.arange(k), "contig": [table.column("contig")[0].as_py()] * k, "min_pos": [int(pos.min())] * k, "max_pos": [int(pos.max())] * k, "first_v": [int(v[0])] * k, "n_rows": [len(v)] * k,
            "n_samples": [min(size, n - low) for low in range(0, max(n, 1), size)], "positions": [pos] * k, "ploidy": [ploidy] * k,
        }
        return pa.table([pa.array(rest[f.name] if f.name in rest else [x[f.name] for x in found], f.type) for f in _CODED], schema=_CODED)

    return run


def _coded(alleles: np.ndarray, phases: np.ndarray, options: EncodeOptions) -> dict:
    """Payload, sizes and facts of one tile of a block: alleles (rows, samples, copies) and phases with one copy less."""
    rows = len(alleles)
    most, (missing, absent) = max(-1, int(alleles.max(initial=-1))), (alleles == -1, alleles == -2)
    any_missing, any_absent = bool(missing.any()), bool(absent.any())
    missing_rep = most + 1 if any_missing else None
    absent_rep = (most if missing_rep is None else missing_rep) + 1 if any_absent else None
    top = next(x for x in (absent_rep, missing_rep, most) if x is not None)
    values = alleles.astype(np.min_scalar_type(-1 - max(top, 1)))
    for rep, where in ((missing_rep, missing), (absent_rep, absent)):
        if rep is not None:
            values[where] = rep
    low, high = (int(phases.min()), int(phases.max())) if phases.size else (0, 0)
    depth = bitpack.width_of(top) if top > 0 else 0
    made = matrices.encode_block(values.reshape(rows, -1), None if low == high else phases.reshape(rows, -1), depth, (missing_rep, absent_rep), options)
    known = {"max_allele": most, "any_missing": int(any_missing), "any_absent": int(any_absent), "phase": low if low == high else -1, "missing_rep": missing_rep, "absent_rep": absent_rep, "depth": depth}
    return {"payload": container.payload_bytes(made), **made.sizes(), **known}


_KEY = ("any_missing", "any_absent", "ploidy", "depth", "phase")


def _with_known(sets: DataFrame, known: DataFrame) -> DataFrame:
    """Numbered sets of new blocks under the numbers that they have already, others after those; both are few."""
    most = known.agg(F.max("set_id")).first()[0]
    named = sets.drop("set_id").join(F.broadcast(known.select(*_KEY, "set_id")), list(_KEY), "left")
    fresh = F.row_number().over(Window.partitionBy(F.col("set_id").isNull()).orderBy("first_block")) + (-1 if most is None else most)
    return named.withColumn("set_id", F.coalesce("set_id", fresh.cast("long")))


def _bytes(coded: DataFrame) -> int:
    """Bytes of the payloads and positions of coded blocks, from their short columns."""
    return coded.agg(F.sum(sum((F.col(n) for n in matrices.SIZES), 8 * F.col("n_rows")))).first()[0] or 0


def _encoded(rows: DataFrame, options: EncodeOptions, block_size: int | None, first_block: int = 0, known: DataFrame | None = None, ahead: DataFrame | None = None, first_unit: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """blocks, index, tiles and parameters of packed variant rows, and the written tables that they are made from.

    For rows that are appended: the first block's number, the parameter sets that are known, the blocks (block_id, set_id)
    of the unit that may go on, and the number of that unit.
    """
    packed = written(rows, "rows", long_rows=True)
    given = packed.withColumn("_own", F.col("ploidy")) if block_size is None else blocks.placed(packed, block_size).withColumn("block_id", F.col("block_id") + first_block)
    last, n_alleles = given.agg(F.max("block_id"), F.sum("n_alleles")).first()
    stride = 1 if last is None else last + 1
    # Alleles and phases, a byte each: their own lengths would have to be read for it.
    coded = written(spread(given, "block_id", size=2 * (n_alleles or 0)).groupBy("block_id").applyInArrow(_encoder(options, stride), f"{_BLOCK}, {_FACTS}"), "coded", long_rows=True)
    discard(packed)
    facts = coded.select(*_COPIED, *_names(_FACTS))
    made = [coded]

    shape = facts if options.binarization == "bit_plane" else facts.withColumn("depth", F.lit(1))
    key = _KEY
    axis = options.axis if options.binarization == "bit_plane" else 0
    constant = {n: F.lit(axis if n == "axis" else getattr(options, n)) for n in ("binarization", "axis", "sort_rows", "sort_cols", "transpose", "coder")}
    sets = blocks.number_sets(shape, key).withColumn("set_id", F.col("set_id").cast("long"))
    sets = written((sets if known is None else _with_known(sets, known)).withColumns(constant), "sets")
    made.append(sets)
    if (sets.agg(F.max("set_id")).first()[0] or 0) >= MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} parameter sets")
    # At most MOST_SETS rows.  A unit ends with its tile, so tiles tell their sets apart here.
    tile = F.floor(F.col("block_id") / stride)
    named = shape.join(F.broadcast(sets.select(*key, "set_id")), list(key)).select("block_id", (F.col("set_id") + tile * MOST_SETS).alias("set_id"))
    named = written(named if ahead is None else named.unionByName(ahead), "named")
    units = written(blocks.number_units(named).select("block_id", (F.col("set_id") % MOST_SETS).alias("set_id"), (F.col("au_id") + first_unit).alias("au_id")), "units")
    made += [named, units]

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("tile", tile.cast("int")).withColumn("first_s", F.col("tile").cast("long") * (options.tile_samples or 0)).withColumn("block_id", F.col("block_id") % stride)

    few = units.limit(blocks.MOST_FACTS + 1).count() <= blocks.MOST_FACTS
    ranged = coded.drop(*_names(_FACTS)).join(F.broadcast(units) if few else units.hint("merge"), "block_id").repartitionByRange(tasks(rows.sparkSession, _bytes(coded)), "block_id")
    found, index = placed(ranged), placed(facts.repartitionByRange("block_id"))  # a range of blocks lies in few tiles, so a task writes few of them
    tiles = index.groupBy("tile", "first_s").agg(F.max("n_samples").alias("n_samples"))
    return found, index, tiles, sets.select(*container.SET_NAMES), made


def write(rows: DataFrame, path: str, options: EncodeOptions | None = None, names: DataFrame | None = None, header: DataFrame | None = None, mode: str = "errorifexists", block_size: int | None = None, batch: int | None = None) -> None:
    """Encode variant rows block by block, and tile by tile: recode, binarize, sort, pack, code.

    The rows are written once to the shared folder and read from there.  Blocks are laid out by tile and number, hence by
    contig and position, so readers prune.  names: s and name of the samples (without it S0, S1, ...); mode: what to do
    with tables that are there already, as in Spark's writer; block_size: None keeps the blocks that the rows are given in.
    """
    spark, options = rows.sparkSession, options or EncodeOptions()
    found, index, tiles, sets, made = _encoded(_packed(rows), options, block_size)
    part = versions.new_part()
    if mode == "overwrite":
        versions.clear(spark, path)
    for df, name in ((found, "blocks"), (index, "index")):
        df.withColumn("part", F.lit(part)).sortWithinPartitions("part", "tile", "block_id").write.mode(mode).options(**LONG_ROWS).partitionBy("part", "tile").parquet(f"{path}/{name}")
    tiles.coalesce(1).write.mode(mode).parquet(f"{path}/tiles")
    sets.coalesce(1).write.mode(mode).parquet(f"{path}/parameters")
    if names is None:
        n = spark.read.parquet(f"{path}/tiles").agg(F.sum("n_samples")).first()[0] or 0
        names = spark.range(n).select(F.col("id").alias("s"), F.concat(F.lit("S"), F.col("id")).alias("name"))
    names.select("s", "name").write.mode(mode).parquet(f"{path}/samples")
    header = spark.createDataFrame([], "line_no long, value string") if header is None else header
    header.write.mode(mode).parquet(f"{path}/header")
    versions.commit(spark, path, {"number": 0, "parts": [[part, None]], "parameters": "parameters", "options": asdict(options), "block_size": block_size, "batch": batch})
    discard(*made)


def append(rows: DataFrame, path: str, batch: int | None = None) -> None:
    """Add variant rows behind those of a store, with its options and its size of blocks.

    v numbers the new rows without gaps; they follow the stored ones in contig and position.  A last block that is not
    full is coded again with the rows that complete it; parameter sets keep their numbers and the last access unit goes on,
    so a store that was appended to equals one that was written at once (with several tiles but for the units' numbers).
    Readers see the new version from its commit on, which fails if another writer was first.  batch: a number that grows
    from one append to the next; a batch that the store holds already is left out.
    """
    spark, version = rows.sparkSession, versions.current(rows.sparkSession, path)
    if version is None:
        raise ValueError(f"no store at {path}")
    if batch is not None and version["batch"] is not None and batch <= version["batch"]:
        return
    options, size = EncodeOptions(**version["options"]), version["block_size"]
    if size is None:
        raise ValueError("the store was written in blocks of its own")
    zero = F.lit(0).cast("long")
    rows = written(_packed(rows.withColumns({"block_id": zero, "row_in_block": zero})), "rows", long_rows=True)
    index = index_of(spark, path).where("tile = 0")
    first, last = rows.select("v", "contig", "pos").orderBy("v").limit(1).first(), index.orderBy(F.desc("block_id")).limit(1).first()
    new = {"number": version["number"] + 1, "batch": batch if batch is not None else version["batch"]}
    if first is None:
        versions.commit(spark, path, version | new)
        discard(rows)
        return
    contigs = rows.select("contig").distinct()
    if last is not None and first["contig"] == last["contig"]:
        if first["pos"] < last["max_pos"]:
            raise ValueError("the rows do not follow those of the store")
        contigs = contigs.where(F.col("contig") != last["contig"])
    if contigs.join(index.select("contig").distinct(), "contig", "left_semi").limit(1).count():
        raise ValueError("a contig of the rows ended in the store")
    ahead = 0 if last is None else last["first_v"] + last["n_rows"]
    given = rows.withColumn("v", F.col("v") - first["v"] + ahead)
    base = 0 if last is None else last["block_id"] + 1
    if last is not None and last["n_rows"] < size and first["contig"] == last["contig"]:
        base = last["block_id"]
        given = read(spark, path, blocks_=(base, base), packed=True).unionByName(given)

    stored = blocks_of(spark, path, version).where(F.col("block_id") < base)
    # A block that is coded again may have been the only one with its set.
    known = written(parameters_of(spark, path, version).join(F.broadcast(stored.select("set_id").distinct()), "set_id", "left_semi").select(*container.SET_NAMES), "known")
    unit = stored.agg(F.max("au_id")).first()[0]
    goes_on = None
    if unit is not None and options.tile_samples is None:
        goes_on = stored.where(F.col("au_id") == unit).select("block_id", "set_id")  # at most a unit's blocks
    first_unit = 0 if unit is None else unit + (goes_on is None)
    found, facts, _, sets, made = _encoded(given, options, size, base, known, goes_on, first_unit)
    part = versions.new_part()
    for df, name in ((found, "blocks"), (facts, "index")):
        df.withColumn("part", F.lit(part)).sortWithinPartitions("part", "tile", "block_id").write.mode("append").options(**LONG_ROWS).partitionBy("part", "tile").parquet(f"{path}/{name}")
    fresh = written(known.unionByName(sets.join(F.broadcast(known.select("set_id")), "set_id", "left_anti")), "sets")
    name = version["parameters"]
    if fresh.exceptAll(parameters_of(spark, path, version).select(fresh.columns)).limit(1).count():
        name = f"parameters_{part}"
        fresh.coalesce(1).write.parquet(f"{path}/{name}")
    parts = [[p, base if end is None else min(end, base)] for p, end in version["parts"]]
    versions.commit(spark, path, version | new | {"parts": [*(x for x in parts if x[1] > 0), [part, None]], "parameters": name})
    discard(rows, known, fresh, *made)


_INDEX = (
    "block_id long, contig string, min_pos long, max_pos long, first_v long, n_rows long, n_samples long, ploidy int, max_allele int, any_missing int, any_absent int, phase int, missing_rep int, absent_rep int, depth int, "
    "first_s long, part int, tile int"
)
_STORED = f"{_BLOCK}, set_id long, au_id long, first_s long, part int, tile int"


def _version(spark: SparkSession, path: str) -> dict:
    version = versions.current(spark, path)
    if version is None:
        raise ValueError(f"no store at {path}")
    return version


def blocks_of(spark: SparkSession, path: str, version: dict | None = None) -> DataFrame:
    """The table of coded blocks, of the live version."""
    return spark.read.schema(_STORED).parquet(f"{path}/blocks").where(versions.live(version or _version(spark, path)))


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """The index of the live version."""
    return spark.read.schema(_INDEX).parquet(f"{path}/index").where(versions.live(_version(spark, path)))


def parameters_of(spark: SparkSession, path: str, version: dict | None = None) -> DataFrame:
    """The parameter sets of the live version."""
    return spark.read.parquet(f"{path}/{(version or _version(spark, path))['parameters']}")


def check(spark: SparkSession, path: str) -> None:
    """Raise if access units are not numbered without gaps, blocks lack their set, or numbers of samples differ within a tile."""
    found = blocks_of(spark, path)
    r = found.agg(F.count_distinct("au_id").alias("units"), F.max("au_id").alias("last")).first()
    if r["units"] and r["units"] != r["last"] + 1:
        raise ValueError("access units are missing")
    if found.groupBy("tile").agg((F.min("n_samples") != F.max("n_samples")).alias("odd")).where("odd").limit(1).count():
        raise ValueError("blocks have different numbers of samples")
    if found.select("set_id").distinct().join(parameters_of(spark, path).select("set_id"), "set_id", "left_anti").limit(1).count():
        raise ValueError("a parameter set is missing")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """Numbers of variants, samples, blocks (of all tiles), access units and parameter sets: one row."""
    found = blocks_of(spark, path)
    return found.agg(
        F.coalesce(F.sum(F.when(F.col("tile") == 0, F.col("n_rows"))), F.lit(0)).alias("n_variants"), F.max(F.col("first_s") + F.col("n_samples")).alias("n_samples"), F.count("*").alias("n_blocks"),
        F.count_distinct("au_id").alias("n_units"), F.count_distinct("set_id").alias("n_sets"),
    )


SIZED = ", ".join(f"{n} long" for n in ("block_id", *matrices.SIZES, "payload_bytes", "block_bytes"))


def block_sizes(options: EncodeOptions) -> Callable[[Block], pa.Table]:
    """`sizes` of a block without tiles, coded in the task that makes its cells (`cells.fixture_blocks`): the bytes are counted and none is stored."""

    def run(block: Block) -> pa.Table:
        if (block.rows != np.arange(len(block.rows))).any() or (block.times != 1).any():
            raise ValueError(f"block with gaps: {block.block_id}")
        found = _coded(*block.matrices(), options)
        own = [found[n] for n in matrices.SIZES]
        return pa.table([[x] for x in (block.block_id, *own, sum(own), sum(own) + container.HEADER)], _names(SIZED))

    return run


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of each block and tile by component, of its payload, and with its header of five bytes."""
    total = sum((F.col(n) for n in matrices.SIZES[1:]), F.col(matrices.SIZES[0]))
    return blocks_of(spark, path).select("tile", "block_id", *matrices.SIZES, total.alias("payload_bytes"), (total + container.HEADER).alias("block_bytes"))


def decoded(r, rows: np.ndarray, columns: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Alleles and phases (rows, samples, copies) of a stored block joined with its parameter set, of chosen rows and samples."""
    options = EncodeOptions(binarization=r.binarization, axis=r.axis, sort_rows=r.sort_rows, sort_cols=r.sort_cols, transpose=r.transpose, coder=r.coder)
    split = r.binarization == "row_split"
    payload = container.payload_of(bytes(r.payload), container.matrices_of(r.binarization, r.depth, r.axis), r.sort_rows, r.sort_cols, split, r.phase < 0, bool(r.any_missing), bool(r.any_absent))
    values, phases = matrices.decode_block(payload, r.depth, options)
    p = r.ploidy
    values = values[rows].astype(np.int32).reshape(len(rows), r.n_samples, p)
    values = values if columns is None else values[:, columns]
    absent, missing = (values == rep if rep is not None else None for rep in (payload.absent_rep, payload.missing_rep))
    for mark, value in ((absent, -2), (missing, -1)):
        if mark is not None:
            values[mark] = value
    if phases is None:
        return values, np.full((len(rows), values.shape[1], p - 1), r.phase, np.int32)
    phases = phases[rows].astype(np.int32).reshape(len(rows), r.n_samples, p - 1)
    return values, phases if columns is None else phases[:, columns]


def decoded_rows(tiles: list, start: int | None, end: int | None, columns: list[tuple[int, int]] | None, packed: bool = False) -> pd.DataFrame:
    """Variant rows of one block from its tiles, packed or with arrays.  columns: tile and place in it of each sample wanted; None: all in order."""
    one = next(r for r in tiles if r.positions is not None)
    pos = np.asarray(one.positions)
    rows = np.arange(len(pos)) if start is None or end is None else np.flatnonzero((pos >= start) & (pos <= end))
    own = {r.tile: None if columns is None else sorted({c for t, c in columns if t == r.tile}) for r in tiles}
    found = {r.tile: decoded(r, rows, own[r.tile]) for r in tiles}
    if columns is None:
        alleles, phases = (np.concatenate([found[t][k] for t in sorted(found)], 1) for k in (0, 1))
    elif columns:
        place = {(t, c): k for t in own for k, c in enumerate(own[t])}
        alleles, phases = (np.stack([found[t][k][:, place[t, c]] for t, c in columns], 1) for k in (0, 1))
    else:
        alleles, phases = (found[one.tile][k] for k in (0, 1))
    width = alleles.shape[1] * alleles.shape[2]
    alleles, phases = alleles.reshape(len(rows), width), phases.reshape(len(rows), phases.shape[1] * phases.shape[2])
    known = {"v": one.first_v + rows, "contig": one.contig, "pos": pos[rows], "block_id": one.block_id, "row_in_block": rows, "ploidy": one.ploidy}
    if packed:
        return pd.DataFrame(known | {"n_alleles": width} | {name: [bitpack.number_bytes(x) for x in found] for name, found in (("alleles", alleles), ("phases", phases))})
    return pd.DataFrame(known | {"alleles": list(alleles), "phases": list(phases)})


def _chosen(spark: SparkSession, path: str, start: int | None, end: int | None, contig: str | None, columns: list[int] | None, blocks_: tuple[int, int] | None) -> tuple[DataFrame, DataFrame, list[tuple[int, int]] | None, int]:
    """The rows of the table of blocks that a read needs; the parameter sets; tile and place of each sample; the number of tiles."""
    version = _version(spark, path)
    packed = blocks_of(spark, path, version)
    if blocks_ is not None:
        packed = packed.where(F.col("block_id").between(*blocks_))
    if contig is not None:
        packed = packed.where(F.col("contig") == contig)
    if start is not None and end is not None:
        if start > end:
            raise ValueError("start lies behind end")
        packed = packed.where((F.col("min_pos") <= end) & (F.col("max_pos") >= start))
    tiles = sorted((r["first_s"], r["tile"], r["n_samples"]) for r in spark.read.parquet(f"{path}/tiles").collect())  # one short row a tile
    places = None
    if columns is not None:
        firsts = [t[0] for t in tiles]
        at = [bisect.bisect_right(firsts, s) - 1 for s in columns]
        if any(s < 0 or s >= tiles[k][0] + tiles[k][2] for s, k in zip(columns, at, strict=True)):
            raise ValueError("a sample lies outside of the store")
        places = [(tiles[k][1], s - tiles[k][0]) for s, k in zip(columns, at, strict=True)]
        wanted = sorted({t for t, _ in places}) or [0]
        packed = packed.where(F.col("tile").isin(wanted))
        tiles = wanted
    sets = F.broadcast(parameters_of(spark, path, version))  # at most MOST_SETS rows
    return packed, sets, places, len(tiles)


def _with_sets(packed: DataFrame, sets: DataFrame) -> DataFrame:
    return packed.select(*_COPIED, "tile", "positions", "payload", "set_id").join(sets, "set_id")


def scan(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, contig: str | None = None, columns: list[int] | None = None, blocks_: tuple[int, int] | None = None) -> tuple[DataFrame, list[tuple[int, int]] | None, int]:
    """The stored blocks and tiles that a read needs, with their parameter sets; tile and place of each sample; the number of tiles.

    Tiles are folders, so others are not opened; blocks outside of the range or contig are skipped by the files' statistics.
    """
    packed, sets, places, tiles = _chosen(spark, path, start, end, contig, columns, blocks_)
    return _with_sets(packed, sets), places, tiles


def read(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, contig: str | None = None, columns: list[int] | None = None, blocks_: tuple[int, int] | None = None, packed: bool = False) -> DataFrame:
    """Variant rows of a store, of a contig or a range of positions: blocks and tiles outside are not read, other rows and samples are cut.

    columns: samples in the order wanted, repeats kept; blocks_: first and last block; packed: rows with bytes in place of arrays, as `write` takes them too.  Samples of one tile are decoded where they are read; for several
    tiles the coded bytes of a block meet in one task.
    """
    chosen, sets, places, tiles = _chosen(spark, path, start, end, contig, columns, blocks_)
    schema = PACKED if packed else _ROWS
    if tiles > 1:
        first = F.col("tile") == min((t for t, _ in places or ()), default=0)  # a block's positions move once
        found = spread(_with_sets(chosen.withColumn("positions", F.when(first, F.col("positions"))), sets), "block_id", size=_bytes(chosen))
        return found.groupBy("block_id").applyInPandas(lambda frame: decoded_rows(list(frame.itertuples()), start, end, places, packed), schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                yield decoded_rows([r], start, end, places, packed)

    return _with_sets(chosen, sets).mapInPandas(run, schema)


def unpacked(rows: DataFrame) -> DataFrame:
    """Packed variant rows with arrays again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                n, ploidy = (row.column(c)[0].as_py() for c in ("n_alleles", "ploidy"))
                made = {name: bitpack.numbers_of(row.column(name)[0].as_py(), size).astype(np.int32) for name, size in (("alleles", n), ("phases", n - n // max(ploidy, 1)))}
                yield pa.RecordBatch.from_pydict({c: pa.array([made[c]], pa.list_(pa.int32())) if c in made else row.column(c) for c in _names(_ROWS)})

    return rows.select(*_names(PACKED)).mapInArrow(run, _ROWS)


def read_cells(spark: SparkSession, path: str, **where: object) -> DataFrame:
    return layout.cells(read(spark, path, **where))


def write_units(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The store as bytes: parameter sets and access units, in rows."""
    found = blocks_of(spark, path).select("block_id", "au_id", "set_id", "payload")
    return container.sets_to_bytes(parameters_of(spark, path)), container.units_to_bytes(found)
