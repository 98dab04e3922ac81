"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of word shingles, a signature of minima (a byte of each is kept) and band values.
   Texts with equal sets form a class, of which the smallest id goes on.
2. Classes that share a band value are candidates.  A bucket is not taken apart into all its pairs: each member
   is paired with the bucket's smallest id.
3. Signatures of a pair are compared batch by batch.  When the posterior chance that the similarity reaches the
   threshold falls under `MISS`, the pair is pruned.
4. Survivors are verified on their full sets.  First each class's likeliest pair; then the pairs that lie between
   different components; last, buckets that still hold several components are compared in cells.  A cell holds
   two blocks of members with their sets, prunes and verifies pairs of different components, joins components as
   links are found, and returns only the links that joined some, fewer than it has members.  Blocks of the bucket's
   main component are not compared with one another, nor blocks whose set sizes are too far apart for a link.
   So pairs are never made rows, yet no link between two members that share a bucket is lost.

Two sets of similarity 0.8 share no band with probability (1 - 0.8 ** ROWS) ** BANDS, 6e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm import bytescan as bs
from varloom.llm.components import components
from varloom.llm.shared import discard, small, written

BANDS, ROWS = 36, 5
HASHES = BANDS * ROWS
#: Chance, by the posterior, under which a pair is pruned; minima compared at a time.
MISS, STEP = 1e-7, 20
#: Members and bytes of a block, about, when the members of a bucket are compared with one another.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Bytes that are kept of a shingle's hash.
WIDTH = 6
_LAST = (1 << 63) - 1

_rng = np.random.default_rng(20250311)
_FACTOR = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, offsets by row) of the sorted distinct shingles of each text, in bounded portions."""
    for low, _, data, bounds in bs.pieces(column):
        data = bs.LOWER[data]
        starts, ends = bs.runs(bs.NOT_SPACE[data], bounds)
        h, at = bs.span_hash(data, starts, ends), np.searchsorted(starts, bounds)
        count = np.diff(at)
        row = bs.row_of(at, len(h))
        inside = np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1]) if len(h) >= size else np.zeros(0, np.int64)
        keys, rows = [bs.gram_hash(h, size)[inside]], [row[inside]]
        for n in range(1, size):  # a text of fewer words is one shingle
            short = np.flatnonzero(count == n)
            if len(short):
                total = np.zeros(len(short), np.uint64)
                for k in range(n):
                    total = total * _SPREAD + h[at[short] + k]
                keys.append(bs.mix(total + np.uint64(n)))
                rows.append(short)
        key, row = np.concatenate(keys), np.concatenate(rows)
        order = np.lexsort((key, row))
        key, row = key[order], row[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        key, row = key[new], row[new]
        yield low, key, np.searchsorted(row, np.arange(len(bounds)))


def minima(key: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The HASHES minima of each row's shingles; rows without shingles get zeros."""
    out = np.zeros((len(bounds) - 1, HASHES), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        x, first = (key >> np.uint64(32)).astype(np.uint32), bounds[:-1][full]
        for i in range(HASHES):
            out[full, i] = np.minimum.reduceat(x * _FACTOR[i] + _SHIFT[i], first)
    return out


_SIGNED = "id long, n_shingles long, set_a long, set_b long, bands array<long>"
_SETS = "id long, bands array<long>, signature binary, members binary"


def _cut(raw: bytes, ends: np.ndarray) -> pa.Array:
    """Consecutive parts of bytes as a binary column."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype("<i8").tobytes()), pa.py_buffer(raw)]).cast(pa.binary())


def _signed(size: int, full: bool):
    """What _SIGNED names of each text; full: what _SETS names, signature and set included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bs.begin()
        for batch in batches:
            for low, key, bounds in shingle_sets(batch.column(1), size):
                rows = len(bounds) - 1
                ids = batch.column(0).slice(low, rows)
                least = minima(key, bounds)
                bands = np.zeros((rows, BANDS), np.uint64)
                for k in range(ROWS):
                    bands = bands * _SPREAD + least[:, k::ROWS]
                bands = bs.mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
                if full:
                    signature, kept = np.ascontiguousarray((least & 255).astype(np.uint8)), np.ascontiguousarray(key.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH])
                    yield pa.RecordBatch.from_pydict({"id": ids, "bands": listed, "signature": _cut(signature.tobytes(), np.arange(rows + 1) * HASHES), "members": _cut(kept.tobytes(), bounds * WIDTH)})
                    continue
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(bs.mix(key + np.uint64(salt)), dtype=np.uint64)]) for salt in (1, 2)]
                set_a, set_b = (pa.array((x[bounds[1:]] - x[bounds[:-1]]).view(np.int64)) for x in sums)
                yield pa.RecordBatch.from_pydict({"id": ids, "n_shingles": pa.array(np.diff(bounds), pa.int64()), "set_a": set_a, "set_b": set_b, "bands": listed})

    return run


def fewest_matches(threshold: float, miss: float = MISS) -> list[int]:
    """After each batch of minima, the fewest equal ones at which a similarity of `threshold` is still likely enough.

    The prior is even; a kept byte is equal by chance once in 256 times.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-np.minimum(p, 1 - 1e-12))
            weight = np.exp(log - log.max())
            if weight[s >= threshold].sum() >= miss * weight.sum():
                out.append(m)
                break
    return out


def _likely(threshold: float):
    least = fewest_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint8).reshape(-1, HASHES) for n in ("signature_a", "signature_b"))
            live, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, few in enumerate(least):
                part = slice(k * STEP, (k + 1) * STEP)
                matches[live] += (a[live, part] == b[live, part]).sum(1)
                live = live[matches[live] >= few]
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").take(live), "b": batch.column("b").take(live), "matches": pa.array(matches[live], pa.int64())})

    return run


def likely(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """a, b and matches of the pairs that sequential comparison does not prune."""
    side = lambda n: signed.select(F.col("id").alias(n), F.col("signature").alias(f"signature_{n}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "signature_a", "signature_b").mapInArrow(_likely(threshold), "a long, b long, matches long")


class _Joined:
    """Components of a cell's members, joined as links between them are found."""

    def __init__(self, component: np.ndarray):
        self.of = np.unique(component, return_inverse=True)[1]

    def unite(self, k: int, other: np.ndarray) -> list[int]:
        """Members of `other`, one of each component, that bring new components to that of k."""
        _, first = np.unique(self.of[other], return_index=True)
        fresh = [j for j in other[first].tolist() if self.of[j] != self.of[k]]
        self.of[np.isin(self.of, self.of[fresh])] = self.of[k]
        return fresh


def _overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members of a sorted set each of the others has."""
    ends = np.cumsum([len(x) for x in others])
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    hits = np.concatenate([[0], np.cumsum(one[at] == every)])
    return np.diff(hits[ends], prepend=0)


def _cells(threshold: float, percent: int):
    """The links that join components inside each cell; a pair is compared where its first common band is."""
    least = fewest_matches(threshold)

    def compared(key: int, rows: list[tuple]) -> tuple[list[int], list[int]]:
        ids, component, code = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2))
        bands, signs = np.stack([r[3] for r in rows]), np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
        sets, joined, split = [_decoded(r[5]) for r in rows], _Joined(component), code.min() != code.max()
        size = np.array([len(x) for x in sets])
        found: tuple[list[int], list[int]] = ([], [])
        for k in range(len(rows) - 1):
            other = np.flatnonzero(joined.of[k + 1 :] != joined.of[k]) + k + 1
            if split:
                other = other[code[other] != code[k]]
            other = other[100 * np.minimum(size[other], size[k]) >= percent * np.maximum(size[other], size[k])]
            if len(other):
                other = other[bands[other, (bands[other] == bands[k]).argmax(1)] == key]
            matches = np.zeros(len(other), np.int64)
            for n, few in enumerate(least):
                if not len(other):
                    break
                part = slice(n * STEP, (n + 1) * STEP)
                matches += (signs[other, part] == signs[k, part]).sum(1)
                other, matches = other[matches >= few], matches[matches >= few]
            other = other[np.argsort(-matches, kind="stable")]
            while len(other):  # the likeliest first: a link spares the rest of its component
                some, other = other[:64], other[64:]
                common = _overlaps(sets[k], [sets[j] for j in some])
                linked = some[100 * common >= percent * (size[k] + size[some] - common)]
                for j in joined.unite(k, linked) if len(linked) else ():
                    found[0].append(int(ids[k]))
                    found[1].append(int(ids[j]))
                other = other[joined.of[other] != joined.of[k]]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def done() -> pa.RecordBatch:
            a, b = compared(cell[0], rows) if len(rows) > 1 else ([], [])
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("key", "low", "high", "id", "component", "code")]
            columns += [batch.column("bands").flatten().to_numpy().reshape(-1, BANDS), batch.column("signature").to_pylist(), batch.column("members").to_pylist()]
            for key, low, high, *row in zip(*columns, strict=True):
                if (key, low, high) != cell:
                    if rows:
                        yield done()
                    cell, rows = (key, low, high), []
                rows.append(tuple(row))
        if rows:
            yield done()
        bs.give_back()

    return run


def _across(bucketed: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components of members which share a bucket: bucketed(key, b, n), found(id, component).

    A bucket's members are grouped by size of set and by whether they are of its main component, and each group is
    dealt into blocks of about `BLOCK` members.  Two blocks that can hold a link are a cell.  A small bucket is one cell.
    """
    placed = bucketed.join(found.select(F.col("id").alias("b"), "component"), "b", "left").withColumn("component", F.coalesce("component", "b"))
    weight = F.col("n") * WIDTH + HASHES + 8 * BANDS
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("members"), F.sum(weight).alias("bytes"))
    several = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("members", "component")).alias("main"), F.sum("members").alias("members"), F.sum("bytes").alias("bytes")).where("parts > 1")
    tier = F.floor(F.log("n") / math.log(100 / percent)).cast("int")  # sets that can be linked are of the same or the next tier
    single = (F.col("members") <= BLOCK) & (F.col("bytes") <= BLOCK_BYTES)
    placed = placed.join(several, "key").withColumn("grp", F.when(single, 0).otherwise(2 + 2 * tier + (F.col("component") == F.col("main")).cast("int")))
    blocks = placed.where("grp > 0").groupBy("key", "grp").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(weight) / BLOCK_BYTES)).cast("long").alias("blocks"))
    blocks = blocks.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("grp", "blocks"))).alias("blocks"))  # a few entries: tiers of set sizes
    dealt = placed.select("key", "b", "component", "grp").join(blocks, "key", "left")
    many = lambda g: F.coalesce(F.try_element_at("blocks", g), F.lit(0).cast("long"))
    code = lambda g, i: F.shiftleft(g.cast("long"), 32) + i
    dealt = dealt.withColumn("code", F.when(F.col("grp") > 0, code(F.col("grp"), F.pmod(F.xxhash64("b"), many(F.col("grp"))))).otherwise(F.lit(0).cast("long")))
    is_main, base = F.col("grp") % 2, F.col("grp") - F.col("grp") % 2
    all_of = lambda g: F.transform(F.sequence(F.lit(0).cast("long"), many(g) - 1), lambda i: code(g, i))
    reached = []
    for step in (-2, 0, 2):
        for main in (0, 1):
            g = base + step + main
            reachable = (many(g) > 0) & ~((is_main == 1) & F.lit(main == 1))
            reached.append(F.when(reachable, all_of(g)).otherwise(F.array().cast("array<long>")))
    other = F.when(F.col("grp") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.concat(*reached))
    rows = dealt.join(sets.withColumnRenamed("id", "b"), "b").withColumn("other", F.explode(other))
    rows = rows.select("key", F.least("code", "other").alias("low"), F.greatest("code", "other").alias("high"), F.col("b").alias("id"), "component", "code", "bands", "signature", "members")
    cells = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return cells.mapInArrow(_cells(percent / 100, percent), "a long, b long")


def _decoded(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    out[:, 8 - WIDTH :] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return out.view(">u8").ravel().astype(np.uint64)


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(low, 1000) for b in batches for low in range(0, b.num_rows, 1000)):
            keep = []
            for x, y in zip(batch.column("members_a"), batch.column("members_b"), strict=True):
                a, b = _decoded(x.as_py()), _decoded(y.as_py())
                both = np.sort(np.concatenate([a, b]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            found = np.flatnonzero(keep)
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").take(found), "b": batch.column("b").take(found)})
        bs.give_back()

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.  b, the side with fewer pairs, gets its set first."""
    side = lambda n: sets.select(F.col("id").alias(n), F.col("members").alias(f"members_{n}"))
    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "members_a", "members_b").mapInArrow(_linked(percent), "a long, b long")


def near_copies(df: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_shingles (distinct), component_id (smallest id reachable), kept.

    Words are lower-cased (ASCII) and split at ASCII white space; a text with fewer words than a shingle is one
    shingle, and one without words (or null) has none and is linked with nothing.  Texts are linked when
    100 * intersection >= percent * union.  Rows that share an id are versions of one document, linked where any
    version is; rows without an id rank last, as versions of one document without an id; an empty table gives
    no rows.
    """
    given = df.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LAST)).alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    signed = written(given.mapInArrow(_signed(shingle, False), _SIGNED), "signatures")

    classes = written(signed.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("id").alias("class"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "classes")
    members = signed.join(small(classes), ["set_a", "set_b"], "left").withColumn("class", F.coalesce("class", "id"))
    banded = members.where("n_shingles > 0 AND class = id").select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    leads = banded.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("most")).where("most > a").select("key", "a")
    bucketed = written(banded.join(leads, "key").select("key", "a", F.col("id").alias("b"), "n"), "buckets")
    # The texts that share a bucket are read and signed once more: that takes less disk than keeping the sets of all.
    sets = written(given.join(bucketed.select(F.col("b").alias("id")).distinct(), "id", "left_semi").mapInArrow(_signed(shingle, True), _SETS), "sets")
    stars = written(likely(bucketed.where("a <> b").select("a", "b").distinct(), sets, percent / 100), "candidates")

    best = stars.groupBy("b").agg(F.max_by("a", F.struct("matches", -F.col("a"))).alias("a"))
    # Rows that share an id but not a set are in several classes, which belong together.
    versions = members.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("most")).where("most > a").select("id", "a")
    versions = members.join(small(written(versions, "versions")), "id").select("a", F.col("class").alias("b"))
    links = written(verified(best, sets, percent).unionByName(versions), "verified")
    found = components(links)
    named = lambda n: found.select(F.col("id").alias(n), F.col("component").alias(f"component_{n}"))
    between = stars.join(best.withColumn("tried", F.lit(True)), ["a", "b"], "left").where("tried IS NULL").select("a", "b")
    between = between.join(named("b"), "b", "left").join(named("a"), "a", "left")
    between = between.where(F.coalesce("component_a", "a") != F.coalesce("component_b", "b"))
    same = lambda found: found.select(F.col("id").alias("a"), F.col("component").alias("b"))
    for step in ("stars", "cells"):
        more = verified(between, sets, percent) if step == "stars" else _across(bucketed.select("key", "b", "n"), found, sets, percent)
        joined = components(written(same(found).unionByName(more), "verified"))
        found = joined
    done = members.select("id", "n_shingles", "class").join(found.select(F.col("id").alias("class"), "component"), "class", "left").select("id", "n_shingles", F.coalesce("component", "class").alias("component"))
    discard(bucketed, sets, stars)
    real = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return done.select(real("id").alias("doc_id"), "n_shingles", real("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
