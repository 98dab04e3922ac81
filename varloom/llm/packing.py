"""Packing along a space-filling curve.

Each text becomes a hashed vector: every word adds plus or minus one, by bits of its hash, to each of a few
dimensions; the sums, divided by the root of the number of words, are quantised on the normal scale.  The
documents are range-sorted by the Hilbert key of that point, so neighbours on the curve share words, and
their ids are laid end to end into sequences, cut wherever a sequence is full.  Each range fills its own
sequences; only its last one is padded, to a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm import bytescan as bs
from varloom.llm import wordtokens as wt
from varloom.llm.shared import docs_of

#: Dimensions of the projected vector and bits of each.
DIMENSIONS, BITS = 4, 8


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """The position on the Hilbert curve of each row of a (rows, dimensions) array of `bits`-bit coordinates."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:  # undo the curve's rotations from the coarsest level on
        low = level - 1
        for i in range(dims):
            high = (x[i] & level) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    turn, level = np.zeros_like(x[0]), 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[-1] & level) > 0, level - 1, 0)
        level >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def project(column: pa.Array, dims: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Quantised coordinates of each text; a text without words lies at the middle."""
    out = np.zeros((len(column), dims))
    for low, high, data, bounds in bs.pieces(column):
        starts, ends = bs.runs(bs.NOT_SPACE[data], bounds)
        h = bs.span_hash(bs.LOWER[data], starts, ends)
        at = np.searchsorted(starts, bounds)
        count = np.diff(at)
        for k in range(dims):
            sums = np.concatenate([[0], np.cumsum(1 - 2 * ((h >> np.uint64(7 * k + 3)) & np.uint64(1)).astype(np.int64))])
            out[low:high, k] = (sums[at[1:]] - sums[at[:-1]]) / np.sqrt(np.maximum(count, 1))
    # The logistic curve is close to the normal one; the scale spreads the words' uneven sums.
    return np.minimum((1 << bits) - 1, (1 << bits) / (1 + np.exp(-out * 0.85))).astype(np.int64)


def _curve_key(text: pd.Series) -> pd.Series:
    return pd.Series(hilbert_key(project(pa.array(text, pa.string(), from_pandas=True)), BITS))


def _fill(path: str, end_id: int, limit: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, context = wt.load(path), TaskContext.get()
        base, filled = (context.partitionId() if context else 0) << 33, 0
        for batch in batches:
            ids, bounds = wt.with_end(*tokenizer.encode(batch.column(1)), end_id)
            docs = batch.column(0)
            place = bounds + filled  # in the range's stream of ids
            first, last = place[:-1] // limit, (place[1:] - 1) // limit
            n = last - first + 1
            row = np.repeat(np.arange(len(docs)), n)
            sequence = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            start = np.maximum(place[row], sequence * limit)
            end = np.minimum(place[row + 1], (sequence + 1) * limit)
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((start - filled).tolist(), (end - filled).tolist(), strict=True)]
            columns = [docs.take(pa.array(row)), start - place[row], end - start, pa.array(crc, pa.int64()), np.diff(bounds)[row], base + sequence, start - sequence * limit]
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                cuts = np.concatenate([start - filled, [len(ids)]]) if len(row) else np.zeros(1, np.int64)
                arrays.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            filled += len(ids)
            yield pa.RecordBatch.from_arrays(arrays, names)
        bs.give_back()

    return run


def pack(df: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences of at most `limit` ids.

    One row a piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id,
    offset (in the sequence, gapless from 0) and, with keep_ids, ids.  Each id, the end id included, lies in
    exactly one piece; sequence ids are unique, not gapless.  Null and empty texts are documents of the end id
    alone; repeated rows are packed each by itself; an empty table gives no piece.
    """
    ordered = docs_of(df, doc_id, text).withColumn("curve", F.pandas_udf(_curve_key, "long")("text"))
    ordered = ordered.repartitionByRange("curve", "doc_id").sortWithinPartitions("curve", "doc_id").select("doc_id", "text")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    return ordered.mapInArrow(_fill(tokenizer_path, end_id, limit, keep_ids), schema)
