"""Token-id output: fixed-width bit packing in blocks, with random access.

File format: a Parquet table, one row a block.  A block holds the ids of some whole consecutive documents,
each id in the fewest bits that the vocabulary needs, least significant bit first:

  part, block       the range of documents and the block's number in it; (part, block) gives file order
  first             ids of the part before this block
  n_ids, width      ids in the block, bits of each
  low_id, high_id   smallest and largest doc_id (null if it has none); Parquet's statistics prune on them
  doc_ids, ends     documents of the block (null: without an id) and the end offset of each, in ids
  payload           n_ids * width bits

Documents are in ascending doc_id order over the parts, those without an id last.  Any span of ids is unpacked from its own bytes
(`unpack_span`), so one document is read without unpacking its block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.llm import wordtokens as wt
from varloom.llm.shared import docs_of, shared_dir

#: A block closes at the end of the document that brings it to this many ids.
BLOCK_IDS = 1 << 16

BLOCK_SCHEMA = (
    "part int, block int, first long, n_ids long, width int, low_id long, high_id long, doc_ids array<long>, ends array<long>, payload binary"
)


def id_width(vocabulary: int) -> int:
    """Bits that the largest id of a vocabulary needs."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    out = []
    for low in range(0, len(ids), 1 << 16):  # a multiple of 8 ids fills whole bytes
        bits = (ids[low : low + (1 << 16), None].astype(np.uint32) >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack_span(payload: bytes, width: int, start: int, end: int) -> np.ndarray:
    """The ids start..end of a packed block, from the bytes that hold them alone."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", end - start, start * width // 8).astype(np.uint32)
    low, high = start * width // 8, -(-end * width // 8)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, high - low, low), bitorder="little")
    bits = bits[start * width - low * 8 :][: (end - start) * width].reshape(-1, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


def _blocks(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, context = wt.load(path), TaskContext.get()
        part, width = context.partitionId() if context else 0, id_width(tokenizer.vocabulary)
        block = first = 0
        for batch in batches:
            ids, bounds = wt.with_end(*tokenizer.encode(batch.column(1)), end_id)
            docs = batch.column(0)
            low = 0
            while low < len(docs):
                high = min(len(docs), max(low + 1, int(np.searchsorted(bounds, bounds[low] + block_ids))))
                a, b = int(bounds[low]), int(bounds[high])
                own = docs.slice(low, high - low)
                ends = pc.min_max(own)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "first": pa.array([first], pa.int64()),
                        "n_ids": pa.array([b - a], pa.int64()), "width": pa.array([width], pa.int32()),
                        "low_id": pa.array([ends["min"].as_py()], pa.int64()), "high_id": pa.array([ends["max"].as_py()], pa.int64()),
                        "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), "ends": pa.array([bounds[low + 1 : high + 1] - a], pa.list_(pa.int64())),
                        "payload": pa.array([pack(ids[a:b], width)], pa.binary()),
                    }
                )
                block, first, low = block + 1, first + b - a, high

    return run


def write_tokens(df: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode every text and write the packed blocks under `path`, in ascending doc_id order.

    Null and empty texts are documents of the end id alone.  Rows that share a doc_id are separate documents,
    side by side; those without a doc_id come last, and are listed by `read_index` but not found by `read_ids`.
    A second key deals out the rows of one id, so that many of them do not meet in one task.  An empty table gives
    an empty store.
    """
    docs = docs_of(df, doc_id, text).withColumn("place", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_last(), F.col("place")]
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(_blocks(tokenizer_path, end_id, block_ids), BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack_span(row["payload"], row["width"], 0, row["n_ids"])
            raw, ends = memoryview(ids.astype("<u4").tobytes()), np.array(row["ends"], np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(np.full(len(ends), row["part"], np.int32)), "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "inside": pa.array(starts + row["first"]), "n_tokens": pa.array(ends - starts),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                }
            )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of every stored document, from the packed ids."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # One row a part, so as many as tasks wrote the store.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    found = blocks.select("part", "first", "n_ids", "width", "doc_ids", "ends", "payload").mapInArrow(
        _documents, "part int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    return found.join(before, "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, doc_ids: DataFrame) -> DataFrame:
    """doc_id and ids (array) of the documents named in the column doc_id of a frame; others are not unpacked."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_span(row["payload"], row["width"], row["start"], row["end"])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([row["doc_id"]], pa.int64()), "ids": pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))})

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    places = blocks.select("part", "block", F.posexplode(F.arrays_zip("doc_ids", "ends")).alias("k", "doc"), "ends")
    places = places.select("part", "block", F.col("doc.doc_ids").alias("doc_id"), F.when(F.col("k") > 0, F.expr("ends[k - 1]")).otherwise(0).alias("start"), F.col("doc.ends").alias("end"))
    wanted = places.join(doc_ids.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    return wanted.join(blocks.select("part", "block", "width", "payload"), ["part", "block"]).select("doc_id", "start", "end", "width", "payload").mapInArrow(cut, "doc_id long, ids array<long>")


def token_store(df: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write a store into the shared folder and return `read_index` of it."""
    import uuid

    path = f"{shared_dir(df.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(df, path, tokenizer_path, end_id)
    return read_index(df.sparkSession, path)
