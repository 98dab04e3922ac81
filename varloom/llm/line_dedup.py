"""Line dedup: hashes of lines in sorted ranges, streamed for their first document, to a keep bitmap a document.

1. A task finds the lines of its texts and hashes their keys (128 bits).  Of the lines of one key in a task's share, all
   but those of the smallest document are settled at once, so a line that stands everywhere leaves a task once.
2. The others are dealt to equal ranges of the hash, which is as good as random, and sorted there by hash, document and
   position.  A task streams its range: the first document of a hash keeps its lines, later documents lose theirs.
3. What was settled and found comes together by document as a bitmap of its lines, compressed; texts are not moved.

`drop_lines` joins the bitmaps with the texts and applies them.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm import bytescan as bs

#: Bytes of text whose lines a task settles at once, and bytes of input for each range.
SHARE, RANGE = 8 << 20, 32 << 20
#: A second set of random values of the bytes, for the other half of a hash.
_OTHER_CODE = np.random.default_rng(77003131).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: Rank of rows without an id.
_LAST = (1 << 63) - 1


def lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of all rows, and the first line of each row (one more than rows); a row has a line at least."""
    breaks = np.flatnonzero(data == 10)
    first = np.zeros(len(bounds), np.int64)
    np.cumsum(np.bincount(np.searchsorted(bounds, breaks, "right") - 1, minlength=len(bounds) - 1) + 1, out=first[1:])
    total = int(first[-1])
    starts, ends = np.empty(total, np.int64), np.empty(total, np.int64)
    inner = np.ones(total, bool)
    inner[first[:-1]] = False
    starts[first[:-1]], starts[inner] = bounds[:-1], breaks + 1
    inner[:] = True
    inner[first[1:] - 1] = False
    ends[first[1:] - 1], ends[inner] = bounds[1:], breaks
    return starts, ends, first


def keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line without the white space at both ends, and its code points."""
    solid = np.flatnonzero(bs.NOT_SPACE[data])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    there = high > low
    first, last = starts.copy(), starts.copy()
    first[there], last[there] = solid[low[there]], solid[high[there] - 1] + 1
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    return first, last, points[last] - points[first]


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """The equal range of 64-bit hashes that holds each."""
    return (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int32)


_FOUND = "part int, h1 long, h2 long, doc long, tag binary, pos int, n_lines int, dropped binary"


def _rows(part: np.ndarray, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, tag: pa.Array, pos: np.ndarray, n_lines: pa.Array, dropped: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(part), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(doc), tag, pa.array(pos.astype(np.int32)), n_lines, dropped],
        names=["part", "h1", "h2", "doc", "tag", "pos", "n_lines", "dropped"],
    )


def _scan(least: int, ranges: int):
    """Entries (n_lines null) of lines that may keep, and one row a document with its number of lines and its settled ones."""

    def settled(docs: list[np.ndarray], tags: list[pa.Array], counts: list[np.ndarray], parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, tag, count = np.concatenate(docs), pa.concat_arrays(tags), np.concatenate(counts)
        row, pos, h1, h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, row, doc[row], h2, h1))
        row, pos, h1, h2 = (x[order] for x in (row, pos, h1, h2))
        new = np.ones(len(row), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        head = np.flatnonzero(new)
        lost = doc[row] != np.repeat(doc[row[head]], np.diff(np.append(head, len(row)))) if len(row) else np.zeros(0, bool)
        kept = ~lost
        none = pa.nulls(int(kept.sum()), pa.int32())
        yield _rows(_range_of(h1[kept], ranges), h1[kept], h2[kept], doc[row[kept]], tag.take(pa.array(row[kept])), pos[kept], none, pa.nulls(len(none), pa.binary()))
        order = np.lexsort((pos[lost], row[lost]))
        at, own = pos[lost][order].astype("<u4"), np.bincount(row[lost], minlength=len(doc))
        bounds = np.concatenate([[0], np.cumsum(own)]) * 4
        dropped = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(bounds.astype("<i8").tobytes()), pa.py_buffer(at.tobytes())]).cast(pa.binary())
        h = bs.mix(doc.astype(np.uint64) + np.arange(len(doc), dtype=np.uint64))
        yield _rows(_range_of(h, ranges), h, np.zeros(len(doc), np.uint64), doc, tag, np.full(len(doc), -1), pa.array(count.astype(np.int32)), dropped)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, tags, counts, parts, size, rows = [], [], [], [], 0, 0
        for batch in batches:
            doc, tag = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("tag")
            for low, high, data, bounds in bs.pieces(batch.column("text")):
                starts, ends, first = lines(data, bounds)
                own_row = np.repeat(np.arange(high - low), np.diff(first))
                a, b, points = keys(data, starts, ends)
                used = points >= least
                lower = bs.LOWER[data]
                h1, h2 = (bs.span_hash(lower, a[used], b[used], code) for code in (bs.BYTE_CODE, _OTHER_CODE))
                docs.append(doc[low:high])
                tags.append(tag.slice(low, high - low))
                counts.append(np.diff(first))
                parts.append((own_row[used] + rows, (np.arange(len(starts)) - first[own_row])[used], h1, h2))
                rows, size = rows + high - low, size + len(data)
                if size >= SHARE:
                    yield from settled(docs, tags, counts, parts)
                    docs, tags, counts, parts, size, rows = [], [], [], [], 0, 0
        if docs:
            yield from settled(docs, tags, counts, parts)

    return run


_LOST = "doc long, tag binary, pos int, n_lines int, dropped binary"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted entries those that are not in the first document of their hash; rows of documents pass."""
    held = (None, None, None)  # the last hash and its first document
    for batch in batches:
        h1, h2, doc = (batch.column(n).to_numpy() for n in ("h1", "h2", "doc"))
        entry = batch.column("n_lines").is_null().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(entry)
        lost = ~entry
        if len(at):
            a, b, d = h1[at], h2[at], doc[at]
            new = np.ones(len(at), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            head = np.flatnonzero(new)
            first = d[head].copy()
            if held[:2] == (int(a[0]), int(b[0])):
                first[0] = held[2]
            lost[at] = d != np.repeat(first, np.diff(np.append(head, len(at))))
            held = (int(a[-1]), int(b[-1]), int(first[-1]))
        if lost.any():
            yield batch.filter(pa.array(lost)).select(["doc", "tag", "pos", "n_lines", "dropped"])


def bitmap(dropped: np.ndarray, n_lines: int) -> bytes:
    """A bit for each line, 1 where it stays, compressed; nothing at all where every line stays."""
    if not len(dropped):
        return b""
    keep = np.ones(n_lines, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def kept_lines(raw: bytes | None, n_lines: int) -> np.ndarray:
    """The bits of a bitmap again, as booleans."""
    return np.unpackbits(np.frombuffer(zlib.decompress(raw), np.uint8))[:n_lines].astype(bool) if raw else np.ones(n_lines, bool)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, n_dropped = [], []
        for n, settled, more in zip(*(batch.column(c).to_pylist() for c in ("n_lines", "settled", "more")), strict=True):
            at = np.unique(np.concatenate([np.frombuffer(b"".join(settled), "<u4").astype(np.int64), np.array(more, np.int64)]))
            found.append(bitmap(at, n))
            n_dropped.append(len(at))
        yield pa.RecordBatch.from_pydict({"key": batch.column("doc"), "tag": batch.column("tag"), "n_lines": batch.column("n_lines").cast(pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "keep": pa.array(found, pa.binary())})


def _keyed(df: DataFrame, doc_id: str, text: str) -> tuple[Column, Column, Column]:
    """Rank of a row's document, a tag of its text (rows of one document and text have one bitmap), and the text."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LAST)).alias("key"), F.unhex(F.md5(body.cast("binary"))).alias("tag"), body.alias("text")


def keep_bitmaps(df: DataFrame, least: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """key (the document), tag, n_lines, n_dropped and keep (`kept_lines` reads it), one row for each document and text.

    Lines end at line feeds.  A line's key is the line without white space at both ends, A-Z in lower case; keys of at
    least `least` code points in several documents lose their lines in all but the document with the smallest id.
    Null and empty texts are one empty line.  Rows that share an id are one document and take nothing from each other;
    rows without an id are one document that ranks last.  An empty table gives no rows.
    """
    spark = df.sparkSession
    key, tag, body = _keyed(df, doc_id, text)
    docs = df.select(key.alias("doc"), tag, body)
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE))
    found = docs.mapInArrow(_scan(least, ranges), _FOUND).repartitionById(ranges, F.col("part")).sortWithinPartitions("h1", "h2", "doc", "pos")
    lost = found.mapInArrow(_stream, _LOST)
    # Sets: what copies of a row repeat is left out before the shuffle, so a document's own lines at most come together.
    by_doc = lost.groupBy("doc", "tag").agg(F.max("n_lines").alias("n_lines"), F.collect_set("dropped").alias("settled"), F.collect_set(F.when(F.col("n_lines").isNull(), F.col("pos"))).alias("more"))
    return by_doc.mapInArrow(_bitmaps, "key long, tag binary, n_lines long, n_dropped long, keep binary")


def _results(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(low, 500) for b in batches for low in range(0, b.num_rows, 500)):
            data, bounds = bs.flat(batch.column("text"))
            texts, digests = [], []
            for k, (n, keep) in enumerate(zip(batch.column("n_lines").to_pylist(), batch.column("keep").to_pylist(), strict=True)):
                raw = data[bounds[k] : bounds[k + 1]].tobytes()
                if keep:
                    raw = b"\n".join(line for line, stays in zip(raw.split(b"\n"), kept_lines(keep, n).tolist(), strict=True) if stays)
                if "kept_text" in names:
                    texts.append(raw.decode())
                digests.append(hashlib.sha256(raw).hexdigest())
            made = {"kept_text": pa.array(texts, pa.string()), "kept_sha256": pa.array(digests, pa.string())}
            yield pa.RecordBatch.from_pydict({n: made[n] if n in made else batch.column(n) for n in names})

    return run


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("n_lines", "n_dropped", "kept_sha256", "kept_text")) -> DataFrame:
    """Struct `row` (the columns but the text) and `outputs` of each row of df, by the bitmaps of its table."""
    rest = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text))
    placed = df.select(*_keyed(df, doc_id, text), rest.alias("row")).join(bitmaps, ["key", "tag"]).select("row", "text", "n_lines", "n_dropped", "keep")
    kinds = {"n_lines": T.LongType(), "n_dropped": T.LongType(), "kept_sha256": T.StringType(), "kept_text": T.StringType()}
    schema = T.StructType([placed.schema["row"], *(T.StructField(n, kinds[n]) for n in outputs)])
    return placed.mapInArrow(_results(["row", *outputs]), schema)


def drop_lines(df: DataFrame, least: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df with repeated lines left out of their texts."""
    found = apply_bitmaps(df, keep_bitmaps(df, least, doc_id, text), doc_id, text, ("kept_text",))
    return found.select(*(F.col("kept_text").alias(text) if c == text else F.col("row")[c].alias(c) for c in df.columns))
