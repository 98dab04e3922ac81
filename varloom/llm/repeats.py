"""Suffix-array dedup: a depth-limited radix sort that orders suffixes only through the threshold's bytes.

A window is a string of `length` bytes.  Windows are sorted most significant digit first, over the cluster:

1. Digit one is the window's least `GRAM`-byte string by hash.  Neighbouring windows mostly share it, so a run of
   windows is one entry (an anchor), and about one byte in 14 starts one.  Entries are dealt to buckets by
   the digit; a digit that stays in one document ends there.
2. Digit two is the whole string that a run's windows cover.  In a bucket, groups equal in both digits are
   repeats: all but the smallest document lose that string.  What is equal in digit one alone goes on.
3. The last digit is the window itself: for the runs that are left, all `length` bytes.  Groups equal there
   are exactly the repeated windows.

Entries travel packed, a task's own repeats are settled before the shuffle, and a hot digit so takes one entry
of a task.  Memory is bounded by the size of a bucket, whose number follows the bytes of the input.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm import bytescan as bs
from varloom.llm.shared import written

#: Bytes of a first digit, of text in a bucket and of text that a task sorts at once.
GRAM, BUCKET, SORTED = 24, 16 << 20, 8 << 20
#: Bytes whose windows are found at once.
SLICE = 1 << 19
#: Windows of an entry, at most.
RUN = 255
_LAST = (1 << 63) - 1


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share their first digit: row, start in the text, windows, first digit, second digit."""
    gram = min(GRAM, length)
    reach, found = length - gram + 1, []
    for low in range(0, max(0, len(data) - length + 1), SLICE):
        x = data[low : low + SLICE + length - 1]
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(bs.BYTE_CODE[x] * bs.power("up", len(x) + 1)[: len(x)], out=sums[1:])
        down = bs.power("down", len(x) + 1)
        least = bs.mix((sums[gram:] - sums[:-gram]) * down[: len(x) - gram + 1])
        span = 1
        while 2 * span <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < reach:
            least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        inside = bounds[(bounds >= low) & (bounds < low + len(least))] - low
        new[inside] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(least)) - 1
        row = np.searchsorted(bounds, first + low, "right") - 1
        last = np.minimum(last, bounds[row + 1] - low - length)
        real = last >= first
        first, last, row = first[real], last[real], row[real]
        parts = (last - first) // RUN + 1
        if len(parts) and parts.max() > 1:
            k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            first, last, row = np.repeat(first, parts) + k * RUN, np.repeat(last, parts), np.repeat(row, parts)
            last = np.minimum(last, first + RUN - 1)
        whole = bs.mix((sums[last + length] - sums[first]) * down[first] + (last - first).astype(np.uint64))
        found.append((row.astype(np.int32), (first + low - bounds[row]).astype(np.uint32), (last - first + 1).astype(np.uint8), least[first], whole))
    kinds = (np.int32, np.uint32, np.uint8, np.uint64, np.uint64)
    return tuple(np.concatenate([np.zeros(0, kind), *(f[i] for f in found)]) for i, kind in enumerate(kinds))


def _high(x: np.ndarray, size: int) -> bytes:
    """The `size` high bytes of each 64-bit value."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :]).tobytes()


def _from_high(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, 8 - size :] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel().astype(np.uint64)


_CODEC = pa.Codec("zstd", 1)


def pack(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, count: np.ndarray, *digits: tuple[np.ndarray, int]) -> bytes:
    """Entries as bytes: places, in runs by document, compressed; digits as they are."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    first = np.flatnonzero(new)
    start = start.astype(np.int64)
    step = np.diff(start, prepend=0)
    step[first] = start[first]
    plain = b"".join(
        [np.diff(doc[first], prepend=0).astype("<i8").tobytes(), tag[first].astype("<i8").tobytes(), step.astype("<i8").tobytes(), np.diff(np.append(first, len(doc))).astype("<u4").tobytes(), count.astype("<u1").tobytes()]
    )
    small = _CODEC.compress(plain, asbytes=True)
    head = np.array([len(first), len(doc), len(plain), len(small)], "<i8").tobytes()
    return b"".join([head, small, *(_high(x, size) for x, size in digits)])


def unpack(raw: bytes, *sizes: int) -> tuple[np.ndarray, ...]:
    """doc, tag, start, count and the digits."""
    runs, n, full, small = np.frombuffer(raw, "<i8", 4).tolist()
    plain = _CODEC.decompress(raw[32 : 32 + small], full, asbytes=True)
    length = np.frombuffer(plain, "<u4", runs, 16 * runs + 8 * n).astype(np.int64)
    doc = np.repeat(np.cumsum(np.frombuffer(plain, "<i8", runs)), length)
    tag = np.repeat(np.frombuffer(plain, "<i8", runs, 8 * runs), length)
    step = np.frombuffer(plain, "<i8", n, 16 * runs)
    total = np.cumsum(step)
    first = np.cumsum(length) - length
    start = total - np.repeat(total[first] - step[first], length) if n else total
    out, at = [doc, tag, start, np.frombuffer(plain, "<u1", n, 20 * runs + 8 * n).astype(np.int64)], 32 + small
    for size in sizes:
        out.append(_from_high(raw[at : at + size * n], size))
        at += size * n
    return tuple(out)


def _bucket_of(doc: np.ndarray, tag: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of rows by document and text, so that rows which share an id, or have none, are dealt out too."""
    return (bs.mix(doc.astype(np.uint64) + tag.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)


def _dealt(bucket: np.ndarray, pieces: list[np.ndarray], sizes: list[int], kind: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, payload) of entries."""
    order = np.argsort(bucket, kind="stable")
    bucket, pieces = bucket[order], [p[order] for p in pieces]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=False):
        yield int(bucket[a]), kind, pack(*(p[a:b] for p in pieces[:4]), *zip((p[a:b] for p in pieces[4:]), sizes, strict=True))


_DEALT = "bucket int, kind int, payload binary"


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32()), "payload": pa.array([r[2] for r in rows], pa.binary())})


def _first_digits(length: int, buckets: int):
    """Entries of all texts; of those equal within a task's share, all but the smallest document's are settled."""

    def settled(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, tag, start, count, first, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
        key = bs.mix(first + whole * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        cut = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        ranked = doc[order]
        covered = np.empty(len(doc), bool)
        covered[order] = ranked > np.repeat(np.minimum.reduceat(ranked, cut), np.diff(np.append(cut, len(doc))))
        del key, order, ranked
        bucket = (first % np.uint64(buckets)).astype(np.int64)
        bucket[covered] = _bucket_of(doc[covered], tag[covered], buckets)
        rows = []
        for kind, chosen in ((0, ~covered), (1, covered)):
            rows += _dealt(bucket[chosen], [x[chosen] for x in (doc, tag, start, count)] + ([first[chosen], whole[chosen]] if kind == 0 else []), [5, 6] if kind == 0 else [], kind)
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bs.begin()
        parts, size = [], 0
        for batch in batches:
            docs, tags = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "tag"))
            for low, _, data, bounds in bs.pieces(batch.column("text")):
                row, start, count, first, whole = anchors(data, bounds, length)
                if len(row):
                    parts.append((docs[low + row], tags[low + row], start, count, first, whole))
                size += len(data)
                if size >= SORTED and parts:
                    yield settled(parts)
                    parts, size = [], 0
        if parts:
            yield settled(parts)
        del parts
        bs.give_back()

    return run


_PLACES = "key long, tag long, covered binary, open binary"


def _places(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray, open_: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row a document: its covered spans and its open ones, each as pairs of 32-bit start and end."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end, open_ = (x[order] for x in (doc, tag, start, end, open_))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    cut = np.append(np.flatnonzero(new), len(doc))
    spans = np.stack([start, end], 1).astype("<u4")
    binaries = []
    for chosen in (~open_, open_):
        before = np.concatenate([[0], np.cumsum(chosen)])[cut]
        data = spans[chosen].tobytes()
        binaries.append(pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer((before * 8).astype("<i8").tobytes()), pa.py_buffer(data)]).cast(pa.binary()))
    for low in range(0, len(cut) - 1, 20_000):
        part = slice(low, min(low + 20_000, len(cut) - 1))
        yield pa.RecordBatch.from_pydict({"key": pa.array(doc[cut[:-1]][part]), "tag": pa.array(tag[cut[:-1]][part]), "covered": binaries[0].slice(low, 20_000), "open": binaries[1].slice(low, 20_000)})


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple[int, bytes]]]:
    held: dict[int, list[tuple[int, bytes]]] = {}
    for batch in batches:
        for bucket, kind, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            held.setdefault(bucket, []).append((kind, payload))
    return held


def _joined(parts: list[tuple[np.ndarray, ...]], columns: int) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64 if i > 3 else np.int64) for i in range(columns)]


def _by_place(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, count: np.ndarray, open_: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Settled (kind 0) and open (kind 1) runs of windows, dealt by their document."""
    order = np.lexsort((start, tag, doc))
    pieces = [x[order] for x in (doc, tag, start, count)]
    chosen, rows = open_[order], []
    bucket = _bucket_of(pieces[0], pieces[1], buckets)
    for kind, mask in ((0, ~chosen), (1, chosen)):
        rows += _dealt(bucket[mask], [x[mask] for x in pieces], [], kind)
    return _batch(rows)


def _by_document(length: int):
    """All that the buckets found, one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _by_bucket(batches)
        for bucket in sorted(held):
            rows = held.pop(bucket)
            parts = [_joined([unpack(p) for kind, p in rows if kind == k], 4) for k in (0, 1)]
            doc, tag, start, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(doc):
                yield from _places(doc, tag, start, start + count - 1 + length, np.arange(len(doc)) >= len(parts[0][0]))
        bs.give_back()

    return run


def _second_digits(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _by_bucket(batches)
        for bucket in sorted(held):
            rows = held.pop(bucket)
            done = _joined([unpack(p) for kind, p in rows if kind == 1], 4)
            doc, tag, start, count, first, whole = _joined([unpack(p, 5, 6) for kind, p in rows if kind == 0], 6)
            if len(doc):
                order = np.lexsort((doc, whole, first))
                doc, tag, start, count, first, whole = (x[order] for x in (doc, tag, start, count, first, whole))
                new = np.ones(len(doc), bool)
                new[1:] = first[1:] != first[:-1]
                new_whole = new.copy()
                new_whole[1:] |= whole[1:] != whole[:-1]
                cut, cut_whole = np.flatnonzero(new), np.flatnonzero(new_whole)
                size, size_whole = np.diff(np.append(cut, len(doc))), np.diff(np.append(cut_whole, len(doc)))
                covered = doc > np.repeat(doc[cut_whole], size_whole)
                several = (np.minimum.reduceat(doc, cut) != np.maximum.reduceat(doc, cut)) & (np.add.reduceat(new_whole.astype(np.int64), cut) > 1)
                open_ = ~covered & np.repeat(several, size)
                kept = covered | open_
                doc, tag, start, count, open_ = (x[kept] for x in (doc, tag, start, count, open_))
            else:
                open_ = np.zeros(0, bool)
            doc, tag, start, count = (np.concatenate([a, b]) for a, b in zip((doc, tag, start, count), done, strict=True))
            open_ = np.concatenate([open_, np.zeros(len(done[0]), bool)])
            if len(doc):
                yield _by_place(doc, tag, start, count, open_, buckets)
        bs.give_back()

    return run


def _span_list(spans: bytes | None) -> np.ndarray:
    return np.frombuffer(spans or b"", "<u4").reshape(-1, 2).astype(np.int64)


def _last_digits(length: int, buckets: int):
    """All windows of open spans, dealt by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "tag"))
            spans = batch.column("open").to_pylist()
            for low, high, data, bounds in bs.pieces(batch.column("text")):
                row, first, count = [], [], []
                for k in range(low, high):
                    if spans[k]:
                        s = _span_list(spans[k])
                        s = s[np.argsort(s[:, 0])]
                        row.append(np.full(len(s), k))
                        first.append(s[:, 0])
                        count.append(s[:, 1] - s[:, 0] - length + 1)
                if row:
                    row, first, count = np.concatenate(row), np.concatenate(first), np.concatenate(count)
                    inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                    row, start = np.repeat(row, count), np.repeat(first, count) + inner
                    at = bounds[row - low] + start
                    h = bs.span_hash(data, at, at + length)
                    yield _batch(list(_dealt((h % np.uint64(buckets)).astype(np.int64), [docs[row], tags[row], start, np.ones(len(row), np.int64), h], [8], 0)))

    return run


def _equal_windows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _by_bucket(batches)
        for bucket in sorted(held):
            doc, tag, start, _, h = _joined([unpack(p, 8) for _, p in held.pop(bucket)], 5)
            order = np.lexsort((doc, h))
            doc, tag, start, h = (x[order] for x in (doc, tag, start, h))
            cut = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            covered = doc > np.repeat(doc[cut], np.diff(np.append(cut, len(doc))))
            if covered.any():
                doc, tag, start = doc[covered], tag[covered], start[covered]
                yield _by_place(doc, tag, start, np.ones(len(doc), np.int64), np.zeros(len(doc), bool), buckets)
        bs.give_back()

    return run


def _merged(kinds: list[bytes | None]) -> np.ndarray:
    """Maximal removed runs."""
    s = np.concatenate([_span_list(k) for k in kinds])
    if not len(s):
        return s
    s = s[np.argsort(s[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.append(True, s[1:, 0] > reach[:-1])
    return np.stack([s[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]], 1)


def _results(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(low, 500) for b in batches for low in range(0, b.num_rows, 500)):
            data, bounds = bs.flat(batch.column("text"))
            covered, more = batch.column("covered").to_pylist(), batch.column("more").to_pylist()
            spans, sizes, removed, digests, kept = [], np.diff(bounds), [], [], []
            for k in range(batch.num_rows):
                s = _merged([covered[k], more[k]])
                raw = data[bounds[k] : bounds[k + 1]].tobytes()
                if len(s):
                    cuts = [0, *s.ravel().tolist(), len(raw)]
                    raw = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                spans.append([{"start": a, "end": b} for a, b in s.tolist()])
                removed.append(int((s[:, 1] - s[:, 0]).sum()))
                digests.append(hashlib.sha256(raw).hexdigest())
                if "kept_text" in names:
                    kept.append(raw.decode("utf-8", "ignore"))
            made = {
                "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept_sha256": pa.array(digests, pa.string()), "kept_text": pa.array(kept, pa.string()),
            }
            yield pa.RecordBatch.from_pydict({n: made[n] if n in made else batch.column(n) for n in names})

    return run


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartitionById(buckets, F.col("bucket"))


def find_repeats(df: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("n_bytes", "n_removed", "spans", "kept_sha256", "kept_text")) -> DataFrame:
    """What each document loses to documents with a smaller id: struct `row` (the columns but the text) and `outputs`.

    A byte is removed if a string of `length` bytes that covers it also starts in a document with a smaller id.
    outputs: n_bytes, n_removed, spans (maximal removed runs, in bytes), kept_sha256 (of the remaining bytes),
    kept_text (the same as text; a character cut in two is dropped).  Null texts are empty; ids that are null
    rank last, and such rows take nothing from one another; rows that share an id are versions of one document and
    take nothing from each other.  Rows of one id are told apart by 64 bits of a hash of their text, and equal texts have
    one outcome: among a million rows without an id two different texts meet with a chance of 3e-8.  Texts shorter than `length` lose nothing; an empty table gives no rows.
    """
    spark = df.sparkSession
    size = df.select(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rest = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text))
    keyed = df.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LAST)).alias("key"), F.xxhash64(body).alias("tag"), body.alias("text"), rest.alias("row"))

    def collected(found: DataFrame) -> DataFrame:
        return _bucketed(found, buckets).mapInArrow(_by_document(length), _PLACES)

    first = keyed.select("key", "tag", "text").mapInArrow(_first_digits(length, buckets), _DEALT)
    places = written(collected(_bucketed(first, buckets).mapInArrow(_second_digits(buckets), _DEALT)), "repeats")
    placed = keyed.join(places, ["key", "tag"], "left")  # both uses below share one exchange of the texts
    windows = placed.select("key", "tag", "text", "row", "open").mapInArrow(_last_digits(length, buckets), _DEALT)
    more = collected(_bucketed(windows, buckets).mapInArrow(_equal_windows(buckets), _DEALT)).select("key", "tag", F.col("covered").alias("more"))
    final = placed.join(more, ["key", "tag"], "left").select("row", "text", "covered", "more")
    kinds = {"n_bytes": "long", "n_removed": "long", "spans": "array<struct<start:long,end:long>>", "kept_sha256": "string", "kept_text": "string"}
    schema = T.StructType([final.schema["row"], *(T.StructField(n, T._parse_datatype_string(kinds[n])) for n in outputs)])
    return final.mapInArrow(_results(["row", *outputs]), schema)


def remove_repeats(df: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df with the repeated bytes cut out of their texts."""
    found = find_repeats(df, length, doc_id, text, ("kept_text",))
    shown: list[Column] = [F.col("kept_text").alias(text) if c == text else F.col("row")[c].alias(c) for c in df.columns]
    return found.select(*shown)
