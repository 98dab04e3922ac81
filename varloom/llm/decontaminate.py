"""Benchmark decontamination by an FM-index of each training shard.

A shard is a few megabytes of whole documents inside a task.  Its words become symbols of the benchmark's
vocabulary; documents, and words that no test phrase holds, end a segment.  The shard's suffix array gives
the Burrows-Wheeler transform, held in a wavelet matrix with rank counts; all test phrases are searched
backwards at once, their occurrences located by walking to sampled suffix positions, and the words that any
occurrence covers merged into removal spans.  Nothing is shuffled.  A benchmark larger than a block is taken in
blocks of bounded size, one after another: each is broadcast alone, and what it finds is written before the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm import bytescan as bs
from varloom.llm.shared import discard, written

#: Bytes of text in a shard (a longer document is scanned by itself) and of benchmark text in a block; symbols of an index, at most.
SHARD, BLOCK, SYMBOLS = 1 << 22, 1 << 24, 1 << 21
#: Each suffix position divisible by this is sampled, and each segment start.
SAMPLE = 8


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes of symbols below 2**bits; symbol 0 ends a suffix, and equal ones stand in text order.

    The text must end with 0.  Suffixes are ordered by packed runs of symbols, then groups that are still
    equal by the rank of what follows, doubling the depth each time.
    """
    n, depth = len(text), max(1, 62 // bits)
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(depth):
        symbol = np.zeros(n, np.int64)
        symbol[: max(0, n - k)] = text[k:]
        symbol[~open_] = 0
        open_ &= symbol > 0
        key = (key << bits) | symbol
    order = np.argsort(key, kind="stable")
    key, live = key[order], open_[order]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | ~live[1:]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    while True:
        last = np.ones(n, bool)
        last[:-1] = new[1:]
        rows = np.flatnonzero(~(new & last))
        if not len(rows):
            return order
        at = order[rows]
        follow = rank[at + depth]
        # The text's positions break ties of what has ended; groups stay where they are.
        again = np.lexsort((follow, rank[at]))
        order[rows] = at[again]
        group, follow = rank[at[again]], follow[again]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        new[rows] = fresh
        rank[at[again]] = np.maximum.accumulate(np.where(fresh, rows, 0))
        depth *= 2


class BitRank:
    """Bits with the number of ones before any position."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << inside) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    """Count and locate phrases of non-zero symbols in a text that ends with symbol 0."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        order = suffix_array(text, self.bits)
        last = text[order - 1].astype(np.int64)  # before position 0 stands the closing 0
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        sampled = (order % SAMPLE == 0) | (last == 0)
        self.sampled, self.positions = BitRank(sampled), order[sampled]
        self.levels: list[tuple[BitRank, int]] = []
        rest = last
        for level in range(self.bits - 1, -1, -1):
            ones = ((rest >> level) & 1).astype(bool)
            self.levels.append((BitRank(ones), int(len(ones) - ones.sum())))
            rest = np.concatenate([rest[~ones], rest[ones]])
        self.origin = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            right = ones.ones(at)
            at = np.where((symbol >> level) & 1 == 1, zeros + right, at - right)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the rows before `at` that `symbol` precedes end in the order of suffixes."""
        return self.smaller[symbol] + self._down(symbol, at) - self.origin[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows (low, high) of each phrase; phrases are rows of a matrix, filled from the left."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.smaller[-1])
        for k in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((lengths > k) & (low < high))
            symbol = phrases[live, k]
            low[live], high[live] = self.step(symbol, low[live]), self.step(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking back to a sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1)
        live = np.arange(len(rows))
        while len(live):
            hit = self.sampled.get(rows[live])
            done = live[hit]
            out[done] = self.positions[self.sampled.ones(rows[done])] + steps[done]
            live = live[~hit]
            at = rows[live]
            symbol, place = np.zeros(len(at), np.int64), at
            for level, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
                bit = ones.get(place)
                symbol |= bit.astype(np.int64) << level
                right = ones.ones(place)
                place = np.where(bit, zeros + right, place - right)
            rows[live] = self.smaller[symbol] + place - self.origin[symbol]
            steps[live] += 1
        return out


class Phrases:
    """The distinct windows of some items, as symbols of the items' vocabulary."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        column = pa.array([text for _, text in items], pa.large_string())
        self.items, self.window = [name for name, _ in items], window
        hashes, item_of = [], []
        for low, _, data, bounds in bs.pieces(column):
            data = bs.LOWER[data]
            starts, ends = bs.runs(bs.ALNUM_LOWER[data], bounds)
            h, at = bs.span_hash(data, starts, ends), np.searchsorted(starts, bounds)
            for k in range(len(bounds) - 1):
                words = h[at[k] : at[k + 1]]
                if len(words):
                    size = min(window, len(words))
                    rows = np.zeros((len(words) - size + 1, window), np.uint64)
                    rows[:, :size] = np.lib.stride_tricks.sliding_window_view(words, size)
                    hashes.append(rows)
                    item_of.append(np.full(len(rows), low + k))
        rows = np.concatenate([np.zeros((0, window), np.uint64), *hashes])
        self.vocabulary = np.unique(rows[rows > 0])
        unique, inverse = np.unique(rows, axis=0, return_inverse=True)
        self.lengths = (unique > 0).sum(1)
        self.symbols = np.where(unique > 0, np.searchsorted(self.vocabulary, unique) + 1, 0)
        owners = np.unique(np.stack([inverse.ravel(), np.concatenate([np.zeros(0, np.int64), *item_of])], 1), axis=0)
        self.owner_bounds, self.owners = np.searchsorted(owners[:, 0], np.arange(len(unique) + 1)), owners[:, 1]


def occurrences(index: FMIndex, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, text position) of every occurrence."""
    low, high = index.search(phrases.symbols, phrases.lengths)
    n = high - low
    rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return np.repeat(np.arange(len(n)), n), index.locate(rows)


def _shard(data: np.ndarray, bounds: np.ndarray, phrases: Phrases, table: bs.HashTable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and offsets by row of a shard's words, which words are hit, and the distinct (row, item) hits."""
    data = bs.LOWER[data]
    starts, ends = bs.runs(bs.ALNUM_LOWER[data], bounds)
    at, rows = np.searchsorted(starts, bounds), len(bounds) - 1
    hit = np.zeros(len(starts) + 1, np.int64)
    none = np.zeros(0, np.int64)
    if not len(starts) or not len(phrases.lengths):
        return starts, ends, at, hit[:-1] > 0, none, none
    symbol = table.find(bs.span_hash(data, starts, ends)).astype(np.int64) + 1
    text = np.zeros(len(starts) + rows, np.int64)
    origin = np.arange(len(starts)) + bs.row_of(at, len(starts))
    text[origin] = symbol
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 0) | (text[:-1] != 0)
    word = np.zeros(len(text), np.int64)
    word[origin] = np.arange(len(starts))
    text, word = text[keep], word[keep]
    if text[-1] != 0:
        text, word = np.append(text, 0), np.append(word, 0)
    found = []
    for low in range(0, len(text), SYMBOLS):  # a longer document is cut into overlapping parts; what is found twice counts once
        part = text[low : low + SYMBOLS + phrases.window - 1]
        part = part if part[-1] == 0 else np.append(part, 0)
        phrase, place = occurrences(FMIndex(part, len(phrases.vocabulary) + 1), phrases)
        found.append((phrase, word[low + place]))
    phrase, first = (np.concatenate(x) for x in zip(*found, strict=True))
    np.add.at(hit, first, 1)
    np.add.at(hit, first + phrases.lengths[phrase], -1)
    row = np.searchsorted(at, first, "right") - 1
    pairs = np.unique(row * len(phrases.lengths) + phrase)
    row, phrase = pairs // len(phrases.lengths), pairs % len(phrases.lengths)
    n = phrases.owner_bounds[phrase + 1] - phrases.owner_bounds[phrase]
    owner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(phrases.owner_bounds[phrase], n)
    pairs = np.unique(np.repeat(row, n) * len(phrases.items) + phrases.owners[owner])
    return starts, ends, at, np.cumsum(hit[:-1]) > 0, pairs // len(phrases.items), pairs % len(phrases.items)


HITS = "n_words long, words array<struct<first:long,last:long>>, spans array<struct<start:long,end:long>>, items array<string>"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(column: pa.Array, hits: list[dict]) -> pa.Array:
    """The texts without the spans of their hits; only texts that lose some are taken out of the column."""
    mask, new = np.zeros(len(column), bool), []
    for k, x in enumerate(hits):
        if x["spans"]:
            raw, parts, at = column[k].as_py().encode(), [], 0
            for s in x["spans"]:
                parts.append(raw[at : s["start"]])
                at = s["end"]
            mask[k] = True
            new.append(b"".join([*parts, raw[at:]]).decode("utf-8", "ignore"))
    return pc.replace_with_mask(column, mask, pa.array(new, column.type)) if new else column


def _search(shipped, text: str, into: str, kind: pa.DataType, cut: bool):
    """Adds the hits of one block of phrases to those that earlier blocks found.  cut: no block follows, and the spans of all hits go
    from the texts here, as a step of its own would be one more worker for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bs.begin()
        phrases: Phrases = shipped.value
        table = bs.HashTable(max(10, int(2 * len(phrases.vocabulary) + 2).bit_length()))
        if len(phrases.vocabulary):
            table.add(phrases.vocabulary)
        for batch in batches:
            found = [dict(x, words=[(w["first"], w["last"]) for w in x["words"]]) if x else {"n_words": 0, "words": [], "items": []} for x in batch.column(into).to_pylist()]
            lines: list[list[tuple[int, int]]] = [[] for _ in found]
            for low, high, data, bounds in bs.pieces(batch.column(text), SHARD):
                starts, ends, at, hit, row, item = _shard(data, bounds, phrases, table)
                for k, n in enumerate(np.diff(at).tolist(), low):
                    found[k]["n_words"] = n
                for k, i in zip((row + low).tolist(), item.tolist(), strict=True):
                    found[k]["items"].append(phrases.items[i])
                begin, end = bs.runs(hit, at)
                for k, a, b in zip((np.searchsorted(at, begin, "right") - 1 + low).tolist(), begin.tolist(), end.tolist(), strict=True):
                    base = int(at[k - low])
                    found[k]["words"].append((a - base, b - base))
                for k in {k for k in range(low, high) if found[k]["words"]}:
                    base, zero = int(at[k - low]), int(bounds[k - low])
                    found[k]["words"] = _merged(found[k]["words"])
                    lines[k] = [(int(starts[base + a]) - zero, int(ends[base + b - 1]) - zero) for a, b in found[k]["words"]]
            hits = [
                {"n_words": x["n_words"], "words": [{"first": a, "last": b} for a, b in x["words"]], "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(set(x["items"]))}
                for x, spans in zip(found, lines, strict=True)
            ]
            made = {into: pa.array(hits, kind), **({text: _cut(batch.column(text), hits)} if cut else {})}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return run


_HITS_ARROW = pa.struct(
    [
        ("n_words", pa.int64()), ("words", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())),
    ]
)


def find_phrases(df: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "hits") -> DataFrame:
    """The rows of df and a column `into`: n_words, words (runs of hit words, first to before last), spans (the
    same in bytes of the text) and items (ids, as strings, whose windows occur).

    Words are lower-cased (ASCII) runs of digits, letters and non-ASCII characters.  A window is `window`
    consecutive words of an item; an item of fewer words is one window, one without words none.  Null texts
    have no words; an item without an id counts under the empty string; items that share an id are one; a
    column that is already called `into` is replaced; with an empty benchmark nothing is hit; an empty table stays
    empty.  A text of any length is searched whole, in overlapping parts.
    """
    return _found(df, benchmark, window, text, item_id, item_text, into, cut=False)


def _found(df: DataFrame, benchmark: DataFrame, window: int, text: str, item_id: str, item_text: str, into: str, cut: bool) -> DataFrame:
    spark = df.sparkSession
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK))
    items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    out = df.withColumn(into, F.lit(None).cast(T._parse_datatype_string(HITS)))
    schema, before = out.schema, None
    for block in range(blocks):
        rows = items.where(F.col("block") == block).select("item", "text").distinct().collect()  # about BLOCK bytes
        shipped = spark.sparkContext.broadcast(Phrases(sorted((r.item, r.text) for r in rows), window))
        out = out.mapInArrow(_search(shipped, text, into, _HITS_ARROW, cut and block == blocks - 1), schema)
        if block < blocks - 1:
            earlier, out = before, written(out, "hits")
            before = out
            shipped.destroy()
            if earlier is not None:
                discard(earlier)
    return out


def remove_phrases(df: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of df with the spans of all hits cut out of their texts; other texts are untouched, null ones too.

    Rows are taken one by one, so repeated rows and null or repeated ids change nothing; all columns stay.
    """
    into = "hits"
    while into in df.columns:
        into += "_"
    return _found(df, benchmark, window, text, item_id, item_text, into, cut=True).drop(into)
