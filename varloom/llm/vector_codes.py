"""Product codes of vectors, with partial-distance search of the nearest codebook entries.

Components become integers, so distances are exact.  A vector is cut into equal parts, and each part position has a
codebook.  The search takes the dimensions of a part in descending order of the codebook's variance: the first one
gives every entry a partial distance and the entry with the least of them a complete one, and from then on a mask drops
the pairs of part and entry whose partial distance strictly exceeds the best complete distance.  Pairs that tie stay,
so the lowest entry of a tie is found.

Codebooks have a fixed size (`entries` times the vector's length) whatever the table holds; they go to the tasks, and
each task sends back one count and sum an entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.shared import small, written

#: A component of the vector times this is floored.
SCALE = 256
#: Integer components beyond this (vector components beyond 65536) could overflow sums of squares.
LARGEST = 1 << 24
#: Vectors that are searched at once.
SLICE = 4096


def integers(flat: np.ndarray) -> np.ndarray:
    """floor(256 * x) of finite components."""
    scaled = np.floor(np.asarray(flat, np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} cannot be coded")
    return scaled.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry (lowest on ties) of each row of x, and its squared distance."""
    order = np.argsort(-book.var(0), kind="stable")
    x, book = x[:, order], book[:, order]
    first = (x[:, :1] - book[:, 0]) ** 2
    guess = first.argmin(1)
    best = ((x - book[guess]) ** 2).sum(1)
    row, entry = np.nonzero(first <= best[:, None])
    partial = first[row, entry]
    half = x.shape[1] // 2
    for d in range(1, x.shape[1]):
        if d == half:  # the pair that is nearest so far has perhaps a better complete distance
            head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            low = np.minimum.reduceat(partial, head)
            at = np.flatnonzero(partial == low[row])
            guess[row[at]] = entry[at]
            best = np.minimum(best, ((x - book[guess]) ** 2).sum(1))
            kept = partial <= best[row]
            row, entry, partial = row[kept], entry[kept], partial[kept]
        partial = partial + (x[row, d] - book[entry, d]) ** 2
        kept = partial <= best[row]
        row, entry, partial = row[kept], entry[kept], partial[kept]
    head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))  # every row still has its best pair
    least = np.minimum.reduceat(partial, head)
    tied = np.flatnonzero(partial == least[row])
    tied = tied[np.append(True, row[tied][1:] != row[tied][:-1])]
    return entry[tied], least


def _search(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and distances (vectors by parts) of vectors x, by codebooks (parts, entries, components)."""
    parts, width = books.shape[0], books.shape[2]
    entry, error = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    for low in range(0, len(x), SLICE):
        for p in range(parts):
            entry[low : low + SLICE, p], error[low : low + SLICE, p] = nearest(x[low : low + SLICE, p * width : (p + 1) * width], books[p])
    return entry, error


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return integers(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, length)


def _sums(books: np.ndarray):
    """Counts and component sums of each entry over a task's vectors."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), parts * width)
            entry, _ = _search(x, books)
            for p in range(parts):
                count[p] += np.bincount(entry[:, p], minlength=entries)
                np.add.at(total[p], entry[:, p], x[:, p * width : (p + 1) * width])
        part, used = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({"part": pa.array(part.astype(np.int32)), "entry": pa.array(used.astype(np.int32)), "n": pa.array(count[part, used]), "total": pa.array(list(total[part, used]), pa.list_(pa.int64()))})

    return run


def _codes(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, error = _search(_matrix(batch.column(2), parts * width), books)
            digits = entry.astype(np.uint8).tobytes().hex()
            code = [digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "label": batch.column(1), "code": pa.array(code, pa.string()), "error": pa.array(error.sum(1))})

    return run


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and x of the rows whose vector is there, is not empty and holds finite components only."""
    x = F.col(f"`{embedding}`").cast("array<double>")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    found = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), x.alias("x"))
    return found.where(F.col("x").isNotNull() & (F.size("x") > 0) & ~F.coalesce(bad, F.lit(True)))


def start_books(vectors: DataFrame, parts: int = 16, entries: int = 64) -> np.ndarray | None:
    """The first codebooks (parts, entries, components): the parts of the `entries` smallest ids; None without vectors.

    Equal ids are ordered by their vectors, rows without an id come last; with fewer rows the books have fewer entries.
    """
    first = vectors.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()  # `entries` rows
    if not first:
        return None
    length = len(first[0]["x"])
    if length % parts or any(len(r["x"]) != length for r in first):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    return integers(np.array([r["x"] for r in first])).reshape(len(first), parts, length // parts).transpose(1, 0, 2).copy()


def train(vectors: DataFrame, books: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Each round replaces every used entry by the floored mean of the parts that are nearest to it."""
    for _ in range(rounds):
        sums = vectors.select("x").mapInArrow(_sums(books), "part int, entry int, n long, total array<long>")
        found = sums.select("part", "entry", "n", F.posexplode("total").alias("at", "value")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
        books = books.copy()
        for r in found.collect():  # one row a component of the codebooks
            books[r["part"], r["entry"], r["at"]] = r["value"] // r["n"]
    return books


def digest(books: np.ndarray) -> str:
    """sha256 of all components by part, entry and position, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits an entry, in order of parts) and error (summed squared distances)."""
    schema = f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, code string, error long"
    return vectors.select("vec_id", "label", "x").mapInArrow(_codes(books), schema)


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id and the integer vector that each code stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), np.uint8).reshape(batch.num_rows, -1)
            x = books[np.arange(books.shape[0]), entry].reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "x": pa.array(list(x), pa.list_(pa.int64()))})

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, x array<long>")


def by_label(codes: DataFrame) -> DataFrame:
    """The codes with label_error, the errors summed over rows of the same label, rows without one together.

    Errors are summed in the tasks first, so a label that holds most rows is one row a task; the sums are broadcast
    while they are few, and otherwise joined by a shuffle whose large partitions Spark splits.
    """
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = small(written(sums.select(F.col("label").alias("_label"), "label_error"), "labels"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def compress(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row with a usable vector.

    Rows with a null or empty vector, or one with null or non-finite components, are dropped.  Rows that share an id
    are coded one by one, as are rows without an id.  Vectors of unequal lengths, of a length that `parts` does not
    divide, or with components beyond 65536 raise.  An empty table gives no rows.
    """
    spark = df.sparkSession
    vectors = usable(df, vec_id, embedding, label)
    books = start_books(vectors, parts, entries)
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if books is None:
        return spark.createDataFrame([], schema)
    books = train(vectors, books, rounds)
    codes = by_label(written(encode(vectors, books), "codes"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
