"""Quality by a byte-level convolutional network, in numpy.

A text is cut into overlapping chunks of bytes that cover all of it.  In each chunk, every window of `WIDTH`
bytes (one each `STRIDE` bytes) is looked up byte by byte in an embedding and passed to learned filters; the
filters' rectified outputs are pooled over the chunk (maximum and mean) and combined into the chunk's logit.  The
mean, largest and smallest logits of a text's chunks and its length combine into one probability.

The network is fitted on the driver from a sample whose bytes are bounded; scoring runs inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm import bytescan as bs

#: Bytes of a chunk, bytes from one chunk's start to the next, bytes under a filter and between its places.
CHUNK, STEP, WIDTH, STRIDE = 512, 448, 8, 4
EMBEDDING, FILTERS = 8, 24
#: Chunks that pass the network at once.
BATCH = 256
#: Bytes of text that are cut into chunks at once.
PORTION = 1 << 21

_PLACES = np.arange(0, CHUNK - WIDTH + 1, STRIDE)[:, None] + np.arange(WIDTH)


def chunked(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each chunk, chunk bytes as a matrix, filled up with zero bytes) of a text column, in bounded portions."""
    for low, _, data, bounds in bs.pieces(column, PORTION):
        size = np.diff(bounds)
        count = np.maximum(1, -(-np.maximum(size - (CHUNK - STEP), 1) // STEP))
        row = np.repeat(np.arange(len(size)), count)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * STEP
        padded = np.concatenate([data, np.zeros(CHUNK, np.uint8)])
        for k in range(0, len(row), BATCH):
            r, s = row[k : k + BATCH], start[k : k + BATCH]
            at = (bounds[r] + s)[:, None] + np.arange(CHUNK)
            chunk = padded[at]
            chunk[at >= bounds[r + 1][:, None]] = 0
            yield r + low, chunk


@dataclass
class Network:
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    combine: np.ndarray

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        return self.embedding[chunks[:, _PLACES]].reshape(len(chunks) * len(_PLACES), WIDTH * EMBEDDING)

    def logits(self, chunks: np.ndarray) -> np.ndarray:
        """One logit a chunk.  The embedding of a byte times its part of the filters is a table, so a place is a sum of look-ups."""
        out = np.maximum(self.windows(chunks) @ self.filters + self.bias, 0).reshape(len(chunks), len(_PLACES), FILTERS)
        return np.concatenate([out.max(1), out.mean(1)], 1) @ self.weights + self.offset[0]

    def documents(self, column: pa.Array) -> np.ndarray:
        """Features of each text: 1, mean, largest and smallest logit, log of length."""
        rows, logits = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for row, chunk in chunked(column):
            rows.append(row)
            logits.append(self.logits(chunk))
        row, logit = np.concatenate(rows), np.concatenate(logits).astype(float)
        n = len(column)
        high, low = np.full(n, -np.inf), np.full(n, np.inf)
        np.maximum.at(high, row, logit)
        np.minimum.at(low, row, logit)
        mean = np.bincount(row, logit, n) / np.maximum(np.bincount(row, minlength=n), 1)
        size = np.diff(bs.flat(column)[1])
        return np.clip(np.stack([np.ones(n), mean, high, low, np.log1p(size) / 4], 1), -30, 30)

    def probability(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.documents(column) @ self.combine, -30, 30)))


def _start(seed: int) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    zeros = lambda n: np.zeros(n, np.float32)
    return Network(
        draw(256, EMBEDDING, scale=0.5), draw(WIDTH * EMBEDDING, FILTERS, scale=(2 / (WIDTH * EMBEDDING)) ** 0.5), zeros(FILTERS),
        draw(2 * FILTERS, scale=0.2), zeros(1), np.array([0, 1, 0, 0, 0], float),
    )


def _gradients(net: Network, chunks: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    n, places = len(chunks), len(_PLACES)
    x = net.windows(chunks)
    out = np.maximum(x @ net.filters + net.bias, 0).reshape(n, places, FILTERS)
    top = out.argmax(1)
    pooled = np.concatenate([np.take_along_axis(out, top[:, None], 1)[:, 0], out.mean(1)], 1)
    error = (weight * (1 / (1 + np.exp(-np.clip(pooled @ net.weights + net.offset[0], -30, 30))) - y) / n).astype(np.float32)
    back = error[:, None] * net.weights
    d = np.broadcast_to(back[:, None, FILTERS:] / places, out.shape).copy()
    np.put_along_axis(d, top[:, None], np.take_along_axis(d, top[:, None], 1) + back[:, None, :FILTERS], 1)
    d = (d * (out > 0)).reshape(n * places, FILTERS)
    # Only the strongest places move the embedding: the pooled maxima carry nearly all of its gradient.
    places_of = chunks[np.arange(n)[:, None, None], _PLACES[top]]
    sent = (back[:, :FILTERS] * (np.take_along_axis(out, top[:, None], 1)[:, 0] > 0)).T[:, :, None] * net.filters.T[:, None, :]
    embedding = np.zeros_like(net.embedding)
    np.add.at(embedding, places_of.transpose(1, 0, 2), sent.reshape(FILTERS, n, WIDTH, EMBEDDING))
    return [embedding, x.T @ d, d.sum(0), pooled.T @ error, error.sum(keepdims=True)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
    return b


def fit(texts: list[str], labels: list[int], chunks: int = 9000, passes: int = 3, least_steps: int = 300, rate: float = 0.004, seed: int = 7) -> Network:
    """A network from labelled texts: `passes` (or as many as make `least_steps`) over at most `chunks` of their chunks, drawn at random, with Adam's steps."""
    net, rng = _start(seed), np.random.default_rng(seed)
    column, y = pa.array(texts, pa.large_string()), np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.combine = np.array([4.0 if len(y) and y[0] else -4.0 if len(y) else 0.0, 0, 0, 0, 0])
        return net
    parts = [(row, chunk) for row, chunk in chunked(column)]
    row, data = np.concatenate([r for r, _ in parts]), np.concatenate([c for _, c in parts])
    # Each text counts alike, however long, and each label as much as the other.
    share = 1 / np.bincount(row)[row] / np.bincount(y.astype(int))[y.astype(int)][row]
    drawn = rng.choice(len(row), min(chunks, len(row)), p=share / share.sum())
    moments = [[np.zeros_like(p, np.float32) for p in (net.embedding, net.filters, net.bias, net.weights, net.offset)] for _ in range(2)]
    each = -(-len(drawn) // 64)
    passes = max(passes, -(-least_steps // each))
    step, total = 0, passes * each
    for _ in range(passes):
        rng.shuffle(drawn)
        for k in range(0, len(drawn), 64):
            at, step = drawn[k : k + 64], step + 1
            pace = rate * (1 - 0.9 * step / total)
            for p, g, a, b in zip((net.embedding, net.filters, net.bias, net.weights, net.offset), _gradients(net, data[at], y[row[at]], np.ones(len(at), np.float32)), *moments, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    net.combine = _logistic(net.documents(column), y.astype(float))
    return net


def learn(sample: DataFrame, bytes_: int = 12 << 20, **options: int) -> Network:
    """Fit on labelled rows (doc_id, text, label) of at most `bytes_` of text, whole texts only; no more reaches the driver.

    Rows are taken by a hash of their id.  Texts of over a sixteenth of `bytes_` come after all others, and those that
    do not fit are passed over, so a few very long texts never take the place of the rest.
    """
    from pyspark.sql import Window

    sized = sample.withColumn("size", F.octet_length("text")).where(F.col("size") <= bytes_)
    order = (F.col("size") > bytes_ // 16, F.xxhash64("doc_id"), "doc_id", "label")
    # The running sum is over the ids and sizes of a bounded sample.
    sums = sized.select("doc_id", "label", "size").withColumn("until", F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    kept = sums.where(F.col("until") <= bytes_).select("doc_id").distinct()
    rows = sized.join(kept, "doc_id", "left_semi").select("doc_id", "text", "label").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.text))
    return fit([r.text for r in rows], [r.label for r in rows], **options)


def score(df: DataFrame, net: Network, text: str = "text", into: str = "quality") -> DataFrame:
    """The rows of df and a column `into`, the probability of label 1 (a column already so called is replaced).

    Null and empty texts are one chunk without bytes and get that chunk's score; repeated rows get equal scores;
    an empty table stays empty.
    """
    shipped = df.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shipped.value.probability(pa.array(texts, pa.large_string(), from_pandas=True)))

    return df.withColumn(into, scored(F.col(f"`{text}`").cast("string")))
