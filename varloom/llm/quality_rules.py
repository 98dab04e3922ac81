"""Quality rules: base limits, then robust multivariate outliers by language and source.

Each document becomes a vector of transformed statistics.  For each group the minimum-covariance-determinant
estimate is sought over all of its documents from three starts: medians and deviations, the covariance of the signs
(directions from the medians), and the plain mean and covariance.  A concentration step keeps the share `core` of
documents nearest to the centre and takes their mean and covariance, which lowers the determinant but for the
approximate quantiles and the least spreads.  After two steps each group goes on with the start of least determinant,
until no group's determinant falls any more.  Each language is estimated in the same way, and a group's estimate is drawn
toward its language's by the smooth weight n / (n + k), so no group is pooled and none stands on few documents.  A step
is two aggregations over the statistics table with partial sums, and the groups' parameters (a few rows each,
broadcast while few) meet the rows where they are, so a group of any size stays spread over the cluster.  The
covariance is scaled so that the group's median distance is that of a normal distribution.  A document is rejected
when its Mahalanobis distance passes a far quantile.  There each statistic's spread is at least its sampling error
in that text, so a short text is excused for what few words or lines scatter, and no more.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm import bytescan as bs
from varloom.llm.shared import discard, small, written

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = bs.byte_class((0x41, 0x5A))
_PUNCT = bs.byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)) & ~_SYMBOL
_NOT_CONTINUATION = ~bs.byte_class((0x80, 0xBF))
_NOT_NEWLINE = ~bs.byte_class((0x0A, 0x0A))

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_punct", "n_lines")

#: Transformed statistics and the least spread that each is given (ratios by the arc sine of their root).
FEATURES = {
    "word_length": ("ln(word_chars / n_words)", 0.05),
    "symbols": ("asin(sqrt(n_symbols / word_chars))", 0.04),
    "upper": ("asin(sqrt(n_upper / word_chars))", 0.05),
    "punct": ("asin(sqrt(n_punct / word_chars))", 0.05),
    "dup_lines": ("asin(sqrt(n_dup_lines / greatest(n_lines, 1)))", 0.10),
    "repeats": ("asin(sqrt(n_repeat_words / n_words))", 0.10),
}
DIMENSIONS = len(FEATURES)

#: Sampling variance of each feature in one text: 1 / (4 n) of an arc sine root, and for words' lengths, which scatter by
#: about half their mean.  Where it passes the squared least spread, it takes that one's place.
NOISE = ("n_words", "word_chars", "word_chars", "word_chars", "n_lines", "n_words")


def _sums(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many bytes (or items) of each row are true."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def text_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The STATISTICS of each text of a column."""
    out = {name: np.zeros(len(column), np.int64) for name in STATISTICS}
    for low, high, data, bounds in bs.pieces(column):
        rows = slice(low, high)
        kept = bs.NOT_SPACE[data]
        out["word_chars"][rows] = _sums(kept & _NOT_CONTINUATION[data], bounds)
        out["n_symbols"][rows] = _sums(_SYMBOL[data], bounds)
        out["n_upper"][rows] = _sums(_UPPER[data], bounds)
        out["n_punct"][rows] = _sums(_PUNCT[data], bounds)
        starts, ends = bs.runs(kept, bounds)
        at = np.searchsorted(starts, bounds)
        out["n_words"][rows] = np.diff(at)
        row = bs.row_of(at, len(starts)).astype(np.uint64)
        grams = bs.gram_hash(bs.span_hash(data, starts, ends), 3)
        inside = row[2:] == row[:-2]
        twice = np.zeros(len(starts) + 2, bool)
        if len(grams):
            # A window across texts gets a key of its own, so it repeats nothing.
            keys = np.where(inside, bs.mix(grams + row[2:] * np.uint64(0x9E3779B97F4A7C15)), np.arange(1, len(grams) + 1, dtype=np.uint64))
            twice[: len(grams)] = _repeated(keys) & inside
        cover = twice[:-2].copy()
        cover[1:] |= twice[:-3]
        cover[2:] |= twice[:-4]
        out["n_repeat_words"][rows] = _sums(cover, at)
        starts, ends = bs.runs(_NOT_NEWLINE[data], bounds)
        words_before = np.concatenate([[0], np.cumsum(kept)])
        real = words_before[ends] > words_before[starts]
        starts, ends = starts[real], ends[real]
        at = np.searchsorted(starts, bounds)
        row = bs.row_of(at, len(starts))
        keys = bs.mix(bs.span_hash(data, starts, ends) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first = np.unique(keys, return_index=True)
        out["n_lines"][rows] = np.diff(at)
        out["n_dup_lines"][rows] = np.diff(at) - np.bincount(row[first], minlength=high - low)
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bs.begin()
    for batch in batches:
        found = text_statistics(batch.column(0))
        rest = {n: batch.column(n) for n in batch.schema.names[1:]}
        yield pa.RecordBatch.from_pydict({**rest, **{n: pa.array(x) for n, x in found.items()}})


def _chi2_below(x: float, dims: int) -> float:
    """The chi-squared distribution with an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dims // 2))


def chi2_quantile(p: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2_below(middle, dims) < p else (low, middle)
    return high


#: Places of a symmetric matrix that are kept.
UPPER = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
#: Estimates that are followed at first: from medians and deviations, from signs, from means; and for how many steps.
STARTS, FOLLOWED = 3, 2


_PARAMS = "grp string, start int, det double, " + ", ".join([*(f"c{i} double" for i in range(DIMENSIONS)), *(f"p{i}_{j} double" for i, j in UPPER)])
_PARAM_NAMES = [x.split()[0] for x in _PARAMS.split(", ")]


def _distance() -> Column:
    """Squared Mahalanobis distance of x0, x1, ... from the parameters of the row's group."""
    d = [F.col(f"x{i}") - F.col(f"c{i}") for i in range(DIMENSIONS)]
    total = F.lit(0.0)
    for i, j in UPPER:
        total = total + d[i] * d[j] * F.col(f"p{i}_{j}") * (1 if i == j else 2)
    return total


def text_distance(x: np.ndarray, centre: np.ndarray, inverse: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances of rows x, with noise (variances) in place of the squared least spread where larger."""
    apart = x - centre
    more = np.maximum(0.0, noise - np.array([least**2 for _, least in FEATURES.values()]))
    wider = np.linalg.inv(inverse) + more[:, :, None] * np.eye(DIMENSIONS)
    return (apart * np.linalg.solve(wider, apart[:, :, None])[:, :, 0]).sum(1)


def _measured(limit: float, kept_columns: list[str]):
    """distance and kept of rows with x0, ..., the parameters of their group, and the STATISTICS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda n, batch=batch: batch.column(n).to_numpy(zero_copy_only=False).astype(float)
            x, centre = (np.stack([column(n.format(i)) for i in range(DIMENSIONS)], 1) for n in ("x{}", "c{}"))
            inverse = np.empty((batch.num_rows, DIMENSIONS, DIMENSIONS))
            for i, j in UPPER:
                inverse[:, i, j] = inverse[:, j, i] = column(f"p{i}_{j}")
            noise = np.stack([0.25 / np.maximum(column(n), 1) for n in NOISE], 1)
            distance = np.full(batch.num_rows, np.nan)
            known = np.isfinite(x).all(1) & np.isfinite(centre).all(1) & np.isfinite(inverse).all((1, 2))
            if known.any():
                distance[known] = text_distance(x[known], centre[known], inverse[known], noise[known])
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False).astype(bool)
            rest = {n: batch.column(n) for n in kept_columns}
            kept = ~failed & ~(distance > limit)
            yield pa.RecordBatch.from_pydict({**rest, "distance": pa.array(distance, mask=~known), "kept": pa.array(kept)})

    return run


def _moments(x: str, tag: str = "") -> list[Column]:
    """Count, sums and sums of products of points."""
    at = [F.col(f"{x}{i}") for i in range(DIMENSIONS)]
    return [F.count("*").alias(f"n{tag}"), *(F.sum(at[i]).alias(f"s{i}{tag}") for i in range(DIMENSIONS)), *(F.sum(at[i] * at[j]).alias(f"s{i}_{j}{tag}") for i, j in UPPER)]


def covariance(r: dict[str, float], tag: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from `_moments`."""
    n = max(r[f"n{tag}"], 1)
    mean, cov = np.array([r[f"s{i}{tag}"] for i in range(DIMENSIONS)], float) / n, np.zeros((DIMENSIONS, DIMENSIONS))
    for i, j in UPPER:
        cov[i, j] = cov[j, i] = r[f"s{i}_{j}{tag}"] / n - mean[i] * mean[j]
    return mean, cov


_FLOORS = np.diag([least**2 for _, least in FEATURES.values()])


def _parameters(centre: np.ndarray, cov: np.ndarray) -> list[float]:
    """Log determinant, centre and inverse of a covariance with its least spreads."""
    cov = cov + _FLOORS
    inverse = np.linalg.inv(cov)
    return [float(np.linalg.slogdet(cov)[1]), *centre, *(inverse[i, j] for i, j in UPPER)]


def _estimated(scale: float):
    """From the moments of what was kept to parameters."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                mean, cov = covariance(r)
                rows.append([r["grp"], r["start"], *_parameters(mean, cov * scale)])
            yield pd.DataFrame(rows, columns=_PARAM_NAMES)

    return run


def _started(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The starts of each group, from medians (c), deviations (m) and the moments of signs (_u) and of points."""
    for frame in frames:
        rows = []
        for r in frame.to_dict("records"):
            centre, spread = (np.array([r[f"{n}{i}"] for i in range(DIMENSIONS)], float) for n in "cm")
            spread = np.maximum(1.4826 * spread, 1e-9)
            signs = covariance(r, "_u")[1] * spread[:, None] * spread * DIMENSIONS  # signs are taken of spread-out points
            for k, found in enumerate(((centre, np.diag(spread**2)), (centre, signs), covariance(r))):
                rows.append([r["grp"], k, *_parameters(*found)])
        yield pd.DataFrame(rows, columns=_PARAM_NAMES)


def _first_params(points: DataFrame) -> DataFrame:
    """The starts of each group."""
    centre = written(points.groupBy("grp").agg(*(F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"c{i}") for i in range(DIMENSIONS))), "mcd")
    placed = points.join(small(centre), "grp")
    spread = placed.groupBy("grp").agg(*(F.first(f"c{i}").alias(f"c{i}") for i in range(DIMENSIONS)), *(F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"c{i}")), 0.5, 1000).alias(f"m{i}") for i in range(DIMENSIONS)))
    spread = written(spread, "mcd")
    x = [f"x{i}" for i in range(DIMENSIONS)]
    placed = points.join(small(spread), "grp").select("grp", *x, *(((F.col(f"x{i}") - F.col(f"c{i}")) / F.greatest(F.col(f"m{i}") * 1.4826, F.lit(1e-9))).alias(f"v{i}") for i in range(DIMENSIONS)))
    length = F.sqrt(sum((F.col(f"v{i}") * F.col(f"v{i}") for i in range(1, DIMENSIONS)), F.col("v0") * F.col("v0")))
    placed = placed.select("*", F.greatest(length, F.lit(1e-9)).alias("length")).select("grp", *x, *((F.col(f"v{i}") / F.col("length")).alias(f"u{i}") for i in range(DIMENSIONS)))
    moments = placed.groupBy("grp").agg(*_moments("u", "_u"), *_moments("x"))
    return written(moments.join(spread, "grp").mapInPandas(_started, _PARAMS), "mcd")


def fit_groups(points: DataFrame, core: float = 0.75, steps: int = 8, settled: float = 0.01) -> DataFrame:
    """grp, c0, ... and p0_0, ...: centre and inverse covariance of each group of points(grp, x0, x1, ...), of least determinant.

    All starts are followed for `FOLLOWED` steps, then each group's best one, for `steps` in all at most; they end before
    when no log determinant falls by more than `settled`.
    """
    edge = chi2_quantile(core, DIMENSIONS)
    scale = core / _chi2_below(edge, DIMENSIONS + 2)  # the core's covariance falls short of the whole's by this factor
    params, x = _first_params(points), [f"x{i}" for i in range(DIMENSIONS)]
    for step in range(steps):
        before, key = params, ["grp", "start"]
        placed = points.join(small(params), "grp").select(*key, *x, _distance().alias("d"))  # a row for each start that is followed
        limits = written(placed.groupBy(*key).agg(F.percentile_approx("d", core, 1000).alias("limit")), "mcd")
        near = placed.join(small(limits), key).where("d <= limit").groupBy(*key).agg(*_moments("x"))
        params = written(near.mapInPandas(_estimated(scale), _PARAMS), "mcd")
        discard(limits)
        if step + 1 == FOLLOWED:
            names = [n for n in _PARAM_NAMES if n != "grp"]
            params = written(params.groupBy("grp").agg(F.min_by(F.struct(*names), F.struct("det", "start")).alias("best")).select("grp", "best.*"), "mcd")
        elif step >= FOLLOWED:
            fell = params.join(before.select("grp", F.col("det").alias("was")), "grp").agg(F.max(F.col("was") - F.col("det"))).first()[0] or 0.0
            if fell <= settled:
                break
    middle = written(points.join(small(params), "grp").select("grp", _distance().alias("d")).groupBy("grp").agg(F.percentile_approx("d", 0.5, 1000).alias("middle")), "mcd")
    # A group whose points lie closer than the least spreads is not spread out further.
    widen = F.greatest(F.col("middle") / chi2_quantile(0.5, DIMENSIONS), F.lit(1.0))
    return written(params.join(small(middle), "grp").select("grp", *(f"c{i}" for i in range(DIMENSIONS)), *((F.col(f"p{i}_{j}") / widen).alias(f"p{i}_{j}") for i, j in UPPER)), "mcd")


_DRAWN = "grp string, " + ", ".join(f"c{i} double" for i in range(DIMENSIONS)) + ", " + ", ".join(f"p{i}_{j} double" for i, j in UPPER)


def _shape(r: dict[str, float], tag: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of parameters."""
    inverse = np.empty((DIMENSIONS, DIMENSIONS))
    for i, j in UPPER:
        inverse[i, j] = inverse[j, i] = r[f"{tag}p{i}_{j}"]
    return np.array([r[f"{tag}c{i}"] for i in range(DIMENSIONS)], float), np.linalg.inv(inverse)


def drawn(own: tuple[np.ndarray, np.ndarray], wider: tuple[np.ndarray, np.ndarray], n: int, k: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of a mixture: the share n / (n + k) of a group's own estimate, and the rest of a wider one."""
    share = n / (n + k)
    apart = own[0] - wider[0]
    return wider[0] + share * apart, share * own[1] + (1 - share) * wider[1] + share * (1 - share) * np.outer(apart, apart)


def _drawn(k: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                centre, cov = drawn(_shape(r), _shape(r, "w_"), r["n"], k)
                inverse = np.linalg.inv(cov)
                rows.append([r["grp"], *centre, *(inverse[i, j] for i, j in UPPER)])
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _DRAWN.split(", ")])

    return run


def judge(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
    least_words: int = 50, most_repeated: int = 50, prior: float = 50.0, tail: float = 1e-9, core: float = 0.75, steps: int = 8,
    carry: bool = False,
) -> DataFrame:
    """One row a document: doc_id, the STATISTICS, base_failed, distance (squared, null if base_failed), kept.

    base_failed: fewer than least_words words, or over most_repeated per cent of them in repeated three-word
    windows.  Others are compared with their (lang, source) group, whose estimate has the weight n / (n + prior) beside
    that of its language, n being the number of such documents in it.  A document is kept if its distance,
    with each statistic's sampling error in that text as its least spread, stays below the chi-squared quantile
    at 1 - tail.  Null and empty texts have no words and fail; null languages and sources are groups
    of their own; repeated rows are judged one by one; an empty table gives no rows.  carry: each row also brings
    its row of df, as the struct `row`, so that no join by id is needed.
    """
    given = df.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("\x02")).alias("lang"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("\x02")).alias("source"), *([F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")] if carry else []))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "text") + ", " + ", ".join(f"{n} long" for n in STATISTICS)
    found = written(given.mapInArrow(_statistics, schema), "statistics")
    found = found.withColumn("base_failed", F.expr(f"n_words < {least_words} OR 100 * n_repeat_words > {most_repeated} * n_words"))
    usable = found.where("NOT base_failed").select("doc_id", "lang", "source", "n_words", *(F.expr(f).alias(f"x{i}") for i, (f, _) in enumerate(FEATURES.values())))

    wide, own = F.concat(F.lit("l\x01"), "lang"), F.concat_ws("\x01", F.lit("g"), "lang", "source")
    names = written(usable.groupBy("lang", "source").agg(F.count("*").alias("n")).select("lang", "source", "n", own.alias("grp"), wide.alias("wide")), "groups")
    fitted = fit_groups(usable.select(F.explode(F.array(own, wide)).alias("grp"), *(f"x{i}" for i in range(DIMENSIONS))), core, steps)
    wider = fitted.select(F.col("grp").alias("wide"), *(F.col(c).alias(f"w_{c}") for c in fitted.columns if c != "grp"))
    # A row a group, joined with a row a language.
    params = written(names.select("grp", "wide", "n").join(fitted, "grp").join(small(wider), "wide").mapInPandas(_drawn(prior), _DRAWN), "mcd")

    limit = chi2_quantile(1 - tail, DIMENSIONS)
    named = found.join(small(names.select("lang", "source", "grp")), ["lang", "source"], "left").join(small(params), "grp", "left")
    for i, (f, _) in enumerate(FEATURES.values()):
        named = named.withColumn(f"x{i}", F.when(F.col("base_failed"), F.lit(None)).otherwise(F.expr(f)))
    names = ["doc_id", *(["row"] if carry else []), *STATISTICS, "base_failed"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.select(*names).schema) + ", distance double, kept boolean"
    return named.mapInArrow(_measured(limit, names), schema)
