"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts, accented, full-width, mathematical and
small-capital letters to plain ones, combining marks and invisible characters away, digits and signs that stand for letters to those letters, all other ASCII marks to blanks.  The lexicon is
learned from labelled texts: whole words and word beginnings that toxic texts hold far more often than others,
each with its log odds as weight; and exception phrases, words or word pairs that begin like an entry but are
found in clean texts only.  An exception that covers a match takes it away.  The weights that are left,
normalised by the text's length, make the score.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm import bytescan as bs
from varloom.llm.shared import written

#: Letters of other scripts that look like Latin ones, and digits and signs used for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ł": "l", "ø": "o", "đ": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
}


def _accents() -> dict[str, str]:
    """Accented Latin letters to their base, by Unicode's decomposition."""
    out = {}
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base.isascii() and base.isalpha() and chr(code) not in LOOKALIKES:
            out[chr(code)] = base.lower()
    return out


_FOLD = LOOKALIKES | _accents()


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte: the folded byte.  By code point below 2048: the folded ASCII byte (0: none) and the lower-cased code point."""
    plain = np.full(256, 32, np.uint8)
    for code in range(128):
        low = chr(code).lower()
        plain[code] = ord(_FOLD.get(low, low if low.isalnum() else " "))
    plain[128:] = np.arange(128, 256)
    ascii_, lower = np.zeros(2048, np.uint8), np.arange(2048)
    for code in range(128, 2048):
        low = chr(code).lower()
        low = low if len(low) == 1 and 128 <= ord(low) < 2048 else chr(code)
        ascii_[code], lower[code] = ord(_FOLD.get(low, "\0")), ord(low)
    ascii_[0xA0:0xC0] = 32
    return plain, ascii_, lower


_PLAIN, _ASCII, _LOWER = _tables()
_LETTER = bs.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def fold_bytes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes of texts and their new offsets; words stay apart by one blank or more."""
    out, keep = _PLAIN[data], np.ones(len(data), bool)
    following = np.append(data[1:], 32).astype(np.uint8)
    following[bounds[1:][bounds[1:] > 0] - 1] = 32
    out[(data == 0x21) & ~_LETTER[following]] = 32  # a mark at a word's end is no letter
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    if len(lead):
        code = (data[lead].astype(np.int64) & 31) << 6 | (data[lead + 1] & 63)
        letter = _ASCII[code] > 0
        out[lead[letter]] = _ASCII[code[letter]]
        keep[lead[letter] + 1] = False
        rest, low = lead[~letter], _LOWER[code[~letter]]
        out[rest], out[rest + 1] = 0xC0 | (low >> 6), 0x80 | (low & 63)
    quotes = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80)) if len(data) > 2 else np.zeros(0, np.int64)
    out[quotes] = 32  # dashes, quotation marks and the like
    keep[quotes + 1] = keep[quotes + 2] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[bounds]


def _capital(code: int) -> str | None:
    """The letter of a small capital."""
    name = unicodedata.name(chr(code), "")
    return name[-1].lower() if name.startswith("LATIN LETTER SMALL CAPITAL ") and name[-2] == " " else None


#: Small capitals, by the names of the characters.
_CAPITALS = {code: letter for code in (*range(0x250, 0x2B0), *range(0x1D00, 0x1D80)) if (letter := _capital(code))}


class _Plain(dict):
    """The plain form of a character, found when it is first met; Latin, Greek and Cyrillic letters stay as they are."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if code in _CAPITALS:
            char = _CAPITALS[code]
        elif code >= 0x800 or 0x300 <= code < 0x370 or code == 0xAD:
            char = "".join(c for c in unicodedata.normalize("NFKD", char) if unicodedata.category(c) not in ("Mn", "Cf"))
        self[code] = char
        return char


_PLAIN_FORM = _Plain()


def plain_form(text: str) -> str:
    """Full-width, mathematical and circled letters as plain ones, small capitals too; combining marks and invisible characters go."""
    return text.translate(_PLAIN_FORM)


def _unusual(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows with a character that `plain_form` may change and `fold_bytes` does not see."""
    first, second, third = (np.append(data[k:], np.zeros(min(k, len(data)), np.uint8)) for k in range(3))
    marks = (first == 0xCC) | (first == 0xCD) | ((first == 0xC2) & (second == 0xAD)) | (first == 0xC9) | (first == 0xCA) | (first == 0xE1) | (first == 0xEF) | (first == 0xF0)
    marks |= (first == 0xE2) & ((second != 0x80) | ((third >= 0x8B) & (third <= 0x8F)))
    return np.unique(np.searchsorted(bounds, np.flatnonzero(marks), "right") - 1)


def folded_texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, folded bytes, offsets) of the segments of a text column."""
    for low, _, data, bounds in bs.pieces(column):
        rows = _unusual(data, bounds)
        if len(rows):
            raw = [data[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            for k in rows.tolist():
                raw[k] = plain_form(raw[k].decode("utf-8", "replace")).encode("utf-8", "replace")
            data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        yield (low, *fold_bytes(data, bounds))


def _strings(data: np.ndarray, bounds: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [" " + raw[a:b].decode("utf-8", "replace") + " " for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


@dataclass
class Lexicon:
    """Entries (" word " or " beginning") with weights, exceptions, and the curve from weights to a score."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (-4.0, 1.0, 1.0, 4.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found


def weigh(text: str, automaton) -> tuple[float, float]:
    """The sum of weights in a folded text and the strongest: of entries at one place the longest counts, unless an exception covers it."""
    if not len(automaton):
        return 0.0, 0.0
    best: dict[int, tuple[int, float]] = {}
    free: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(text):
        start = end - length + 1
        if weight is None:
            free.append((start, end))
        elif start not in best or best[start][0] < length:
            best[start] = (length, weight)
    if free:  # an exception covers a place if, of those that start there or before, one ends behind it
        free.sort()
        starts, reach = [a for a, _ in free], list(accumulate((b for _, b in free), max))
        best = {start: x for start, x in best.items() if not (k := bisect_right(starts, start)) or reach[k - 1] <= start}
    left = [weight for _, weight in best.values()]
    return sum(left), max(left, default=0.0)


def _features(total: np.ndarray, strongest: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Columns: one, the weights, the weights by a hundred words, the strongest weight."""
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / np.maximum(words, 1)), strongest], 1)


def _measured(column: pa.Array, automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of weights, strongest weight and number of words of each text."""
    total, strongest, words = (np.zeros(len(column)) for _ in range(3))
    for low, data, bounds in folded_texts(column):
        starts, _ = bs.runs(data != 32, bounds)
        words[low : low + len(bounds) - 1] = np.diff(np.searchsorted(starts, bounds))
        for k, text in enumerate(_strings(data, bounds), low):
            total[k], strongest[k] = weigh(text, automaton)
    return total, strongest, words


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded texts with the least hash of their word pairs."""
    for batch in batches:
        for low, data, bounds in folded_texts(batch.column("text")):
            starts, ends = bs.runs(data != 32, bounds)
            h, at = bs.span_hash(data, starts, ends), np.searchsorted(starts, bounds)
            sketch = [int(bs.gram_hash(h[a:b], 2).min() >> np.uint64(1)) if b - a > 1 else int(h[a] >> np.uint64(1)) if b > a else 0 for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            part = batch.slice(low, len(sketch))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "label": part.column("label"), "folded": pa.array(_strings(data, bounds), pa.string()), "sketch": pa.array(sketch, pa.int64())})


@lru_cache(maxsize=2)
def _automaton_of(lexicon: tuple):
    """Built once a worker for each lexicon."""
    return Lexicon(dict(lexicon[0]), list(lexicon[1])).automaton()


def _weighed(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shipped.value.automaton()
        for batch in batches:
            total, strongest, words = _measured(batch.column("folded"), automaton)
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "total": pa.array(total), "strongest": pa.array(strongest), "words": pa.array(words)})

    return run


def _fitted(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton's steps."""
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (y - p) - ridge * b
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), gradient)
    return b


def _counted_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean texts of a batch each word and word beginning stands."""
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(text.split())
            forms = {f" {w} " for w in words}
            for n in range(4, 9):
                forms.update(f" {w[:n]}" for w in words if len(w) > n)
            counts[label].update(forms)
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "t": pa.array([counts[1][x] for x in terms], pa.int64()), "c": pa.array([counts[0][x] for x in terms], pa.int64())})


def _matched_phrases(terms: list[str]):
    """The words and word pairs of texts in which an entry matches: toxic texts and texts that hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Lexicon(dict.fromkeys(terms, 1.0)).automaton()
        for batch in batches:
            toxic, every = Counter(), Counter()
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = set()
                for end, (length, _) in automaton.iter(text) if len(automaton) else ():
                    start = end - length + 1
                    low, high = text.rfind(" ", 0, start), text.find(" ", start + 1)
                    after = text.find(" ", high + 1)
                    found.add(text[start : high + 1])
                    if low >= 0:
                        found.add(text[low : high + 1])
                    if after > 0:
                        found.add(text[start : after + 1])
                every.update(found)
                if label:
                    toxic.update(found)
            phrases = [x for x in every if x.strip()]
            yield pa.RecordBatch.from_pydict({"phrase": pa.array(phrases, pa.string()), "t": pa.array([toxic[x] for x in phrases], pa.int64()), "n": pa.array([every[x] for x in phrases], pa.int64())})

    return run


def _entries(rows: DataFrame, totals: dict[int, int], entries: int, least: int, odds: float, surety: float) -> dict[str, float]:
    """Words and word beginnings with their log odds, the surest first.

    An entry's odds times the root of its toxic texts must reach `surety`: words of a few texts need long odds.
    """
    counts = rows.select("label", "folded").mapInArrow(_counted_forms, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    weight = F.log((F.col("t") + 0.5) / (totals[1] + 1.0)) - F.log((F.col("c") + 0.5) / (totals[0] + 1.0))
    ranked = counts.where(F.col("t") >= least).withColumn("weight", weight).withColumn("sure", F.col("weight") * F.sqrt("t"))
    ranked = ranked.where((F.col("weight") >= odds) & (F.col("sure") >= surety)).orderBy(F.desc("sure"), "term").limit(4 * entries).collect()
    terms: dict[str, float] = {}
    for r in sorted(ranked, key=lambda r: (len(r.term), r.term)):  # a longer form adds nothing to a beginning that says as much
        shorter = [terms[r.term[:k]] for k in range(4, len(r.term)) if r.term[:k] in terms]
        if not shorter or max(shorter) < r.weight - 1.0:
            terms[r.term] = float(r.weight)
    sure = {r.term: r.sure for r in ranked}
    return dict(sorted(terms.items(), key=lambda x: (-sure[x[0]], x[0]))[:entries])


def _exceptions(rows: DataFrame, terms: dict[str, float], most: int) -> list[str]:
    """Words and word pairs of clean texts, never of toxic ones, in which an entry matches."""
    spoken = rows.select("label", "folded").mapInArrow(_matched_phrases(sorted(terms)), "phrase string, t long, n long")
    phrases = spoken.groupBy("phrase").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).where((F.col("t") == 0) & (F.col("n") >= 3))
    return sorted(r.phrase for r in phrases.orderBy(F.desc("n"), "phrase").limit(most).collect())


def learn(sample: DataFrame, entries: int = 2048, least: int = 4, odds: float = 2.0, surety: float = 6.0) -> Lexicon:
    """A lexicon from a bounded sample (doc_id, text, label).

    Of texts that share the least hash of their word pairs one counts, so a text with many near copies does
    not teach its own words.  The curve from weights to a score is fitted on texts that taught nothing to the lexicon
    which weighs them: each half of the sample is weighed by the other half's.  At most 4 * entries candidates and
    as many exceptions come to the driver.
    """
    rows = sample.select("doc_id", "text", "label").mapInArrow(_sketched, "doc_id long, label int, folded string, sketch long")
    first = rows.groupBy("sketch").agg(F.min_by(F.struct("label", "folded"), "doc_id").alias("row"))
    rows = written(first.select("row.*", F.pmod(F.xxhash64("sketch"), F.lit(2)).alias("half")), "toxic-sample")
    totals = {(r.half, r.label): r["count"] for r in rows.groupBy("half", "label").count().collect()}

    def learned(part: DataFrame, halves: tuple[int, ...]) -> Lexicon:
        known = {label: sum(totals.get((h, label), 0) for h in halves) for label in (0, 1)}
        if not all(known.values()):
            return Lexicon({}, [], (-4.0, 0.0, 0.0, 0.0))
        terms = _entries(part, known, entries, least, odds, surety)
        return Lexicon(terms, _exceptions(part, terms, 4 * entries))

    whole = learned(rows, (0, 1))
    if not whole.terms:
        return Lexicon({}, [], (-4.0, 0.0, 0.0, 0.0))
    weighed = []
    for half in (0, 1):
        shipped = rows.sparkSession.sparkContext.broadcast(learned(rows.where(F.col("half") != half), (1 - half,)))
        weighed.append(rows.where(F.col("half") == half).select("label", "folded").mapInArrow(_weighed(shipped), "label int, total double, strongest double, words double"))
    fit = weighed[0].unionByName(weighed[1]).toPandas()  # numbers of a bounded sample
    x, y = _features(*(fit[n].to_numpy(float) for n in ("total", "strongest", "words"))), fit["label"].to_numpy(float)
    return Lexicon(whole.terms, whole.exceptions, tuple(float(v) for v in _fitted(x, y)))


def score(df: DataFrame, lexicon: Lexicon, text: str = "text", into: str = "toxicity") -> DataFrame:
    """The rows of df and a column `into`, 0 to 1 (a column already so called is replaced).

    Null, empty and word-less texts get the score of a text without matches; repeated rows equal scores; an
    empty table stays empty.
    """
    shipped = df.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        lexicon = shipped.value
        automaton = _automaton_of((tuple(lexicon.terms.items()), tuple(lexicon.exceptions)))
        x = _features(*_measured(pa.array(texts, pa.large_string(), from_pandas=True), automaton))
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ np.array(lexicon.curve), -30, 30))))

    return df.withColumn(into, scored(F.col(f"`{text}`").cast("string")))
