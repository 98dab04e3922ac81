"""Genotype text: alleles and phases to strings such as 0|1, ./. and 2, and back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import bitpack


def genotype(copies: Column) -> Column:
    """Text of an ordered array of (k, allele, phased); it ends at the first absent allele, and may be empty.

    phased stands before its copy: 1 gives `|`, 0 gives `/`.
    """
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))

    def step(state: Column, c: Column) -> Column:
        here = state["open"] & (c["allele"] != -2)
        mark = F.when(c["k"] == 0, F.lit("")).when(c["phased"] == 1, F.lit("|")).otherwise(F.lit("/"))
        value = F.when(c["allele"] == -1, F.lit(".")).otherwise(c["allele"].cast("string"))
        return F.struct(F.when(here, F.concat(state["text"], mark, value)).otherwise(state["text"]).alias("text"), here.alias("open"))

    return F.aggregate(copies, start, step, lambda s: s["text"])


def genotypes(cells: DataFrame) -> DataFrame:
    """v, pos, s and gt."""
    found = cells.groupBy("v", "pos", "s").agg(F.array_sort(F.collect_list(F.struct("k", "allele", "phased"))).alias("copies"))
    return found.select("v", "pos", "s", genotype(F.col("copies")).alias("gt"))


def genotype_of(alleles: Column, phases: Column) -> Column:
    """Text of one sample's array of alleles and the marks between them; it ends at the first absent allele."""
    absent = F.array_position(alleles, -2).cast("int")
    there = F.slice(alleles, 1, F.when(absent > 0, absent - 1).otherwise(F.size(alleles)))
    mark = lambda k: F.when(k == 0, "").when(F.get(phases, k - 1) == 1, "|").otherwise("/")
    return F.array_join(F.transform(there, lambda a, k: F.concat(mark(k), F.when(a == -1, ".").otherwise(a.cast("string")))), "")


def row_genotypes(rows: DataFrame) -> DataFrame:
    """v, contig, pos and gts, the texts of all samples, of variant rows."""
    p = F.col("ploidy")
    each = F.transform(F.sequence(F.lit(0), (F.size("alleles") / p).cast("int") - 1), lambda s: genotype_of(F.slice("alleles", s * p + 1, p), F.slice("phases", s * (p - 1) + 1, p - 1)))
    # Both arrays are named outside of the lambda too: an array named once would be put into it and computed for each sample.
    there = (F.size("alleles") > 0) & (F.size("phases") >= 0)
    return rows.select("v", "contig", "pos", F.when(there, each).otherwise(F.array().cast("array<string>")).alias("gts"))


def parsed_rows(variants: DataFrame) -> DataFrame:
    """v, contig, pos, block_id, row_in_block, ploidy, alleles and phases of variants with gt, an array of genotype texts.

    A block has the ploidy of its longest genotype; others are filled up with absent copies.  Anything but numbers and
    dots raises.
    """
    allele = lambda x: F.when(x == ".", -1).when(x == "", -2).otherwise(x.cast("int"))
    values = F.transform("gt", lambda g: F.transform(F.split(g, r"[/|]"), allele))
    marks = F.transform("gt", lambda g: F.transform(F.regexp_extract_all(g, F.lit("([/|])"), 1), lambda m: (m == "|").cast("int")))
    found = variants.select("v", "contig", "pos", "block_id", "row_in_block", values.alias("values"), marks.alias("marks"))
    most = F.array_max(F.transform("values", F.size))
    p = F.col("ploidy")
    found = found.join(found.groupBy("block_id").agg(F.max(most).alias("ploidy")).hint("merge"), "block_id")
    alleles = F.flatten(F.transform("values", lambda a: F.concat(a, F.array_repeat(F.lit(-2), p - F.size(a)))))
    phases = F.flatten(F.transform("marks", lambda m: F.concat(m, F.array_repeat(F.lit(0), p - 1 - F.size(m)))))
    return found.select("v", "contig", "pos", "block_id", "row_in_block", "ploidy", alleles.alias("alleles"), phases.alias("phases"))


def lines(genotypes_: DataFrame) -> DataFrame:
    """One TAB-separated line a variant, samples in order."""
    found = genotypes_.groupBy("v", "pos").agg(F.array_sort(F.collect_list(F.struct("s", "gt"))).alias("gts"))
    return found.select("v", "pos", F.array_join(F.transform("gts", lambda g: g["gt"]), "\t").alias("line"))


def _line(alleles: np.ndarray, phases: np.ndarray) -> bytes:
    """The TAB-separated genotypes of a variant, alleles (samples, copies) and the marks between them: a byte a mark, digit or TAB, of which those that are not there are left out."""
    if alleles.min(initial=0) < -2:
        raise ValueError("alleles count from 0, but for -1 and -2")
    samples, copies = alleles.shape
    if not samples:
        return b""
    digits = len(str(max(0, int(alleles.max(initial=0)))))
    made, there = np.empty((samples, copies * (digits + 1)), np.uint8), np.ones((samples, copies * (digits + 1)), bool)
    whole = digits == 1 and alleles.min(initial=0) > -2
    open_ = np.logical_and.accumulate(alleles != -2, axis=1) if not whole else None
    for k in range(copies):
        own, at = alleles[:, k], k * (digits + 1)
        if k:
            made[:, at - 1] = np.where(phases[:, k - 1] == 1, np.uint8(ord("|")), np.uint8(ord("/")))
            if not whole:
                there[:, at - 1] = open_[:, k]
        for d in range(digits):
            place = 10 ** (digits - 1 - d)
            made[:, at + d] = (own if digits == 1 else own // place % 10) + np.uint8(ord("0"))
            if not whole:
                there[:, at + d] = open_[:, k] & ((own >= place) | (place == 1))
        last = made[:, at + digits - 1]
        last[own == -1] = ord(".")
    made[:, -1] = ord("\t")
    return (made if whole else made[there]).tobytes()[:-1]


def packed_lines(rows: DataFrame) -> DataFrame:
    """v, pos and line, the genotypes of all samples separated by TABs, of packed variant rows (`store.PACKED`); a row is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, made = batch.slice(at, 64), []
                for p, n, a, b in zip(*(part.column(c).to_pylist() for c in ("ploidy", "n_alleles", "alleles", "phases")), strict=True):
                    made.append(_line(bitpack.numbers_of(a, n).reshape(-1, p), bitpack.numbers_of(b, n // p * (p - 1)).reshape(n // p, p - 1)))
                yield pa.RecordBatch.from_arrays([part.column("v"), part.column("pos"), pa.array(made, pa.binary()).cast(pa.string())], ["v", "pos", "line"])

    return rows.select("v", "pos", "ploidy", "n_alleles", "alleles", "phases").mapInArrow(run, "v long, pos long, line string")


#: Cells of a line that are made at once, about.
_AT_ONCE = 1 << 18


def _parsed(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """s (from 0), k, allele, the text of alleles that are no plain numbers (else null), and phased of the genotypes of a line."""
    text = np.frombuffer(raw + b"\t", np.uint8)
    tab, bar = text == ord("\t"), text == ord("|")
    ends = np.flatnonzero(tab | bar | (text == ord("/")))  # a token ends at each of these
    new = tab[ends]
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    allele = np.full(len(ends), -2, np.int32)
    one = np.flatnonzero(size == 1)
    allele[one] = text[starts[one]].astype(np.int32) - ord("0")
    dots = one[allele[one] == ord(".") - ord("0")]
    odd = [one[(allele[one] < 0) | (allele[one] > 9)], np.flatnonzero(size > 9)]
    allele[dots] = -1
    long = np.flatnonzero((size > 1) & (size < 10))
    value, plain = np.zeros(len(long), np.int32), np.ones(len(long), bool)
    for d in range(int(size[long].max(initial=0))):
        own = np.flatnonzero(size[long] > d)
        digit = text[starts[long[own]] + d].astype(np.int32) - ord("0")
        plain[own] &= (digit >= 0) & (digit < 10)
        value[own] = value[own] * 10 + digit
    allele[long[plain]] = value[plain]
    odd = np.setdiff1d(np.concatenate([*odd, long[~plain]]), dots)
    if len(odd):
        texts = np.full(len(ends), None)
        texts[odd] = [raw[starts[at] : ends[at]].decode() for at in odd]
    texts = pa.array(texts, pa.string()) if len(odd) else pa.nulls(len(ends), pa.string())
    s = np.cumsum(new) - new
    first = np.flatnonzero(np.concatenate([[True], new[:-1]]))
    k = (np.arange(len(ends)) - first[s]).astype(np.int32)
    # The mark before a token ends the one before; the first token has that of the second.
    marks = bar[ends].astype(np.int32)
    phased = np.where(k > 0, np.concatenate([[0], marks[:-1]]), np.where(new, 0, marks)).astype(np.int32)
    empty = (size == 0) & (k > 0) & ~new  # between two marks, which count as one that is neither
    for g in np.unique(s[empty]):
        at = slice(first[g], first[g + 1] if g + 1 < len(first) else len(ends))
        found = re.findall(rb"[/|]+", raw[starts[at][0] : ends[at][-1]])
        phased[at] = [int(j < len(found) and found[j] == b"|") for j in np.maximum(k[at] - 1, 0)]
    return s, k, allele, texts, phased


def parse(lines_: DataFrame) -> DataFrame:
    """v, s, k, allele, phased of TAB-separated lines; anything but numbers and dots raises.

    An empty genotype has one absent allele.  phased of the first copy is that of the second, or 0.
    """
    names, kind = ["v", "s", "k", "allele", "text", "phased"], lines_.schema["v"].dataType.simpleString()

    def cells(batch: pa.RecordBatch) -> Iterator[pa.Table]:
        for v, line in zip(*(batch.column(c) for c in ("v", "line")), strict=True):
            raw, low, ahead = line.as_buffer().to_pybytes() if line.is_valid else b"", 0, 0
            while line.is_valid and low <= len(raw):
                high = raw.find(b"\t", low + _AT_ONCE)  # whole genotypes
                high = len(raw) if high < 0 else high
                s, *found = _parsed(raw[low:high])
                yield pa.Table.from_arrays([pa.repeat(v, len(s)), pa.array(s + ahead), *(x if isinstance(x, pa.Array) else pa.array(x) for x in found)], names)
                low, ahead = high + 1, ahead + int(s[-1]) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[pa.Table] = []
            for table in cells(batch):
                held.append(table)
                if sum(map(len, held)) >= _AT_ONCE // 4:
                    yield from pa.concat_tables(held).combine_chunks().to_batches()
                    held = []
            if held:
                yield from pa.concat_tables(held).combine_chunks().to_batches()

    found = lines_.select("v", "line").mapInArrow(run, f"v {kind}, s long, k int, allele int, text string, phased int")
    return found.select("v", "s", "k", F.when(F.col("text").isNull(), F.col("allele")).otherwise(F.col("text").cast("int")).alias("allele"), "phased")
