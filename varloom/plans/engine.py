"""The engine's three commands: encode, decode (all, or a range and samples) and compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.operators import access, layout, text, verify
from varloom.operators.matrices import EncodeOptions
from varloom.sources import store, vcf

__all__ = ["EncodeOptions", "Engine"]


class Engine:
    def __init__(self, spark: SparkSession, options: EncodeOptions | None = None):
        self.spark, self.options = spark, options or EncodeOptions()

    def encode(self, cells: DataFrame, path: str, names: DataFrame | None = None) -> None:
        """Encode a table of cells; its samples are numbered from 0, its variants (v) from 0 in order of contig and position."""
        samples = cells.agg(F.max("s")).first()[0]
        self.encode_rows(layout.rows(cells, 0 if samples is None else samples + 1), path, names)

    def encode_rows(self, rows: DataFrame, path: str, names: DataFrame | None = None) -> None:
        """Encode variant rows, in blocks of the options' size, or with block_size=None in the blocks that they are given in."""
        store.write(rows, path, self.options, names, block_size=self.options.block_size)

    def append_rows(self, rows: DataFrame, path: str) -> None:
        """Add variant rows behind those of a store."""
        store.append(rows, path)

    def encode_vcf(self, source: str, path: str) -> None:
        """Encode a VCF, with the names of its samples and its header."""
        rows = vcf.rows_of(vcf.read_variants(self.spark, source), self.options.block_size or EncodeOptions.block_size)
        store.write(rows, path, self.options, vcf.read_samples(self.spark, source), vcf.read_header(self.spark, source))

    def decode_rows(self, path: str, pos: tuple[int, int] | None = None, samples: list[str] | None = None, unknown: str = "raise", contig: str | None = None) -> DataFrame:
        """v, contig, pos and gts, the genotypes of all samples or of the named ones in the order named."""
        store.check(self.spark, path)
        columns = None
        if samples is not None:
            chosen = access.select_samples(self.spark.read.parquet(f"{path}/samples"), samples, unknown)
            columns = [r["s"] for r in chosen.orderBy("ord").collect()]  # as many as were asked for
        return text.row_genotypes(store.read(self.spark, path, *(pos or (None, None)), contig=contig, columns=columns))

    def decode(self, path: str, pos: tuple[int, int] | None = None, samples: list[str] | None = None, unknown: str = "raise", contig: str | None = None) -> DataFrame:
        """v, contig, pos, s and gt; s is the place in `samples` where they are named."""
        found = self.decode_rows(path, pos, samples, unknown, contig)
        return found.select("v", "contig", "pos", F.posexplode_outer("gts").alias("s", "gt")).where("s IS NOT NULL").withColumn("s", F.col("s").cast("long"))

    def decode_lines(self, path: str, pos: tuple[int, int] | None = None, samples: list[str] | None = None, unknown: str = "raise", contig: str | None = None) -> DataFrame:
        """v, contig, pos and line, the genotypes of a variant separated by TABs."""
        return self.decode_rows(path, pos, samples, unknown, contig).select("v", "contig", "pos", F.array_join("gts", "\t").alias("line"))

    def compare(self, path: str, cells: DataFrame) -> DataFrame:
        """The cells in which a store differs from its source; none if it is intact."""
        return verify.differences(store.read_cells(self.spark, path), cells)

    def compare_rows(self, path: str, rows: DataFrame) -> DataFrame:
        """The variants in which a store differs from its source in alleles, phases or place; none if it is intact."""
        return verify.row_differences(store.read(self.spark, path), rows)

    def compare_vcf(self, path: str, source: str) -> DataFrame:
        """The variants whose lines differ between a store and a VCF, or stand in one of them only."""
        variants = vcf.read_variants(self.spark, source)
        return verify.line_differences(self.decode_lines(path), variants.select("v", F.array_join("gt", "\t").alias("line")))
