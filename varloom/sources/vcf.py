"""Variant call text (VCF, plain or gzip) and genotype text as sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.operators import layout, text
from varloom.sources import vcf_format
from varloom.sources.scratch import written


def _lines(spark: SparkSession, path: str) -> DataFrame:
    if not path.endswith((".vcf", ".vcf.gz")):
        raise ValueError(f"not a VCF file: {path}")
    return spark.read.text(path)


def _split(path: str) -> bool:
    """Whether a path is compressed and lies where `vcf_format` can read it in splits."""
    return path.endswith(".vcf.gz") and ("://" not in path or path.startswith(("file:", "hdfs:", "s3:", "gs:")))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """line_no and value of the header's lines."""
    if _split(path):
        return spark.createDataFrame(list(enumerate(vcf_format.head_lines(path))), "line_no long, value string")
    head = _lines(spark, path).withColumn("line_no", F.monotonically_increasing_id()).where(F.col("value").startswith("#"))
    return head.select("line_no", "value")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """s and name of the sample columns, from the header line."""
    head = (read_header if _split(path) else _lines)(spark, path).where(F.col("value").startswith("#CHROM")).limit(1)
    return head.select(F.posexplode(F.slice(F.split("value", "\t"), 10, 1 << 30)).alias("s", "name")).select(F.col("s").cast("long").alias("s"), "name")


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """contig, pos, v (variants in order of contig, position and file place) and gt (array of genotype texts).

    The genotype is taken where FORMAT says it stands.  Numbering sorts ranges of (contig, pos) in parallel and adds
    the ranges' counts.  Compressed files go through `vcf_format`, so block-compressed ones are read by many tasks.
    """
    if _split(path):
        return numbered(vcf_format.read(spark, path), ["contig", "pos", "file", "place"]).drop("file", "place")
    fields = F.split("value", "\t")
    place = F.monotonically_increasing_id()
    rows = _lines(spark, path).select("value", place.alias("place")).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    rows = rows.select(fields.alias("f"), "place").withColumn("at", F.array_position(F.split(F.col("f")[8], ":"), "GT").cast("int"))
    gt = F.transform(F.slice("f", 10, 1 << 30), lambda x: F.get(F.split(x, ":"), F.col("at") - 1))
    found = rows.select(F.col("f")[0].alias("contig"), F.col("f")[1].cast("long").alias("pos"), gt.alias("gt"), "place")
    return numbered(found, ["contig", "pos", "place"]).drop("place")


def numbered(df: DataFrame, order: list[str], into: str = "v") -> DataFrame:
    """Dense row numbers from 0 in an order, without one task that holds all rows.

    The sorted ranges are written once, each row with its range and its place there, and read from then on: running
    the sort again could deal the rows to other ranges.  The ranges' counts, one row each, are added up and joined.
    """
    low = 33  # monotonically_increasing_id holds the partition above this bit
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = written(ranged, "numbered").withColumn("_range", F.shiftright("_id", low))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    ahead = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_ahead"))
    found = ranged.join(F.broadcast(ahead), "_range")  # one row a partition
    return found.withColumn(into, F.col("_ahead") + F.col("_id") - F.shiftleft("_range", low)).drop("_id", "_range", "_ahead")


def in_blocks(variants: DataFrame, block_size: int = 1024) -> DataFrame:
    """block_id and row_in_block of numbered variants; a block ends with its contig."""
    contigs = variants.groupBy("contig").agg(F.min("v").alias("_first"), F.ceil(F.count("*") / block_size).alias("_blocks"))
    contigs = contigs.select("contig", "_first", (F.sum("_blocks").over(Window.orderBy("_first")) - F.col("_blocks")).alias("_ahead"))  # one row a contig
    at = F.col("v") - F.col("_first")
    return variants.join(contigs, "contig").withColumn("block_id", F.col("_ahead") + F.floor(at / block_size)).withColumn("row_in_block", at % block_size).drop("_first", "_ahead")


def rows_of(variants: DataFrame, block_size: int = 1024) -> DataFrame:
    """Variant rows of variants with contig, pos, v and gt; each block has the ploidy of its longest genotype."""
    return text.parsed_rows(in_blocks(variants, block_size))


def cells_of(variants: DataFrame, block_size: int = 1024) -> DataFrame:
    """The cell table of variants with contig, pos, v and gt."""
    return layout.cells(rows_of(variants, block_size))


def write_vcf(genotypes: DataFrame, path: str, names: list[str], files: int | None = None) -> None:
    """Genotypes (v, contig, pos, gts) as a VCF without other fields, a part file a partition; the header stands in the first.

    A path that ends with .vcf.gz gets block-compressed files.  files: their number, about.
    """
    head = "##fileformat=VCFv4.2\n#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])
    dot = F.lit(".")
    body = genotypes.select("v", F.concat_ws("\t", "contig", F.col("pos").cast("string"), dot, dot, dot, dot, dot, dot, F.lit("GT"), F.array_join("gts", "\t")).alias("value"))
    first = genotypes.sparkSession.range(1).select(F.lit(-1).cast("long").alias("v"), F.lit(head).alias("value"))
    both = first.unionByName(body)
    lines = (both.repartitionByRange("v") if files is None else both.repartitionByRange(files, "v")).sortWithinPartitions("v").select("value")
    if path.endswith(".gz"):
        vcf_format.register(genotypes.sparkSession)
        lines.write.format("vcf").mode("append").save(path)
    else:
        lines.write.mode("errorifexists").text(path)


def write_lines(genotypes: DataFrame, path: str) -> None:
    """Genotype text, one line a variant, in order of v over the files."""
    text.lines(genotypes).repartitionByRange("v").sortWithinPartitions("v").select("line").write.mode("errorifexists").text(path)
