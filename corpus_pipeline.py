"""Corpus pipeline: from `documents` to packed sequences, five operators one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
Between stages the rows are written as Parquet in the shared folder, so a lost executor costs one stage's tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import decontaminate, near_copies, packing, quality_rules, repeats, wordtokens
from varloom.llm.shared import table, written


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars of texts that a stage has cut."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, row by row: null and repeated ids are judged on their own.

    Null and empty texts have no words and go; texts of any length are measured whole; no rows give no rows.
    """
    return quality_rules.judge(docs, carry=True).where("kept").select("row.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own, `row_key`, in order of doc_id (null last); written, so that it stays the same."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("row_key")]
    ranged = docs.withColumn("row_key", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    # The number of the range stands in the upper bits, so these ids are in order over the ranges too.
    return written(ranged.withColumn("row_key", F.monotonically_increasing_id()), "keyed")


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near-copies (five-word shingles, similarity 0.8).

    Each row is a document of its own: of copies that share an id one is kept, and rows without an id come last.
    """
    keyed = _keyed(docs)
    kept = near_copies.near_copies(keyed, shingle=5, percent=80, doc_id="row_key").where("kept").select(F.col("doc_id").alias("row_key"))
    return keyed.join(kept, "row_key", "left_semi").select(*docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that a document with a smaller id holds.

    All rows stay.  Rows without an id rank last; rows that share an id, or have none, take nothing from one another; null texts
    become empty.
    """
    return _recounted(repeats.remove_repeats(docs))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of benchmark items.  All rows stay; null texts and an empty benchmark change nothing."""
    return _recounted(decontaminate.remove_phrases(docs, table(spark, sf_dir, "benchmark")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of 4,096.  Rows are packed one by one; a null text is its end id."""
    return packing.pack(docs, wordtokens.default_path(), keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("near copies", near_copies_stage),
    ("repeats", repeats_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: Outlier rejection, text removal and tokens are beyond SQL; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
