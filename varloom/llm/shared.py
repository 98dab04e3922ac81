"""The folder that all executors share, and small helpers of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.sources.scratch import discard, shared_dir, written

__all__ = ["discard", "docs_of", "shared_dir", "small", "table", "written"]


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A written table marked for broadcast if it has at most `most` rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and text columns alone, under fixed names, whatever else the table holds."""
    return df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
