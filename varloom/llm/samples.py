"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.shared import written


def held_out(doc_id: str | Column, parts: int, part: int) -> Column:
    """Whether a row belongs to the part from which no label may be learned."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(parts)) == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, parts: int, part: int, rows: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most `rows` labelled rows outside the held-out part.

    Rows are taken in the order of a hash of their id.  The ids, of which there are at most `rows`, are
    broadcast, and the sample is written once, so no other texts are shuffled or read again.  Rows without an id,
    a label or a text are not used; a text whose id is labelled twice, or an id with several texts, counts as often.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out("doc_id", parts, part)).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    return written(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").where("text IS NOT NULL"), "labelled")
