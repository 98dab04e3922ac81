"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder named by the session; a new temporary one only in local mode (tests), where all share it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="varloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that ends in here go with it; otherwise they lie on the disks until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Options of Parquet files with long rows.  A reader's batch ends with its row group, so this bounds what a scan holds: 8 MB of coded bytes, and 1,024 rows where
#: these compress well.
LONG_ROWS = {"parquet.block.size": str(8 << 20), "parquet.block.row.count.limit": "1024", "parquet.page.size.row.check.min": "8"}


def written(df: DataFrame, name: str, long_rows: bool = False) -> DataFrame:
    """The rows of df, written once as a table in the shared folder and read from there.

    This cuts the lineage: the table outlives lost executors, and later actions do not repeat the work.  long_rows: rows may have many kilobytes each.
    """
    path = scratch_path(df.sparkSession, name)
    with _shuffles_removed(df.sparkSession):
        df.write.options(compression="zstd", **(LONG_ROWS if long_rows else {})).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_path = path
    return found


#: Bytes of rows that a task sorts, as far as groups allow it.
TASK_BYTES = 16 << 20


def tasks(spark: SparkSession, size: int = 0) -> int:
    """The session's number of shuffle partitions, or more where these would be given too much of `size` bytes: what a task sorts does not follow the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def spread(df: DataFrame, *keys: str, size: int = 0) -> DataFrame:
    """The rows dealt by keys to `tasks` partitions, for work that is dear for its bytes.  size: the bytes of all rows, if known.

    Adaptive execution joins small partitions by their size; groups that compute for long would then share few tasks.
    """
    return df.repartition(tasks(df.sparkSession, size), *keys)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df.written_path
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
