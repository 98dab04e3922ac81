"""Tables written between steps leave nothing on the disks but themselves."""

from pathlib import Path

from pyspark.sql import functions as F

from varloom.sources.scratch import written


def test_shuffle_files_go_when_the_table_is_written(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    kept = lambda: {p for d in manager.localDirs() for p in Path(d.getPath()).rglob("shuffle_*")}
    before, value = kept(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    df = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count().repartition(3, "k")
    found = written(df, "counts")
    assert not kept() - before
    assert found.count() == 100 and df.count() == 100  # the lazy frame can be run again
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == value
