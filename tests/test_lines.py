"""Lines of genotypes as bytes."""

import pytest
from pyspark.sql import functions as F

from varloom.operators import text, verify
from varloom.sources import store

ROWS = "v long, contig string, pos long, block_id long, row_in_block long, ploidy int, alleles array<int>, phases array<int>"


def test_lines_of_packed_rows_equal_those_of_arrays(spark):
    made = [
        (0, "1", 10, 0, 0, 2, [0, 1, -1, 2, 9, -2, -2, 3], [1, 0, 1, 0]),
        (1, "1", 11, 0, 1, 3, [0, 1, -2, 10, -1, 123, -2, -2, -2], [1, 0, 0, 1, 1, 1]),
        (2, "1", 12, 0, 2, 1, [0, -1, -2, 40000], []),
        (3, "1", 13, 0, 3, 2, [0, 0, 1, 1], [0, 1]),
        (4, "1", 14, 0, 4, 2, [], []),
        (3, "1", 13, 0, 3, 2, [0, 0, 1, 1], [0, 1]),
    ]
    rows = spark.createDataFrame(made, ROWS)
    wanted = text.row_genotypes(rows).select("v", "pos", F.array_join("gts", "\t").alias("line"))
    found = text.packed_lines(store._packed(rows))
    assert found.schema == wanted.schema
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    with pytest.raises(Exception, match="alleles count from 0"):
        text.packed_lines(store._packed(spark.createDataFrame([(0, "1", 1, 0, 0, 1, [-3], [])], ROWS))).collect()


def test_lines_of_the_fixture_are_made_of_bytes(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["gt_text_block"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "lambda" not in plan


def test_only_lines_that_differ_are_joined(spark, monkeypatch):
    joined, within = [], verify._within
    monkeypatch.setattr(verify, "_within", lambda *a: joined.append(within(*a)) or joined[-1])
    left = spark.range(3000).select(F.col("id").alias("v"), F.concat(F.lit("0|"), F.col("id")).alias("line"))
    right = left.where("v <> 7").withColumn("line", F.when(F.col("v") % 1000 == 5, "1").otherwise(F.col("line")))
    found = verify.line_differences(left, right)
    assert sorted(map(tuple, found.collect())) == [(5, "0|5", "1"), (7, "0|7", None), (1005, "0|1005", "1"), (2005, "0|2005", "1")]
    assert [df.count() for df in joined] == [4, 3]


def _by_expressions(lines):
    gts = lines.select("v", F.posexplode(F.split("line", "\t")).alias("s", "gt"))
    parts = gts.withColumn("values", F.split("gt", r"[/|]")).withColumn("marks", F.filter(F.split("gt", r"[^/|]+"), lambda m: m != ""))
    each = parts.select("v", F.col("s").cast("long").alias("s"), "marks", F.posexplode("values").alias("k", "value"))
    allele = F.when(F.col("value") == ".", -1).when(F.col("value") == "", -2).otherwise(F.col("value").cast("int"))
    mark = F.get("marks", F.greatest(F.col("k") - 1, F.lit(0)))
    return each.select("v", "s", "k", allele.alias("allele"), F.coalesce((mark == "|").cast("int"), F.lit(0)).alias("phased"))


def test_parsed_lines_equal_those_of_expressions(spark):
    odd = ["0|1\t.\t\t1/.|12\t3", "", "0||1\t|\t0|\t|1\t||\t0/|1/2|3", "-1|+7\t 5 |0123456789", None, "\t\t", "0|1"]
    lines = spark.createDataFrame([*enumerate(odd), (None, "2|2"), (6, "0|1")], "v long, line string")
    plain = lambda df: sorted(map(str, df.collect()))
    found = text.parse(lines)
    assert [t for _, t in found.dtypes] == ["bigint", "bigint", "int", "int", "int"]
    assert plain(found) == plain(_by_expressions(lines))
    long = text.parse(spark.createDataFrame([(3, "\t".join(["0|1", "2"] * 70_000))], "v long, line string"))  # parsed in two pieces
    assert tuple(long.agg(F.count("*"), F.count_distinct("s"), F.max("s"), F.sum("allele"), F.sum("phased"), F.sum(F.col("s") * F.col("allele"))).first()) == (210_000, 140_000, 139_999, 210_000, 140_000, sum((s if s % 2 == 0 else 2 * s) for s in range(140_000)))
    for wrong in ("0|x", "..", "1.5", "3000000000", "0|:"):
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            text.parse(spark.createDataFrame([(0, wrong)], "v long, line string")).collect()


def test_lines_are_parsed_without_exploding_strings(spark):
    import __spark_entry__

    assert "Generate" not in __spark_entry__.queries()["gt_parse"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_lines_that_come_twice_do_not_cancel(spark):
    left = spark.createDataFrame([(1, "0|1"), (1, "0|1"), (2, "1")], "v long, line string")
    right = left.withColumn("line", F.when(F.col("v") == 1, "01").otherwise(F.col("line")))
    assert sorted(map(tuple, verify.line_differences(left, right).collect())) == [(1, "0|1", "01")] * 4
    cells = spark.createDataFrame([(0, 0, 0, 1)] * 2, "v long, s long, k int, allele int")
    assert tuple(verify.summary(cells, cells.withColumn("allele", F.lit(2))).first()) == (2, 2, 4)
