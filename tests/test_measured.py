"""Facts and counts of the fixture come from tiles of its cells."""


def test_statistics_of_the_fixture_make_no_cells(spark):
    import __spark_entry__

    for name in ("access_units", "recode_stats", "phase_uniformity", "missing_by_sample"):
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan, name
