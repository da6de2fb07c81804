"""What a review found: each test fails on the code before."""

import pytest
from clausegraph.plans import QUERIES
from clausegraph.plans.fixture import fixture

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["survivors", "dir_edges"])
def test_tables_count_by_their_rows(spark, name):
    """Rows are packed to a fortieth in files; a table that is planned by these is taken for small and sent to the driver."""
    table = fixture(spark, SF, name).select("question_id", "type" if name == "survivors" else "etype")
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size >= 16 * table.count()


@pytest.mark.parametrize("name", ["clustering", "feedforward_loops"])
def test_edges_are_not_broadcast(spark, name):
    """Under a limit that edges and survivors would exceed as rows, no part of them goes to the driver, though their files are smaller."""
    rows = fixture(spark, SF, "dir_edges").count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(8 * rows))
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
