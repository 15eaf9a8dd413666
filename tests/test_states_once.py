"""States that a query reads more than once are stored, and the landing keeps a request together."""

import pytest
from pyspark.sql import functions as F

from tidemark.catalog import queries
from tidemark.sources.tables import landing_from_orders

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def warehouse(spark):
    return queries.fresh_warehouse(spark, SMALL)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_an_order_lie_in_one_task(spark):
    keyed = landing_from_orders(spark, SMALL).filter(F.trim("unique_key") != "")
    placed = keyed.withColumn("task", F.spark_partition_id())
    tasks = placed.groupBy("unique_key").agg(F.count_distinct("task").alias("n"))
    assert tasks.agg(F.max("n")).first()[0] == 1 and tasks.count() > 1000


def test_digests_compare_stored_captures(warehouse):
    assert "Window" not in plan(queries.snapshot_diff_digests(warehouse))


def test_probe_reads_a_stored_state(warehouse):
    assert "Window" not in plan(queries.probe_capture(warehouse))


def test_sample_reads_a_stored_state(warehouse):
    assert "windowspecdefinition(unique_key" not in plan(queries.written_sample(warehouse))
