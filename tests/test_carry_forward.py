import pytest
from pyspark.sql import functions as F

from tidemark.operators.scd2 import as_of_lookup, carry_forward

HOT_VERSIONS = 10_000


@pytest.fixture(scope="module")
def history(spark):
    """One key with 10,000 versions, gaps among them, and keys with a few."""
    i = F.col("id")
    start = F.lit("2020-01-01").cast("timestamp_ntz")

    def after(seconds):
        return start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))

    hot = spark.range(HOT_VERSIONS).select(F.lit("hot").alias("k"), F.lit("x").alias("d"), i, (i * 100).alias("s"))
    cold = spark.range(300).select(
        F.concat(F.lit("k"), i % 100).alias("k"), F.lit("x").alias("d"), (i + 10**6).alias("id"), (F.floor(i / 100) * 300_000).alias("s")
    )
    return hot.unionByName(cold).select(
        "k", "d", F.col("id").alias("version"), after(F.col("s")).alias("valid_from_at"),
        after(F.col("s") + F.when(i % 7 == 0, 60).otherwise(100)).alias("valid_to_at"),
    ).cache()


@pytest.fixture(scope="module")
def facts(spark):
    i = F.col("id")
    rows = spark.range(60_000, numPartitions=6).select(
        i,
        F.when(i % 3 == 0, F.lit("hot")).when(i % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), i % 130)).alias("kind"),
        F.when(
            i % 997 != 0,
            F.lit("2019-12-31 23:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(secs=(F.when(i % 5 == 0, i % 10_000 * 100).otherwise(i * 7919 % 1_010_000)).cast("decimal(18,6)")),
        ).alias("at"),
    )
    return rows.cache()


def plain(facts, history):
    """The lookup by its definition: facts joined with all versions of their key."""
    h = history.select("k", "version", "valid_from_at", "valid_to_at")
    on = (F.col("kind") == F.col("k")) & (F.col("at") > F.col("valid_from_at")) & (F.col("at") <= F.col("valid_to_at"))
    return facts.join(h, on, "left").select("id", "kind", "at", "version")


def looked_up(facts, history, slots=64):
    match = {"k": F.col("kind"), "d": F.when(F.col("kind").isNotNull(), F.lit("x"))}
    return carry_forward(facts, history, match, "at", "version", slots)


@pytest.mark.parametrize("slots", [1, 2, 64])
def test_equals_the_join(facts, history, slots):
    got = looked_up(facts, history, slots)
    assert got.columns == ["id", "kind", "at", "version"]
    want = plain(facts, history)
    assert got.count() == want.count() == 60_000
    assert got.exceptAll(want).count() == 0
    assert got.filter("version is not null").count() > 10_000


def test_no_fact_is_joined_with_versions(facts, history):
    plan = looked_up(facts, history)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_a_hot_key_is_sorted_in_pieces(facts, history):
    from tidemark.operators.scd2 import time_slots

    slot = time_slots(facts, "at", 64)
    sizes = facts.filter("kind = 'hot'").withColumn("_ts", F.col("at")).groupBy(slot.alias("s")).count().collect()
    assert len(sizes) > 40 and max(r["count"] for r in sizes) < 3 * 20_000 / 64


def test_lookup_carries_a_history_beyond_the_bound(facts, history, params):
    match = {"k": F.col("kind"), "d": F.when(F.col("kind").isNotNull(), F.lit("x"))}
    small = as_of_lookup(facts, history, match, "at", "version", params)
    large = as_of_lookup(facts, history, match, "at", "version", params.with_(broadcast_max_rows=10))
    assert "Join" not in large._jdf.queryExecution().executedPlan().toString()
    assert small.exceptAll(large).count() == large.exceptAll(small).count() == 0


def test_empty_sides(facts, history):
    assert looked_up(facts.filter("false"), history).collect() == []
    assert looked_up(facts, history.filter("false")).filter("version is not null").count() == 0


def test_the_sorts_stay_apart_however_small_or_large(facts, history):
    """As many partitions as ranges or more; merged ones would be sorted by too few tasks."""
    got = looked_up(facts, history).withColumn("p", F.spark_partition_id())
    assert got.select("p").distinct().count() > 32
    plan = looked_up(facts, history)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
