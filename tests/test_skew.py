"""A third of all rows share one key, agency, type, place, month and duration."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import marts, reports, staging
from tidemark.plans.warehouse import Warehouse
from tidemark.sources.landing import LANDING_COLUMNS
from tidemark.store import Store

ROWS = 30_000


@pytest.fixture(scope="module")
def warehouse(spark, params, tmp_path_factory):
    i = F.col("id")
    hot = i % 3 == 0
    created = F.lit("2025-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        secs=F.when(hot, i % 2000).otherwise((i * 7919) % 12_000_000).cast("decimal(18,6)")
    )
    took = F.make_dt_interval(secs=F.when(hot, i % 9000).otherwise((i * 104729) % 15_000_000).cast("decimal(18,6)"))
    values = {
        # a sixth of the rows are re-ingestions of one request
        "unique_key": F.when(i % 6 == 3, F.lit("hot")).otherwise(i.cast("string")),
        "created_date": created.cast("string"),
        "closed_date": F.when(i % 5 != 1, (created + took).cast("string")),
        "agency": F.when(hot, F.lit("HOT")).otherwise(F.concat(F.lit("A"), i % 11)),
        "complaint_type": F.when(hot, F.lit("Hot")).otherwise(F.concat(F.lit("T"), i % 17)),
        "descriptor": F.when(hot, F.lit("Hot")).otherwise(F.concat(F.lit("D"), i % 5)),
        "borough": F.when(hot, F.lit("X")).otherwise(F.concat(F.lit("B"), i % 5)),
        "_ingested_at": (
            F.lit("2025-06-16").cast("timestamp_ntz") + F.make_dt_interval(secs=i.cast("decimal(18,6)"))
        ).cast("string"),
    }
    landing = spark.range(0, ROWS, numPartitions=8).select(
        *[values.get(c, F.lit(None).cast("string")).alias(c) for c in LANDING_COLUMNS]
    )
    store = Store.at(spark, str(tmp_path_factory.mktemp("skew")))
    return Warehouse(spark, store.table("raw", "landing", landing), params, store)


def test_hot_key_keeps_its_newest_row(warehouse):
    rows = staging.current_rows(warehouse.landing)
    assert rows.count() == ROWS - ROWS // 6 + 1
    last = max(i for i in range(ROWS) if i % 6 == 3)
    hot = rows.filter("unique_key = 'hot'").collect()
    assert len(hot) == 1
    expected = warehouse.landing.agg(
        F.max(F.when(F.col("unique_key") == "hot", F.col("_ingested_at"))).alias("m")
    ).first().m
    assert hot[0]._ingested_at == expected and last == ROWS - 3


def test_every_measure_equals_the_plain_aggregate(warehouse, params):
    w = warehouse
    facts = w.fact.join(w.dim_geography.select("geography_key", "borough"), "geography_key").withColumn(
        "cohort_month", F.trunc("created_date_key", "MM")
    )
    plain = facts.groupBy(*marts.MONTH_KEYS).agg(
        F.count("*").alias("request_volume"),
        F.count("closed_at").alias("closed_volume"),
        F.median("days_to_close").alias("median"),
        F.avg("days_to_close").alias("mean"),
    )
    got = w.agency_month.select(
        *marts.MONTH_KEYS, "request_volume", "closed_volume", "median_days_to_close", "mean_days_to_close"
    )
    on = None
    for k in marts.MONTH_KEYS:
        same = F.col(f"p.{k}").eqNullSafe(F.col(f"g.{k}"))
        on = same if on is None else on & same
    both = plain.alias("p").join(got.alias("g"), on, "full_outer")

    def close(a, b):
        a, b = F.col(a), F.col(b)
        return (a.isNull() & b.isNull()) | (F.abs(a - b) < 1e-9)

    agree = (
        F.col("p.request_volume").eqNullSafe(F.col("g.request_volume"))
        & F.col("p.closed_volume").eqNullSafe(F.col("g.closed_volume"))
        & close("median", "median_days_to_close")
        & close("mean", "mean_days_to_close")
    )
    assert both.filter(~F.coalesce(agree, F.lit(False))).count() == 0
    assert both.count() == got.count() > 100


def test_cohort_medians_equal_the_plain_aggregate(warehouse, params):
    days = F.when(F.col("days_to_close") <= params.maturity_window_days, F.col("days_to_close"))
    plain = {
        r.m: (r.naive, r.matured)
        for r in warehouse.fact.groupBy(F.trunc("created_date_key", "MM").alias("m"))
        .agg(F.median("days_to_close").alias("naive"), F.median(days).alias("matured"))
        .collect()
    }
    for r in warehouse.cohort_maturity.collect():
        naive, matured = plain[r.cohort_month]
        assert r.naive_median_days_to_close == pytest.approx(naive, abs=1e-9)
        if r.is_cohort_mature:
            assert r.matured_median_days_to_close == pytest.approx(matured, abs=1e-9)


def test_both_marts_read_the_stored_histogram(warehouse):
    for mart in (marts.agency_month, marts.cohort_maturity):
        plan = mart(warehouse.durations, warehouse.params)._jdf.queryExecution().toString()
        assert "fct_service_request" not in plan and "intermediate/durations" in plan


def test_backlog_ranks_equal_a_single_sort(warehouse):
    got = {r.agency_key: r for r in reports.backlog_share(warehouse.fact, warehouse.store).collect()}
    order = sorted(got.values(), key=lambda r: (-r.backlog, r.agency_key))
    assert [r.backlog_rank for r in order] == list(range(1, len(order) + 1)) and len(order) > 5
    total = sum(r.backlog for r in order)
    for i, r in enumerate(order):
        assert r.cumulative_share == pytest.approx(sum(x.backlog for x in order[: i + 1]) / total)
