from datetime import date, datetime
from statistics import median

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scd2
from tidemark.operators.joins import lookup_join
from tidemark.operators.medians import grouped_median
from tidemark.operators.periods import periods
from tidemark.plans import dimensions, fact, marts, metrics, staging
from tidemark.plans.checks import failed, metric_parity, require, run_checks
from tidemark.plans.warehouse import Warehouse


def request(key, created, closed=None, kind="Noise", detail="Loud", agency="NYPD", **more):
    return {
        "unique_key": key, "created_date": created, "closed_date": closed, "complaint_type": kind,
        "descriptor": detail, "agency": agency, "borough": "bronx", "_ingested_at": "2025-06-15 00:00:00", **more,
    }


@pytest.fixture(scope="module")
def landing(landing_rows):
    return landing_rows(
        # active in periods 1, 2 and 4, so a gap opens a second version
        request("1", "2025-01-05 09:00:00", "2025-01-06 09:00:00"),
        request("2", "2025-01-31 23:59:59", "2025-02-02 00:00:00"),
        request("3", "2025-02-01 00:00:00"),
        request("4", "2025-04-10 00:00:00", "2025-04-12 00:00:00"),
        # the owner changes from period 2 to 3
        request("5", "2025-02-10 00:00:00", kind="Water", agency="DEP"),
        request("6", "2025-03-10 00:00:00", kind="Water", agency="HPD"),
        request("7", "2025-06-10 00:00:00", kind="Water", agency="HPD"),
        # a tie goes to the alphabetically first owner; the descriptor is missing
        request("8", "2025-03-11 00:00:00", kind="Tree", detail=None, agency="ZZZ"),
        request("9", "2025-03-12 00:00:00", kind="Tree", detail=None, agency="AAA"),
        # outside every period, without a type, without an agency
        request("10", "2024-12-31 23:59:59", kind="Noise"),
        request("11", "2025-03-01 00:00:00", kind="", agency=""),
    )


@pytest.fixture(scope="module")
def warehouse(spark, landing, params, tmp_path_factory):
    from tidemark.store import Store

    return Warehouse(spark, landing, params, Store.at(spark, str(tmp_path_factory.mktemp("w"))))


def test_versions(warehouse):
    rows = warehouse.dim_complaint_type.filter("not is_unknown_member").collect()
    got = {(r.complaint_type, r.version_number): r for r in rows}
    assert set(got) == {("Noise", 1), ("Noise", 2), ("Water", 1), ("Water", 2), ("Water", 3), ("Tree", 1)}
    first = got["Noise", 1]
    assert (first.valid_from_at, first.valid_to_at) == (datetime(2024, 12, 31, 23, 59, 59), datetime(2025, 2, 28, 23, 59, 59))
    assert (first.periods_covered, first.request_count_in_version, first.is_current) == (2, 3, False)
    assert got["Noise", 2].valid_from_at == datetime(2025, 3, 31, 23, 59, 59)
    assert (got["Water", 1].owning_agency_code, got["Water", 2].owning_agency_code) == ("DEP", "HPD")
    last = got["Water", 3]
    assert last.is_current and last.valid_to_at == datetime(9999, 12, 31, 23, 59, 59)
    assert got["Tree", 1].owning_agency_code == "AAA" and got["Tree", 1].descriptor == "<<none>>"
    assert got["Tree", 1].max_distinct_agencies_in_a_period == 2


def test_fact_takes_the_version_in_force(warehouse):
    version = {r.complaint_type_key: (r.complaint_type, r.version_number) for r in warehouse.dim_complaint_type.collect()}
    got = {r.request_id: version[r.complaint_type_key] for r in warehouse.fact.collect()}
    assert got["1"] == got["2"] == got["3"] == ("Noise", 1)
    assert got["4"] == ("Noise", 2)
    assert (got["5"], got["6"], got["7"]) == (("Water", 1), ("Water", 2), ("Water", 3))
    assert got["8"] == got["9"] == ("Tree", 1)
    assert got["10"] == got["11"] == (None, 0)
    assert len(got) == warehouse.valid.count() == 11


def test_lookup_by_shuffle_gives_the_same_fact(warehouse, params):
    """Beyond the broadcast bound the join shuffles; no row is lost or doubled."""
    small = params.with_(broadcast_max_rows=1)
    salted = fact.fact_service_request(warehouse.valid, warehouse.dim_complaint_type, small)
    assert salted.exceptAll(warehouse.fact).count() == 0 and salted.count() == warehouse.fact.count()
    month = marts.agency_month(marts.durations(warehouse.fact, warehouse.dim_geography, small), small)
    assert month.exceptAll(warehouse.agency_month).count() == 0 and month.count() == warehouse.agency_month.count()


def test_lookup_join_rejects_other_kinds(warehouse, params):
    with pytest.raises(ValueError):
        lookup_join(warehouse.fact, warehouse.dim_agency, F.lit(True), params, "full")


def test_unknown_members(warehouse):
    agency = {r.agency_key: r for r in warehouse.dim_agency.collect()}
    assert agency["UNKNOWN"].request_count == 1 and agency["UNKNOWN"].agency_code is None
    kind = warehouse.dim_complaint_type.filter("is_unknown_member").first()
    assert kind.request_count_in_version == 1 and kind.valid_from_at == datetime(1900, 1, 1)


def test_modal_agency_name(landing_rows, params):
    def named(key, name, code="A"):
        return request(key, "2025-02-01 00:00:00", agency=code, agency_name=name)

    log = landing_rows(
        named("1", "Beta"), named("2", "Alpha"), named("3", None),
        named("4", None, "B"), named("5", None, "B"), named("6", "Name", "B"),
    )
    rows = {r.agency_key: r for r in dimensions.dim_agency(staging.valid(staging.stage(log, params))).collect()}
    assert rows["A"].agency_name == "Alpha" and rows["A"].distinct_names_seen == 3
    assert rows["B"].agency_name is None and rows["B"].request_count == 3


def test_measures_of_a_request(warehouse):
    rows = {r.request_id: r for r in warehouse.fact.collect()}
    assert rows["1"].days_to_close == rows["1"].age_days == 1.0 and rows["1"].is_within_target
    assert rows["3"].days_to_close is None and rows["3"].is_within_target is False
    assert rows["3"].age_days == 134.5 and rows["3"].is_mature_at_build
    assert rows["7"].is_within_target is None and not rows["7"].is_mature_at_build


def test_checks_pass_and_metrics_match_the_mart(warehouse):
    results = run_checks(warehouse)
    require(results)
    assert failed(results).collect() == [] and results.count() == 52
    assert len(warehouse.build()) == 18
    assert metric_parity(warehouse) == {"missing": [], "undocumented": []}


def test_checks_find_what_is_broken(warehouse):
    history = warehouse.dim_complaint_type
    keyed_current = history.filter("complaint_type = 'Water' and version_number = 3").first().complaint_type_key
    wrong = warehouse.fact.withColumn("complaint_type_key", F.lit(keyed_current))
    outside = scd2.outside_validity(wrong, history, "complaint_type_key", "created_at", warehouse.params)
    assert outside.count() == 10
    stretched = history.filter("not is_unknown_member").withColumn("valid_to_at", F.lit("9999-12-31").cast("timestamp_ntz"))
    assert scd2.overlapping(stretched, dimensions.TYPE_KEY).count() == 3


def test_metric_registry_frame(spark):
    assert metrics.as_frame(spark).count() == 10 and len(metrics.CONVENTIONS) == 4


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_grouped_median_is_exact(spark, width):
    values = {None: [5], "odd": [1, 9, 4], "even": [1, 2, 3, 10], "same": [7] * 9, "far": [0, 0, 500, 900]}
    rows = [(g, v) for g, vs in values.items() for v in vs]
    hist = spark.createDataFrame(rows, "g string, v long").groupBy("g", "v").agg(F.count("*").alias("n"))
    parts = grouped_median(hist, ["g"], "v", "n", width)
    got = parts.groupBy("g").agg((F.sum(F.col("median_part") * F.col("parts")) / 2).alias("m"))
    assert {r.g: r.m for r in got.collect()} == {g: median(vs) for g, vs in values.items()}


def test_cohorts_and_censoring(spark, landing_rows, params, store):
    log = landing_rows(
        request("a", "2025-01-01 00:00:00", "2025-01-03 00:00:00"),
        request("b", "2025-01-01 00:00:00", "2025-01-05 00:00:00"),
        request("c", "2025-01-01 00:00:00", "2025-05-01 00:00:00"),
        request("d", "2025-01-01 00:00:00"),
        request("e", "2025-05-01 00:00:00"),
    )
    w = Warehouse(spark, log, params, store)
    jan, may = w.cohort_maturity.orderBy("cohort_month").collect()
    assert jan.is_cohort_mature and jan.cohort_size == 4 and jan.closed_so_far == 3
    assert jan.naive_median_days_to_close == 4.0 and jan.naive_mean_days_to_close == 42.0
    assert jan.matured_mean_days_to_close == 3.0 and jan.matured_median_days_to_close == 3.0
    assert jan.unresolved_share_at_maturity == 0.5
    assert jan.naive_understatement_days == -39.0
    assert not may.is_cohort_mature and may.naive_mean_days_to_close is None and may.matured_mean_days_to_close is None
    month = w.agency_month.filter("cohort_month = date'2025-01-01'").first()
    assert (month.request_volume, month.on_time_denominator, month.on_time_rate) == (4, 4, 0.5)
    whole = marts.reaggregate(w.bi_wide, ["agency_code"]).first()
    assert whole.mean_days == 42.0 and whole.mean_days_matured == 3.0 and whole.closure_rate == 3 / 5


@pytest.mark.parametrize("build, mature", [("2025-05-01 23:59:59", True), ("2025-05-01 23:59:58", False)])
def test_a_month_is_mature_to_the_second(spark, ntz, params, build, mature):
    facts = ntz(
        [("2025-01-31 23:59:59", None, True)], "created_at string, closed_at string, is_within_target boolean",
        ["created_at", "closed_at"],
    )
    histogram = marts.duration_histogram(facts.withColumn("cohort_month", F.trunc("created_at", "MM")), ["cohort_month"])
    row = marts.cohort_maturity(histogram, params.with_(build_as_of=datetime.fromisoformat(build))).first()
    assert row.is_cohort_mature is mature and row.cohort_month == date(2025, 1, 1)


def test_spans_of_a_gap_leave_a_hole(spark, warehouse, params):
    spans = periods(spark, params)
    hole = warehouse.dim_complaint_type.filter("complaint_type = 'Noise'").orderBy("version_number").collect()
    assert hole[0].valid_to_at < hole[1].valid_from_at and spans.count() == 6
