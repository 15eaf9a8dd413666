from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.config import Params, resolve_window_end
from tidemark.operators.periods import date_spine, periods, vintages, with_period
from tidemark.sources.landing import month_slices


def test_month_ends_then_the_build_date(spark, params):
    rows = [tuple(r) for r in vintages(spark, params).orderBy("vintage_seq").collect()]
    assert [r[0] for r in rows] == [
        date(2025, 1, 31), date(2025, 2, 28), date(2025, 3, 31), date(2025, 4, 30), date(2025, 5, 31), date(2025, 6, 15),
    ]
    assert rows[0][1] == datetime(2025, 1, 31, 23, 59, 59)
    assert [r[2] for r in rows] == [1, 2, 3, 4, 5, 6]
    assert [r[3] for r in rows] == [False] * 5 + [True]


def test_build_on_a_month_end_is_one_vintage(spark, params):
    p = params.with_(build_as_of=datetime(2025, 3, 31, 5))
    assert vintages(spark, p).count() == 3


def test_first_period_opens_with_the_window(spark, params):
    rows = periods(spark, params).orderBy("vintage_seq").collect()
    assert rows[0].period_start_at == datetime(2024, 12, 31, 23, 59, 59)
    assert all(b.period_start_at == a.vintage_cutoff_at for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("cadence, count", [("day", 136), ("week", 20), ("quarter", 2)])
def test_other_cadences(spark, params, cadence, count):
    p = params.with_(vintage_cadence=cadence)
    rows = periods(spark, p).orderBy("vintage_seq").collect()
    assert len(rows) == count <= p.vintage_count_bound()
    assert rows[-1].vintage_date == date(2025, 6, 15) and rows[-1].is_final_vintage


@pytest.mark.parametrize("cadence", ["day", "week", "month", "quarter"])
def test_period_lookup_equals_the_plain_range_condition(spark, params, ntz, cadence):
    instants = [
        "2024-12-31 23:59:59", "2025-01-01 00:00:00", "2025-01-31 23:59:59", "2025-01-31 23:59:59.4",
        "2025-02-01 00:00:00", "2025-03-15 12:00:00", "2025-06-15 23:59:59", "2025-06-16 00:00:00", "2025-04-06 23:59:59.9",
    ]
    df = ntz([(t,) for t in instants], "at string", ["at"])
    spans = periods(spark, params.with_(vintage_cadence=cadence))
    got = with_period(df, "at", spans, params.with_(vintage_cadence=cadence), ["vintage_seq"])
    want = df.join(spans, (F.col("at") > F.col("period_start_at")) & (F.col("at") <= F.col("vintage_cutoff_at")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("at", "vintage_seq").collect()))


def test_spine_covers_a_year_either_side(spark, params):
    rows = date_spine(spark, params)
    ends = rows.agg(F.min("date_day").alias("a"), F.max("date_day").alias("b"), F.count("*").alias("n")).first()
    assert (ends.a, ends.b, ends.n) == (date(2024, 1, 1), date(2026, 1, 1), 732)
    sunday = rows.filter("date_day = date'2025-06-15'").first()
    assert (sunday.day_of_week, sunday.is_weekend, sunday.week_start_date) == (0, True, date(2025, 6, 9))
    assert sunday.is_in_ingest_window and sunday.iso_week == 24


def test_slices_are_clamped(spark):
    rows = [tuple(r) for r in month_slices(spark, datetime(2025, 1, 10), datetime(2025, 3, 1)).orderBy("slice").collect()]
    assert rows == [
        ("2025-01", datetime(2025, 1, 10), datetime(2025, 2, 1)),
        ("2025-02", datetime(2025, 2, 1), datetime(2025, 3, 1)),
    ]


def test_window_end_never_falls_back_to_now():
    assert resolve_window_end(None, "2025-01-01T00:00:00") == datetime(2025, 1, 1)
    with pytest.raises(ValueError):
        resolve_window_end(None, None)


def test_unknown_cadence_is_refused():
    with pytest.raises(ValueError):
        Params(datetime(2025, 1, 1), datetime(2025, 2, 1), datetime(2025, 2, 1), date(2025, 1, 1), "fortnight")


@pytest.mark.parametrize("cadence", ["day", "week", "month", "quarter"])
def test_bins_stay_within_their_bound(spark, params, cadence):
    """A window that opens years before the first vintage makes one long period."""
    p = params.with_(vintage_cadence=cadence, window_start=datetime(2015, 6, 3))
    spans = periods(spark, p)
    probe = spark.range(1).select(F.lit("2016-02-03 00:00:00").cast("timestamp_ntz").alias("at"))
    found = with_period(probe, "at", spans, p, ["vintage_seq"]).collect()
    assert [r.vintage_seq for r in found] == [1]
    unit = {"day": "DAY", "week": "WEEK"}.get(cadence, "MONTH")
    days = spans.select(
        F.explode(F.sequence(F.col("period_start_at").cast("date"), F.col("vintage_cutoff_at").cast("date"))).alias("d"),
        "vintage_seq",
    )
    bins = days.select("vintage_seq", F.date_trunc(unit, "d")).distinct().count()
    assert bins <= p.bin_count_bound() <= 2 * bins + 60


def test_calendars_with_nothing_before_the_build(spark, params):
    late = params.with_(vintage_first=date(2026, 1, 31))
    assert [r.vintage_date for r in vintages(spark, late).collect()] == [date(2025, 6, 15)]
    closed = params.with_(window_start=datetime(2025, 3, 10))
    probe = spark.range(1).select(F.lit("2025-01-15 00:00:00").cast("timestamp_ntz").alias("at"))
    assert with_period(probe, "at", periods(spark, closed), closed, ["vintage_seq"]).count() == 0
