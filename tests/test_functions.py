from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import (
    as_ntz,
    changed,
    days_between,
    norm_text,
    rounded,
    safe_double,
    safe_ratio,
    safe_timestamp,
    seconds_between,
    surrogate_key,
    total_seconds,
    within_target,
)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_text_is_trimmed_and_blank_is_missing(spark):
    rows = spark.createDataFrame([(" nypd ",), ("  ",), (None,), ("",)], "t string")
    assert [r.v for r in rows.select(norm_text("t", upper=True).alias("v")).collect()] == ["NYPD", None, None, None]


def test_only_whole_dates_become_timestamps(spark):
    texts = [
        "2025-01-05 09:00:00", "2025-01-05T09:00:00.500", "2025", "2025-09", "nonsense", "2025-13-01", None,
        "2025/1/5 9:00", " 2025-01-05 ", "2025-01-05 09", "2025-01/05",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in rows.orderBy("i").select(safe_timestamp("t").alias("v")).collect()]
    nine, half_past = datetime(2025, 1, 5, 9), datetime(2025, 1, 5, 9, 0, 0, 500000)
    assert got == [nine, half_past, None, None, None, None, None, nine, datetime(2025, 1, 5), None, None]


def test_only_numbers_become_doubles(spark):
    texts = ["40.7", "-73.9", "40.7d", "1e2", ".5", "x", " 41 "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in rows.orderBy("i").select(safe_double("t").alias("v")).collect()]
    assert got == [40.7, -73.9, None, 100.0, 0.5, None, 41.0]


def test_durations_count_second_boundaries(spark):
    assert one(spark, seconds_between(as_ntz("2025-01-01 00:00:00.9"), as_ntz("2025-01-01 00:00:02.1"))) == 2
    night = one(spark, days_between(as_ntz("2025-01-01 23:00:00"), as_ntz("2025-01-02 01:00:00")))
    assert night == 7200 / 86400


def test_durations_ignore_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        d = one(spark, days_between(as_ntz("2024-03-09 12:00:00"), as_ntz("2024-03-10 12:00:00")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert d == 1.0


def test_key_separates_null_from_its_text(spark):
    a = one(spark, surrogate_key(F.lit(None), F.lit("x")))
    b = one(spark, surrogate_key(F.lit("NULL"), F.lit("x")))
    assert a != b and a == one(spark, F.md5(F.lit("<<null>>||x")))


def test_ratio_and_rounding(spark):
    assert one(spark, safe_ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, safe_ratio(F.lit(1), F.lit(4))) == 0.25
    assert one(spark, rounded(F.lit(1.0000005))) in (1.000001, 1.0)
    assert one(spark, rounded(F.lit(-2.5), 0)) == -2.0


def test_null_counts_as_a_value_when_comparing(spark):
    assert one(spark, changed(F.lit(None), F.lit("a"))) is True
    assert one(spark, changed(F.lit(None), F.lit(None))) is False


def test_outcome_is_three_valued(spark):
    day = 86400
    rows = [(1, 29 * day, 50 * day), (2, 31 * day, 50 * day), (3, None, 31 * day), (4, None, 30 * day)]
    df = spark.createDataFrame(rows, "i int, closed long, open long")
    got = [r.v for r in df.orderBy("i").select(within_target(F.col("closed"), F.col("open"), 30).alias("v")).collect()]
    assert got == [True, False, False, None]


def test_totals_exceed_64_bits(spark):
    df = spark.createDataFrame([(300_000_000, 10**12), (1, 3)], "s long, n long")
    assert int(df.select(total_seconds("s", "n").alias("t")).first().t) == 3 * 10**20 + 3
