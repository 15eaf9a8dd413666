"""Cutoff calendars, and finding the period an instant falls into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Params
from tidemark.functions import as_ntz

# Step of each cadence, the unit its dates truncate to, and the
# unit that periods are binned by for joining.
CADENCE = {
    "day": ("interval 1 day", "DAY", "DD"),
    "week": ("interval 7 day", "WEEK", "WEEK"),
    "month": ("interval 1 month", "MM", "MM"),
    "quarter": ("interval 3 month", "QUARTER", "MM"),
}


def _floor(day: Column, unit: str) -> Column:
    return day if unit in ("DAY", "DD") else F.trunc(day, unit)


def periods(spark: SparkSession, params: Params) -> DataFrame:
    """Vintages with the exclusive start of the period each one closes.

    The calendar is a function of the parameters alone: the last day of every
    step up to the build date, plus the build date. Each cutoff is the last
    second of its day. The list is built as one array, so no window runs over
    an unpartitioned frame.
    """
    step, unit, _ = CADENCE[params.vintage_cadence]
    first = F.lit(params.vintage_first).cast("date")
    build = F.lit(params.build_as_of.date()).cast("date")
    starts = F.sequence(_floor(F.least(first, build), unit), _floor(build, unit), F.expr(step))
    ends = F.transform(starts, lambda s: (s + F.expr(step) - F.expr("interval 1 day")).cast("date"))
    bounded = F.filter(ends, lambda d: d <= build)
    dates = F.array_sort(F.array_distinct(F.concat(bounded, F.array(build))))

    def end_of(day: Column) -> Column:
        return day.cast("timestamp_ntz") + F.expr("interval 86399 second")

    before_window = as_ntz(params.window_start) - F.expr("interval 1 second")
    return (
        spark.range(1)
        .select(dates.alias("dates"))
        .select("dates", F.posexplode("dates").alias("pos", "vintage_date"))
        .select(
            "vintage_date",
            end_of(F.col("vintage_date")).alias("vintage_cutoff_at"),
            (F.col("pos") + 1).cast("int").alias("vintage_seq"),
            (F.col("pos") + 1 == F.size("dates")).alias("is_final_vintage"),
            F.coalesce(end_of(F.get("dates", F.col("pos") - 1)), before_window).alias("period_start_at"),
        )
    )


def vintages(spark: SparkSession, params: Params) -> DataFrame:
    return periods(spark, params).drop("period_start_at")


def with_period(
    df: DataFrame,
    at: str,
    spans: DataFrame,
    params: Params,
    keep: list[str],
    how: str = "inner",
) -> DataFrame:
    """Attach columns ``keep`` of the period whose (start, cutoff] holds ``at``.

    Every period is repeated once per calendar bin that it touches, and the bin
    is the equality of the join, so no row is compared with every period. The
    repeated periods follow from the parameters and are bounded before any job
    runs; the range stays as a condition, since the last fraction of a second
    of a bin belongs to the next period.
    """
    _, _, unit = CADENCE[params.vintage_cadence]
    step = "interval 1 month" if unit == "MM" else "interval 7 day" if unit == "WEEK" else "interval 1 day"
    first_bin = _floor(F.col("period_start_at").cast("date"), unit)
    last_bin = _floor(F.col("vintage_cutoff_at").cast("date"), unit)
    bins = spans.select(
        F.col("period_start_at").alias("_from"),
        F.col("vintage_cutoff_at").alias("_to"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
        # A window that opens after the first cutoff leaves that period empty.
        F.explode(F.sequence(F.least(first_bin, last_bin), last_bin, F.expr(step))).alias("_bin"),
    )
    if params.bin_count_bound() <= params.broadcast_max_rows:
        bins = F.broadcast(bins)
    on = (
        (_floor(F.col(at).cast("date"), unit) == F.col("_bin"))
        & (F.col(at) > F.col("_from"))
        & (F.col(at) <= F.col("_to"))
    )
    kept = [F.col(f"_keep_{c}").alias(c) for c in keep]
    return df.join(bins, on, how).select(*[F.col(c) for c in df.columns], *kept)


def date_spine(spark: SparkSession, params: Params) -> DataFrame:
    """Every day of the window's years and one year either side, with labels."""
    first = F.add_months(F.trunc(F.lit(params.window_start.date()).cast("date"), "YEAR"), -12)
    last = F.add_months(F.trunc(F.lit(params.window_end.date()).cast("date"), "YEAR"), 12)
    d = F.col("date_day")
    weekday = F.dayofweek(d) - 1
    return spark.range(1).select(F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("date_day")).select(
        d.alias("date_key"),
        d,
        F.year(d).alias("calendar_year"),
        F.quarter(d).alias("calendar_quarter"),
        F.month(d).alias("calendar_month"),
        F.dayofmonth(d).alias("day_of_month"),
        weekday.alias("day_of_week"),
        F.dayofyear(d).alias("day_of_year"),
        F.weekofyear(d).alias("iso_week"),
        F.date_format(d, "yyyy-MM").alias("year_month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.trunc(d, "MM").alias("month_start_date"),
        F.trunc(d, "QUARTER").alias("quarter_start_date"),
        F.trunc(d, "YEAR").alias("year_start_date"),
        F.trunc(d, "WEEK").alias("week_start_date"),
        weekday.isin(0, 6).alias("is_weekend"),
        d.between(F.lit(params.window_start.date()), F.lit(params.window_end.date())).alias("is_in_ingest_window"),
    )
