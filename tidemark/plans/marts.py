"""Cohort marts. Every measure is a function of one histogram of the fact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Params
from tidemark.functions import cohort_age_days, cohort_month, days, safe_ratio, seconds_between, total_seconds
from tidemark.operators.joins import lookup_join
from tidemark.operators.medians import grouped_median
from tidemark.plans import metrics

MONTH_KEYS = ["cohort_month", "agency_key", "complaint_type_key", "complaint_type", "borough"]
BI_GRAIN = [
    "cohort_month", "agency_code", "complaint_type", "descriptor",
    "complaint_type_version", "borough", "is_cohort_mature",
]


def duration_histogram(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per (keys, whole seconds to close), null seconds for open requests.

    One pass with map-side partial counts: what is shuffled has at most one row
    per task, key and duration, however many requests share them.
    """
    within = F.col("is_within_target")
    return facts.groupBy(*keys, seconds_between("created_at", "closed_at").alias("seconds")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(within).alias("on_time"),
        F.count(within).alias("judged"),
    )


def durations(facts: DataFrame, geography: DataFrame, params: Params) -> DataFrame:
    """The histogram at the grain of the monthly mart: the one scan of the fact.

    Store it: the two marts and the sensitivity report are roll-ups of it.
    """
    narrow = facts.select(
        cohort_month("created_at").alias("cohort_month"),
        "agency_key", "complaint_type_key", "complaint_type", "geography_key",
        "created_at", "closed_at", "is_within_target",
    )
    g = geography.select(F.col("geography_key").alias("_g_key"), "borough")
    placed = lookup_join(narrow, g, F.col("geography_key") == F.col("_g_key"), params, "inner")
    return duration_histogram(placed, MONTH_KEYS)


def rolled_up(histogram: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The histogram over fewer keys."""
    return histogram.groupBy(*keys, "seconds").agg(*[F.sum(c).alias(c) for c in ("n", "on_time", "judged")])


def in_window(params: Params) -> Column:
    """Closed, and within the maturity window of being created."""
    return F.col("seconds") <= F.lit(params.maturity_window_days * 86400)


def _sum_where(value: Column, when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, value)), F.lit(0))


def cohort_components(
    histogram: DataFrame,
    keys: Sequence[str],
    params: Params,
    medians: dict[str, Column],
) -> DataFrame:
    """Additive components per group, and one median column per entry.

    ``medians`` maps a column name to the condition its values satisfy. The
    counts and the middle values are brought together by one last aggregation,
    so groups with null keys need no null-safe join.
    """
    n, seconds, window = F.col("n"), F.col("seconds"), in_window(params)
    parts = histogram.groupBy(*keys).agg(
        F.sum(n).alias("request_volume"),
        _sum_where(n, seconds.isNotNull()).alias("closed_volume"),
        total_seconds(seconds, n).alias("closed_seconds"),
        _sum_where(n, window).alias("window_volume"),
        total_seconds(F.when(window, seconds), n).alias("window_seconds"),
        F.sum("on_time").alias("on_time_volume"),
        F.sum("judged").alias("judged_volume"),
    )
    added = [c for c in parts.columns if c not in keys]
    closed = histogram.filter(seconds.isNotNull()).select(*keys, "seconds", "n")
    if len(medians) == 1:
        ((name, condition),) = medians.items()
        series = closed.filter(condition).withColumn("_series", F.lit(name))
    else:
        names = F.array(*[F.when(condition, F.lit(name)) for name, condition in medians.items()])
        series = closed.withColumn("_series", F.explode(F.array_compact(names)))
    middle = grouped_median(series, [*keys, "_series"], "seconds", "n")
    both = parts.unionByName(middle, allowMissingColumns=True)
    half = F.col("median_part") * F.col("parts") / F.lit(2.0)
    return both.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in added],
        *[(F.sum(F.when(F.col("_series") == name, half)) / F.lit(86400.0)).alias(name) for name in medians],
    )


def is_mature(params: Params) -> Column:
    return cohort_age_days("cohort_month", params) >= F.lit(float(params.maturity_window_days))


def agency_month(histogram: DataFrame, params: Params) -> DataFrame:
    """Measures per cohort month, agency, type version, borough and maturity.

    The stored histogram is read three times: components, bucket counts, values
    of the middle buckets.
    """
    components = cohort_components(
        histogram, MONTH_KEYS, params, {"median_days_to_close": F.col("seconds").isNotNull()}
    )
    return metrics.measures(components.withColumn("is_cohort_mature", is_mature(params)), MONTH_KEYS)


def cohort_maturity(histogram: DataFrame, params: Params) -> DataFrame:
    """The naive duration series beside the one observed over a fixed window."""
    keys = ["cohort_month"]
    components = cohort_components(
        rolled_up(histogram, keys),
        keys,
        params,
        {"naive_median": F.col("seconds").isNotNull(), "window_median": in_window(params)},
    )
    c = F.col
    mature = c("is_cohort_mature")
    naive, matured = c("naive_mean_days_to_close"), c("matured_mean_days_to_close")
    return (
        components.withColumn("cohort_age_days_at_build", cohort_age_days("cohort_month", params))
        .withColumn("is_cohort_mature", c("cohort_age_days_at_build") >= F.lit(float(params.maturity_window_days)))
        .select(
            "cohort_month",
            "cohort_age_days_at_build",
            "is_cohort_mature",
            c("request_volume").alias("cohort_size"),
            c("closed_volume").alias("closed_so_far"),
            safe_ratio("closed_volume", "request_volume").alias("closure_rate_so_far"),
            days(safe_ratio("closed_seconds", "closed_volume")).alias("naive_mean_days_to_close"),
            c("naive_median").alias("naive_median_days_to_close"),
            F.when(mature, days(safe_ratio("window_seconds", "window_volume"))).alias("matured_mean_days_to_close"),
            F.when(mature, c("window_median")).alias("matured_median_days_to_close"),
            F.when(mature, F.lit(1.0) - safe_ratio("window_volume", "request_volume")).alias(
                "unresolved_share_at_maturity"
            ),
        )
        .withColumn("naive_understatement_days", F.when(mature, matured - naive))
        .withColumn("naive_understatement_pct", F.when(mature & (naive > 0), (matured - naive) / naive))
    )


def bi_wide(
    month: DataFrame, agency: DataFrame, type_history: DataFrame, calendar: DataFrame, params: Params
) -> DataFrame:
    """The mart with its labels resolved and its ratios made rebuildable."""
    a = agency.select(F.col("agency_key").alias("_a_key"), "agency_name")
    t = type_history.select(
        F.col("complaint_type_key").alias("_t_key"),
        "descriptor",
        F.col("owning_agency_code").alias("complaint_type_owning_agency"),
        F.col("version_number").alias("complaint_type_version"),
        F.col("is_current").alias("complaint_type_version_is_current"),
    )
    d = calendar.select(
        F.col("date_key").alias("_d_key"),
        F.col("year_month").alias("cohort_year_month"),
        F.col("calendar_year").alias("cohort_year"),
        F.col("calendar_quarter").alias("cohort_quarter"),
    )
    wide = lookup_join(month, a, F.col("agency_key") == F.col("_a_key"), params, "left")
    wide = lookup_join(wide, t, F.col("complaint_type_key") == F.col("_t_key"), params, "left")
    wide = lookup_join(wide, d, F.col("cohort_month") == F.col("_d_key"), params, "left")
    c, mature = F.col, F.col("is_cohort_mature")
    return wide.select(
        "cohort_month", "cohort_year_month", "cohort_year", "cohort_quarter",
        c("agency_key").alias("agency_code"),
        "agency_name", "complaint_type", "descriptor", "complaint_type_owning_agency",
        "complaint_type_version", "complaint_type_version_is_current", "borough", "is_cohort_mature",
        "request_volume", "closed_volume", "on_time_denominator", "backlog_open_count",
        "closure_rate", "closure_rate_at_maturity", "mean_days_to_close", "median_days_to_close",
        "mean_days_to_close_matured", "unresolved_share_at_maturity", "on_time_rate",
        days("closed_seconds").alias("days_to_close_total"),
        F.when(mature, days("window_seconds")).alias("days_to_close_matured_total"),
        F.when(mature, c("window_volume").cast("double")).alias("closed_within_window_volume"),
        F.when(c("on_time_denominator") > 0, c("on_time_volume").cast("double")).alias("on_time_numerator"),
        # exact parts, so that sums over any subset do not depend on task order
        "closed_seconds",
        F.when(mature, c("window_seconds")).alias("matured_seconds"),
    )


def in_grain_order(wide: DataFrame) -> DataFrame:
    """Total order over the grain, for an export that repeats byte for byte."""
    return wide.orderBy(*[F.col(c).asc_nulls_last() for c in BI_GRAIN])


def reaggregate(wide: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rebuild ratios and means over any subset from their additive parts."""
    return metrics.rebuild(wide, by)


def top_agencies_by_month(wide: DataFrame, n: int = 6) -> DataFrame:
    """Monthly volume of the n largest agencies, the others as one series."""
    from tidemark.operators.sampling import top_n_or_other

    return (
        top_n_or_other(wide.select("cohort_month", "agency_code", "request_volume"), "agency_code", "request_volume", n)
        .groupBy("cohort_month", "agency_code", "is_other")
        .agg(F.sum("request_volume").alias("request_volume"))
    )
