"""Report queries over the marts, each one a small DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Params
from tidemark.functions import cohort_age_days, cohort_month, days, safe_ratio, seconds_between, total_seconds
from tidemark.operators.joins import lookup_join
from tidemark.plans.staging import WARN_FLAGS
from tidemark.store import Store


def status_is_closed() -> Column:
    return F.col("status_raw") == F.lit("Closed")


def agency_performance(
    month: DataFrame, agency: DataFrame, params: Params, k: int = 15, min_volume: int | None = None
) -> DataFrame:
    """Largest agencies with their means rebuilt from components."""
    floor = params.report_min_volume if min_volume is None else min_volume
    mature = F.col("is_cohort_mature")

    def mean_days(seconds: Column, volume: Column) -> Column:
        return days(safe_ratio(F.sum(seconds), F.sum(volume)))

    per_agency = month.groupBy("agency_key").agg(
        F.sum("request_volume").alias("requests"),
        F.sum("closed_volume").alias("closed"),
        safe_ratio(F.sum("closed_volume"), F.sum("request_volume")).alias("closure_rate"),
        mean_days(F.col("closed_seconds"), F.col("closed_volume")).alias("mean_days_naive"),
        mean_days(F.when(mature, F.col("window_seconds")), F.when(mature, F.col("window_volume"))).alias(
            "mean_days_matured"
        ),
        F.sum("backlog_open_count").alias("backlog"),
    )
    top = (
        per_agency.filter(F.col("requests") >= floor)
        .orderBy(F.col("requests").desc(), "agency_key")
        .limit(k)
    )
    names = agency.select(F.col("agency_key").alias("_a_key"), "agency_name")
    return top.join(names, F.col("agency_key") == F.col("_a_key"), "left").select(
        "agency_key", "agency_name", "requests", "closed", "closure_rate",
        "mean_days_naive", "mean_days_matured", "backlog",
    )


def type_version_counts(type_history: DataFrame) -> DataFrame:
    """Versions and pairs, with and without the unknown member."""
    known = ~F.col("is_unknown_member")
    pair = F.struct("complaint_type", F.coalesce("descriptor", F.lit("")))
    return type_history.agg(
        F.count_if(known).alias("versions"),
        F.count(F.lit(1)).alias("versions_with_unknown"),
        F.count_distinct(F.when(known, pair)).alias("pairs"),
        F.count_distinct(F.when(known & (F.col("version_number") > 1), pair)).alias("multi_version_pairs"),
    )


def multi_version_pairs(type_history: DataFrame, k: int = 20) -> DataFrame:
    return (
        type_history.filter(~F.col("is_unknown_member"))
        .groupBy("complaint_type", "descriptor")
        .agg(
            F.count(F.lit(1)).alias("versions"),
            F.min("valid_from_vintage_date").alias("first_seen"),
            F.max("valid_to_vintage_date").alias("last_seen"),
            F.count_distinct("owning_agency_code").alias("distinct_owners"),
        )
        .filter(F.col("versions") > 1)
        .orderBy(F.col("versions").desc(), "complaint_type", "descriptor")
        .limit(k)
    )


def status_crosstab(facts: DataFrame) -> DataFrame:
    """Close timestamp against status text; an absent status is its own row."""
    counted = facts.groupBy("is_closed", status_is_closed().alias("source_says_closed")).agg(
        F.count(F.lit(1)).alias("requests")
    )
    # At most six rows are left here.
    whole = F.sum("requests").over(Window.partitionBy())
    return counted.withColumn("share", F.col("requests").cast("double") / whole.cast("double"))


def _agency_codes(facts: DataFrame, agency: DataFrame, params: Params) -> DataFrame:
    a = agency.select(F.col("agency_key").alias("_a_key"), "agency_code")
    return lookup_join(facts, a, F.col("agency_key") == F.col("_a_key"), params, "inner")


def status_disagreement(facts: DataFrame, agency: DataFrame, params: Params) -> DataFrame:
    """Closed by timestamp but not by status, per agency.

    Both the disagreeing rows and the agency's total come from one pass, counted
    per agency before the code is looked up. A missing status disagrees with
    nothing.
    """
    off = F.col("is_closed") & ~status_is_closed()
    seconds = seconds_between("created_at", "closed_at")
    per_agency = facts.groupBy("agency_key").agg(
        F.count_if(off).alias("disagreeing"),
        total_seconds(F.when(off, seconds)).alias("_s"),
        F.count(F.lit(1)).alias("_all"),
    )
    return (
        _agency_codes(per_agency.filter(F.col("disagreeing") > 0), agency, params)
        .select(
            "agency_code",
            "disagreeing",
            days(safe_ratio("_s", "disagreeing")).alias("mean_days"),
            safe_ratio("disagreeing", "_all").alias("share_of_agency"),
        )
        .orderBy(F.col("disagreeing").desc(), F.col("agency_code").asc_nulls_last())
    )


def status_detail(facts: DataFrame, agency: DataFrame, codes: Sequence[str], params: Params) -> DataFrame:
    per_status = (
        facts.filter(F.col("agency_key").isin(list(codes)))
        .groupBy("agency_key", "status_raw")
        .agg(F.count(F.lit(1)).alias("requests"), F.count_if("is_closed").alias("with_close_timestamp"))
    )
    return (
        _agency_codes(per_status, agency, params)
        .select("agency_code", "status_raw", "requests", "with_close_timestamp")
        .orderBy("agency_code", F.col("requests").desc(), F.col("status_raw").asc_nulls_last())
    )


def closure_rate_by_status(facts: DataFrame, code: str) -> DataFrame:
    """Closure rate of one agency under each of the two definitions."""
    closed = F.count_if(status_is_closed())
    n = F.count(F.lit(1))
    return facts.filter(F.col("agency_key") == code).agg(
        n.alias("requests"),
        closed.alias("status_closed"),
        safe_ratio(closed, n).alias("rate_by_status"),
        safe_ratio(F.count_if("is_closed"), n).alias("rate_by_timestamp"),
    )


def maturity_sensitivity(durations: DataFrame, params: Params, windows: Sequence[int] | None = None) -> DataFrame:
    """Does the direction of the corrected trend depend on the window?

    Reads the histogram of the marts, not the fact: only its counts per cohort
    and duration are repeated for each window.
    """
    windows = list(windows or params.sensitivity_windows)
    histogram = durations.groupBy("cohort_month", "seconds").agg(F.sum("n").alias("n"))
    inside = F.col("seconds") <= F.col("window_days") * 86400
    by_cohort = (
        histogram.withColumn("window_days", F.explode(F.array(*[F.lit(w) for w in windows])))
        .groupBy("window_days", "cohort_month")
        .agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("closed"),
            total_seconds(F.when(inside, F.col("seconds")), "n").alias("s"),
        )
        .withColumn("_month", F.when(cohort_age_days("cohort_month", params) >= F.col("window_days"), F.col("cohort_month")))
        .withColumn("corrected_mean", days(safe_ratio("s", "closed")))
        .withColumn("truncated", F.lit(1.0) - safe_ratio("closed", "n"))
    )
    month = F.col("_month")
    enough = F.col("mature_cohorts") >= 2
    delta = F.col("_last") - F.col("_first")
    return (
        by_cohort.groupBy("window_days")
        .agg(
            F.count(month).alias("mature_cohorts"),
            F.min(month).alias("_from"),
            F.max(month).alias("_to"),
            F.min_by("corrected_mean", month).alias("_first"),
            F.max_by("corrected_mean", month).alias("_last"),
            F.max(F.when(month.isNotNull(), F.col("truncated"))).alias("_worst"),
        )
        .select(
            "window_days",
            "mature_cohorts",
            F.when(enough, F.col("_from")).alias("first_cohort"),
            F.when(enough, F.col("_to")).alias("last_cohort"),
            F.when(enough, F.col("_first")).alias("first_mean"),
            F.when(enough, F.col("_last")).alias("last_mean"),
            F.when(enough, F.col("_worst")).alias("worst_truncated"),
            F.when(enough, delta).alias("delta"),
            F.when(~enough, F.lit("too few"))
            .when(delta > 0, F.lit("slower"))
            .when(delta <= 0, F.lit("faster"))
            .alias("direction"),
        )
    )


def flagged_but_kept(facts: DataFrame) -> DataFrame:
    counted = facts.agg(*[F.count_if(f).alias(f) for f in WARN_FLAGS], F.count(F.lit(1)).alias("_n"))
    rows = [
        F.struct(F.lit(f).alias("flag"), F.col(f).alias("rows_flagged"), F.col("_n").alias("fact_rows"))
        for f in WARN_FLAGS
    ]
    return counted.select(F.inline(F.array(*rows)))


def backlog_share(facts: DataFrame, store: Store) -> DataFrame:
    """Open backlog per agency, its share, and the share of the largest so far.

    Agencies are free text, so their number has no bound: they are ranked within
    ranges of the order, and the totals of the ranges before are added. Only one
    row per range passes through a single task.
    """
    open_count = facts.groupBy("agency_key").agg(F.count_if(~F.col("is_closed")).alias("backlog"))
    ranges = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("backlog").desc(), F.col("agency_key").asc()]
    # Bounds of ranges come from a sample; storing fixes them.
    stored = store.table(
        "intermediate",
        "backlog_ranges",
        open_count.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()),
    )
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy(F.col("_range").alias("_r"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("backlog").alias("_b"))
        .select(
            "_r",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rank"),
            F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_upto"),
            F.sum("_b").over(Window.partitionBy()).alias("_total"),
        )
    )
    within = Window.partitionBy("_range").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stored.join(F.broadcast(offsets), F.col("_range") == F.col("_r")).select(
        "agency_key",
        "backlog",
        (F.row_number().over(within) + F.col("_rank")).alias("backlog_rank"),
        safe_ratio(F.col("backlog"), "_total").alias("share"),
        safe_ratio(F.sum("backlog").over(upto) + F.col("_upto"), "_total").alias("cumulative_share"),
    )
