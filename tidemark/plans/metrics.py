"""The metric registry. The mart is built from it, so neither can have a
measure that the other lacks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import days, safe_ratio


@dataclass(frozen=True)
class Metric:
    name: str
    label: str
    numerator: str
    denominator: str
    filters: str
    caveat: str
    expression: Column | None = None
    grain: str = "agency, complaint type, borough, created month"


def registry() -> list[Metric]:
    c = F.col
    mature = c("is_cohort_mature")
    window_rate = safe_ratio("window_volume", "request_volume")
    return [
        Metric(
            "request_volume", "Request volume", "requests created in the month", "none", "none",
            "One large agency can be most of a total; split before comparing.",
            c("request_volume"),
        ),
        Metric(
            "closed_volume", "Closed volume", "requests of the cohort with a close", "none", "none",
            "By month of creation, not by month of closing.",
            c("closed_volume"),
        ),
        Metric(
            "closure_rate", "Closure rate", "closed_volume", "request_volume", "none",
            "Old cohorts had longer to close; compare only equal maturity.",
            safe_ratio("closed_volume", "request_volume"),
        ),
        Metric(
            "closure_rate_at_maturity", "Closure rate at maturity", "closed within the window",
            "request_volume", "mature cohorts",
            "Null, not low, for a cohort that is too young.",
            F.when(mature, window_rate),
        ),
        Metric(
            "mean_days_to_close", "Mean days to close, naive", "days of closed requests", "closed_volume",
            "closed", "Reads low for young cohorts, whose slow requests are still open.",
            days(safe_ratio("closed_seconds", "closed_volume")),
        ),
        Metric(
            "median_days_to_close", "Median days to close", "none", "none", "closed",
            "Cannot be rebuilt from parts; compute it from the fact.",
            c("median_days_to_close"),
        ),
        Metric(
            "mean_days_to_close_matured", "Mean days to close, corrected", "days of closes in the window",
            "closes in the window", "mature cohorts",
            "Leaves out the slow tail; read with unresolved_share_at_maturity.",
            F.when(mature, days(safe_ratio("window_seconds", "window_volume"))),
        ),
        Metric(
            "unresolved_share_at_maturity", "Unresolved share at maturity", "not closed within the window",
            "request_volume", "mature cohorts", "The share that the corrected mean leaves out.",
            F.when(mature, F.lit(1.0) - window_rate),
        ),
        Metric(
            "backlog_open_count", "Open backlog", "requests without a close", "none", "none",
            "A stock at the build instant; does not add up over months.",
            c("request_volume") - c("closed_volume"),
        ),
        Metric(
            "on_time_rate", "On-time rate", "outcomes that met the target", "outcomes known", "outcome known",
            "One target for all; open requests inside it count on neither side.",
            safe_ratio("on_time_volume", "judged_volume"),
        ),
    ]


# Columns of the mart that support a metric without being one: the exact parts
# of its ratios. Seconds stay whole, so sums of them are exact.
SUPPORT = {
    "on_time_denominator": "judged_volume",
    "on_time_volume": "on_time_volume",
    "closed_seconds": "closed_seconds",
    "window_volume": "window_volume",
    "window_seconds": "window_seconds",
}

CONVENTIONS = {
    "reopened_requests": "A reopened request counts once and lasts until its final close.",
    "cohort_versus_period": "Requests belong to the month of their creation, always.",
    "duration_units": "Durations are fractional days from differences in seconds.",
    "null_handling": "An open request has no duration; it is not a zero.",
}


def measures(components: DataFrame, keys: Sequence[str]) -> DataFrame:
    return components.select(
        *keys,
        "is_cohort_mature",
        *[m.expression.alias(m.name) for m in registry()],
        *[F.col(src).alias(name) for name, src in SUPPORT.items()],
    )


def parity(mart: DataFrame, keys: Sequence[str]) -> dict[str, list[str]]:
    """Metrics without a column, and measure columns without a metric."""
    columns = set(mart.columns) - set(keys) - {"is_cohort_mature"} - set(SUPPORT)
    documented = {m.name for m in registry()}
    return {"missing": sorted(documented - columns), "undocumented": sorted(columns - documented)}


def as_frame(spark: SparkSession) -> DataFrame:
    rows = [(m.name, m.label, m.grain, m.numerator, m.denominator, m.filters, m.caveat) for m in registry()]
    return spark.createDataFrame(
        rows, "name string, label string, grain string, numerator string, denominator string, filters string, caveat string"
    )


def rebuild(wide: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ratios over any subset: sums of parts first, then one division."""
    s = {
        c: F.sum(c)
        for c in (
            "request_volume", "closed_volume", "backlog_open_count", "closed_seconds", "matured_seconds",
            "closed_within_window_volume", "on_time_numerator", "on_time_denominator",
        )
    }

    def ratio(a: str, b: str) -> Column:
        return safe_ratio(s[a], s[b])

    return wide.groupBy(*by).agg(
        s["request_volume"].alias("request_volume"),
        s["closed_volume"].alias("closed_volume"),
        s["backlog_open_count"].alias("backlog_open_count"),
        ratio("closed_volume", "request_volume").alias("closure_rate"),
        days(ratio("closed_seconds", "closed_volume")).alias("mean_days"),
        days(ratio("matured_seconds", "closed_within_window_volume")).alias("mean_days_matured"),
        ratio("on_time_numerator", "on_time_denominator").alias("on_time_rate"),
    )
