"""Data assertions. A check reports how many rows break it; zero passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import accepted
from tidemark.operators import scd2
from tidemark.plans import metrics
from tidemark.plans.marts import MONTH_KEYS
from tidemark.plans.staging import REASONS, inside_box
from tidemark.plans.warehouse import Warehouse

ERROR, WARN = "error", "warn"
RATES = ["closure_rate", "closure_rate_at_maturity", "on_time_rate", "unresolved_share_at_maturity"]


def row_checks(df: DataFrame, table: str, conditions: dict[str, tuple[str, Column]]) -> DataFrame:
    """Any number of row conditions in one pass; the condition is the failure."""
    counted = df.agg(*[F.count_if(cond).alias(f"c{i}") for i, (_, cond) in enumerate(conditions.values())])
    rows = [
        F.struct(
            F.lit(f"{table}.{name}").alias("check_name"),
            F.lit(severity).alias("severity"),
            F.col(f"c{i}").alias("failures"),
        )
        for i, (name, (severity, _)) in enumerate(conditions.items())
    ]
    return counted.select(F.inline(F.array(*rows)))


def not_null(*columns: str, severity: str = ERROR) -> dict[str, tuple[str, Column]]:
    return {f"{c}.not_null": (severity, F.col(c).isNull()) for c in columns}


def accepted_values(column: str, values: list[str], severity: str = ERROR) -> dict[str, tuple[str, Column]]:
    return {f"{column}.accepted_values": (severity, ~accepted(column, values))}


def unique(df: DataFrame, table: str, column: str, severity: str = ERROR) -> DataFrame:
    """Values held by more than one row. Partial counts absorb a hot value."""
    repeated = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )
    return _result(f"{table}.{column}.unique", severity, repeated)


def unique_not_null(df: DataFrame, table: str, column: str, severity: str = ERROR) -> DataFrame:
    """Both assertions on a key column from one pass."""
    n, present = F.col("n"), F.col(column).isNotNull()
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    totals = counted.agg(
        F.coalesce(F.sum(F.when(~present, n)), F.lit(0)).alias("not_null"),
        F.count_if(present & (n > 1)).alias("unique"),
    )
    rows = [
        F.struct(
            F.lit(f"{table}.{column}.{kind}").alias("check_name"),
            F.lit(severity).alias("severity"),
            F.col(kind).alias("failures"),
        )
        for kind in ("not_null", "unique")
    ]
    return totals.select(F.inline(F.array(*rows)))


def _result(name: str, severity: str, failing: DataFrame) -> DataFrame:
    return failing.agg(F.count(F.lit(1)).alias("failures")).select(
        F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), "failures"
    )


def current_versions_above_one(history: DataFrame) -> DataFrame:
    return (
        history.filter(F.col("is_current") & ~F.col("is_unknown_member"))
        .groupBy("complaint_type", "descriptor")
        .agg(F.count(F.lit(1)).alias("current_versions"))
        .filter(F.col("current_versions") > 1)
    )


def retired_but_current(history: DataFrame, observations: DataFrame, periods: DataFrame) -> DataFrame:
    """Pairs with an open version although the last period has no row of them."""
    final = periods.filter("is_final_vintage").select("vintage_seq")
    active = observations.join(F.broadcast(final), "vintage_seq", "left_semi").select("complaint_type", "descriptor")
    return history.filter(F.col("is_current") & ~F.col("is_unknown_member")).join(
        active, ["complaint_type", "descriptor"], "left_anti"
    )


def out_of_bounds(rate: str) -> Column:
    """A missing rate passes."""
    return F.coalesce(~F.col(rate).between(0, 1), F.lit(False))


def fact_checks(w: Warehouse, facts: DataFrame) -> DataFrame:
    """All conditions on a fact row, its keys and its version, from one scan.

    The dimensions are joined once each on their distinct keys, so no row is
    multiplied; a missing partner or a version not in force is then a condition
    like any other. The planner knows the sizes of the stored dimensions.
    """
    p = w.params
    sides = {
        "agency_key": w.dim_agency.select(F.col("agency_key").alias("_agency_key")).distinct(),
        "geography_key": w.dim_geography.select(F.col("geography_key").alias("_geography_key")).distinct(),
        "created_date_key": w.dim_date.select(F.col("date_key").alias("_created_date_key")).distinct(),
        "complaint_type_key": w.dim_complaint_type.groupBy(F.col("complaint_type_key").alias("_complaint_type_key")).agg(
            F.collect_list(F.struct("is_unknown_member", "valid_from_at", "valid_to_at")).alias("_versions")
        ),
    }
    rows = facts.select(
        "request_id", "agency_key", "complaint_type_key", "geography_key", "created_date_key", "created_at",
        "closed_at", "is_closed", "latitude", "longitude", "days_to_close", "age_days",
    )
    for key, side in sides.items():
        rows = rows.join(side, F.col(key) == F.col(f"_{key}"), "left")
    outside = (
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
        & ~inside_box(F.col("latitude"), F.col("longitude"), p)
    )
    made = F.col("created_at")
    not_in_force = F.exists(
        "_versions",
        lambda v: ~v["is_unknown_member"] & ~((made > v["valid_from_at"]) & (made <= v["valid_to_at"])),
    )
    return row_checks(
        rows,
        "fct_service_request",
        {
            **not_null(
                "request_id", "agency_key", "complaint_type_key", "geography_key",
                "created_date_key", "created_at", "is_closed",
            ),
            "coordinates_inside_box": (ERROR, outside),
            "no_closed_before_created": (ERROR, F.col("closed_at") < made),
            "no_negative_durations": (ERROR, (F.col("days_to_close") < 0) | (F.col("age_days") < 0)),
            **{f"{key}.relationships": (ERROR, F.col(key).isNotNull() & F.col(f"_{key}").isNull()) for key in sides},
            "version_in_force_at_creation": (ERROR, not_in_force),
        },
    )


def staged_checks(w: Warehouse, facts: DataFrame) -> DataFrame:
    """Uniqueness in the staged rows and their two parts, and the row counts that
    must agree, from one count per request id over staged rows and fact together."""
    kinds = {
        "stg_service_requests": F.col("part") != "fact",
        "int_requests_valid": F.col("part") == "valid",
        "int_requests_quarantined": F.col("part") == "quarantined",
        "fct_service_request": F.col("part") == "fact",
    }
    part = F.when(F.col("is_quarantined"), F.lit("quarantined")).otherwise(F.lit("valid"))
    ids = w.staged.select("request_id", part.alias("part")).unionByName(
        facts.select("request_id", F.lit("fact").alias("part"))
    )
    counted = ids.groupBy("request_id").agg(*[F.count_if(cond).alias(f"n{i}") for i, cond in enumerate(kinds.values())])
    present = F.col("request_id").isNotNull()
    totals = counted.agg(
        *[F.count_if(present & (F.col(f"n{i}") > 1)).alias(f"c{i}") for i in range(len(kinds))],
        F.abs(F.coalesce(F.sum("n3"), F.lit(0)) - F.coalesce(F.sum("n1"), F.lit(0))).alias("apart"),
    )
    rows = [
        F.struct(F.lit(f"{table}.request_id.unique").alias("check_name"), F.lit(ERROR).alias("severity"), F.col(f"c{i}").alias("failures"))
        for i, table in enumerate(kinds)
    ]
    rows.append(
        F.struct(
            F.lit("fct_service_request.rows_match_valid").alias("check_name"),
            F.lit(ERROR).alias("severity"),
            F.col("apart").alias("failures"),
        )
    )
    return totals.select(F.inline(F.array(*rows)))


def parity_check(w: Warehouse) -> DataFrame:
    """Metrics without a column and columns without a metric, as a row like the others."""
    found = metric_parity(w)
    return w.agency_month.limit(0).agg(
        (F.count(F.lit(1)) + F.lit(sum(map(len, found.values())))).alias("failures")
    ).select(F.lit("mart_agency_month.metric_parity").alias("check_name"), F.lit(ERROR).alias("severity"), "failures")


def tieout_check(tieout: DataFrame) -> DataFrame:
    """Slices whose landed rows are not those of the manifest."""
    return _result("landing.manifest_ties_out", ERROR, tieout.filter(~F.col("ties_out")))


def run_checks(w: Warehouse, comparison: bool = True, tieout: DataFrame | None = None) -> DataFrame:
    """Every assertion of the build as (check_name, severity, failures).

    The fact is read twice: for the conditions on its rows and for its ids.
    """
    facts, history, month = w.fact, w.dim_complaint_type, w.agency_month
    results = [
        row_checks(
            w.staged,
            "stg_service_requests",
            {
                **not_null("request_id", "source_updated_at"),
                **not_null("created_at", severity=WARN),
            },
        ),
        staged_checks(w, facts),
        row_checks(w.valid, "int_requests_valid", not_null("request_id", "created_at")),
        row_checks(
            w.quarantined,
            "int_requests_quarantined",
            {**not_null("exclusion_reason"), **accepted_values("exclusion_reason", list(REASONS.values()))},
        ),
        fact_checks(w, facts),
        unique_not_null(w.dim_agency, "dim_agency", "agency_key"),
        unique_not_null(w.dim_geography, "dim_geography", "geography_key"),
        unique_not_null(w.dim_date, "dim_date", "date_key"),
        row_checks(
            history,
            "dim_complaint_type",
            not_null("complaint_type_key", "is_current", "valid_from_at", "valid_to_at"),
        ),
        unique(history, "dim_complaint_type", "complaint_type_key"),
        _result("dim_complaint_type.at_most_one_current", ERROR, current_versions_above_one(history)),
        _result(
            "dim_complaint_type.retired_has_none_current",
            ERROR,
            retired_but_current(history, w.observations, w.periods),
        ),
        _result(
            "dim_complaint_type.versions_do_not_overlap",
            ERROR,
            scd2.overlapping(history.filter(~F.col("is_unknown_member")), ["complaint_type", "descriptor"]),
        ),
        row_checks(
            month,
            "mart_agency_month",
            {
                **not_null("cohort_month", "request_volume"),
                "rates_within_bounds": (ERROR, reduce(Column.__or__, [out_of_bounds(r) for r in RATES])),
            },
        ),
        parity_check(w),
        unique_not_null(w.cohort_maturity, "mart_cohort_maturity", "cohort_month"),
        w.ledger.filter(F.col("stage") == "reconciliation_residual").select(
            F.lit("dq_exclusion_ledger.residual_is_zero").alias("check_name"),
            F.lit(ERROR).alias("severity"),
            F.abs("row_count").alias("failures"),
        ),
    ]
    if comparison:
        merged, summary = w.merged, w.drift_summary
        results += [
            unique_not_null(merged, "fct_requests_merge", "request_id"),
            unique_not_null(summary, "comparison_drift_summary", "vintage_seq"),
        ]
    if tieout is not None:
        results.append(tieout_check(tieout))
    failures = F.col("failures").cast("bigint").alias("failures")
    return _all([r.select("check_name", "severity", failures) for r in results])


def _all(frames: list[DataFrame]) -> DataFrame:
    """Union in pairs, so that analysis does not grow with the square of the list."""
    while len(frames) > 1:
        frames = [a.union(b[0]) if b else a for a, *b in (frames[i : i + 2] for i in range(0, len(frames), 2))]
    return frames[0]


def failed(results: DataFrame) -> DataFrame:
    return results.filter((F.col("severity") == ERROR) & (F.col("failures") > 0))


def require(results: DataFrame) -> None:
    """Stop when an assertion of severity error fails."""
    broken = failed(results)
    some = [(r["check_name"], r["failures"]) for r in broken.orderBy("check_name").take(50)]
    if some:
        raise RuntimeError(f"{broken.count()} assertions failed, the first are {some}")


def metric_parity(w: Warehouse) -> dict[str, list[str]]:
    return metrics.parity(w.agency_month, MONTH_KEYS)
