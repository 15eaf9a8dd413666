"""Row counts from landing to fact, with every difference named."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Step number, stage and description of the five stages.
STAGES = [
    (1, "landed_rows", "rows written to the landing table by the ingest"),
    (
        2,
        "deduplicated_to_current_state",
        "landing is an append log, one row kept per request: the latest ingestion",
    ),
    (3, "quarantined", "removed for a fatal data quality rule, itemised in the rows below"),
    (4, "valid_for_fact", "rows placed in fct_service_request"),
    (5, "reconciliation_residual", "staged minus quarantined minus valid, must be zero"),
]
REASON_STEP = 10
REASON_DESCRIPTION = "count of rows excluded under this rule"


def _counted(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")


def totals(landing: DataFrame, staged: DataFrame, quarantined: DataFrame, valid: DataFrame) -> DataFrame:
    """One row with the four counts, each taken from its own table."""
    counts = (
        _counted(landing, "landed")
        .unionByName(_counted(staged, "staged"))
        .unionByName(_counted(quarantined, "quarantined"))
        .unionByName(_counted(valid, "valid"))
    )
    names = ("landed", "staged", "quarantined", "valid")
    return counts.agg(*[F.max(F.when(F.col("what") == k, F.col("n"))).alias(k) for k in names])


def ledger(landing: DataFrame, staged: DataFrame, quarantined: DataFrame, valid: DataFrame) -> DataFrame:
    none = F.lit(None).cast("bigint")
    value = {
        1: (F.col("landed"), none),
        2: (F.col("staged"), F.col("staged") - F.col("landed")),
        3: (F.col("quarantined"), none),
        4: (F.col("valid"), F.col("valid") - F.col("staged")),
        5: (F.col("staged") - F.col("quarantined") - F.col("valid"), none),
    }
    rows = [
        F.struct(
            F.lit(step).alias("step"),
            F.lit(stage).alias("stage"),
            F.lit(text).alias("description"),
            value[step][0].alias("row_count"),
            value[step][1].alias("delta_from_previous"),
        )
        for step, stage, text in STAGES
    ]
    stages = totals(landing, staged, quarantined, valid).select(F.inline(F.array(*rows)))
    reasons = (
        quarantined.groupBy("exclusion_reason")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(
            F.lit(REASON_STEP).alias("step"),
            F.concat(F.lit("quarantine_reason: "), "exclusion_reason").alias("stage"),
            F.lit(REASON_DESCRIPTION).alias("description"),
            "row_count",
            none.alias("delta_from_previous"),
        )
    )
    return stages.unionByName(reasons).orderBy("step", "stage")


def duplicate_ingestions(landing: DataFrame) -> DataFrame:
    """Landed rows beyond the first of each key, null keys being one key.

    Our own addition: with it the collapse from landed to staged can be checked
    as well, not only reported.
    """
    return (
        landing.groupBy("unique_key")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.sum("n").alias("landed_rows"),
            F.count(F.lit(1)).alias("distinct_keys"),
            (F.sum("n") - F.count(F.lit(1))).alias("duplicate_ingestions"),
        )
    )
