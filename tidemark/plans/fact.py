"""The fact: one row per valid request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Params
from tidemark.functions import as_ntz, days, seconds_between, surrogate_key, within_target
from tidemark.operators.scd2 import NO_DESCRIPTOR, UNKNOWN, as_of_lookup
from tidemark.plans.dimensions import geography_parts
from tidemark.plans.staging import WARN_FLAGS

FACT_COLUMNS = [
    "request_id",
    "created_date_key", "closed_date_key", "agency_key", "complaint_type_key", "geography_key",
    "created_at", "closed_at", "due_at", "resolution_updated_at", "ingested_at", "source_updated_at",
    "complaint_type", "descriptor", "status_raw", "location_type", "open_data_channel_type",
    "latitude", "longitude",
    "is_closed", "days_to_close", "age_days", "is_mature_at_build", "is_within_target",
    *WARN_FLAGS,
]


def fact_service_request(valid: DataFrame, type_history: DataFrame, params: Params) -> DataFrame:
    """Attach keys and durations. Each request takes the version of its type
    that was in force when it was created, or the unknown member."""
    rows = valid.select(
        "request_id",
        "created_at", "closed_at", "due_at", "resolution_updated_at", "ingested_at", "source_updated_at",
        "complaint_type", "descriptor", "status_raw", "location_type", "open_data_channel_type",
        "latitude", "longitude",
        F.to_date("created_at").alias("created_date_key"),
        F.to_date("closed_at").alias("closed_date_key"),
        F.coalesce("agency_code", F.lit(UNKNOWN)).alias("agency_key"),
        surrogate_key(*geography_parts()).alias("geography_key"),
        *WARN_FLAGS,
    )
    keyed = as_of_lookup(
        rows,
        type_history.filter(~F.col("is_unknown_member")),
        {
            "complaint_type": F.col("complaint_type"),
            "descriptor": F.coalesce("descriptor", F.lit(NO_DESCRIPTOR)),
        },
        at="created_at",
        take="complaint_type_key",
        params=params,
    )
    to_close = seconds_between("created_at", "closed_at")
    to_build = seconds_between(F.col("created_at"), as_ntz(params.build_as_of))
    return keyed.withColumns(
        {
            "complaint_type_key": F.coalesce("complaint_type_key", F.lit(UNKNOWN)),
            "is_closed": F.col("closed_at").isNotNull(),
            "days_to_close": days(to_close),
            "age_days": days(F.coalesce(to_close, to_build)),
            "is_mature_at_build": days(to_build) >= F.lit(float(params.maturity_window_days)),
            "is_within_target": within_target(to_close, to_build, params.sla_target_days),
        }
    ).select(*FACT_COLUMNS)
