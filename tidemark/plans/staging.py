"""Append log to typed current state, and the split into valid and quarantined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Params
from tidemark.functions import norm_text, safe_double, safe_timestamp
from tidemark.operators.latest import latest_per_key

# Landing column -> staged column, for plain text attributes.
TEXT_COLUMNS = {
    "agency_name": "agency_name",
    "complaint_type": "complaint_type",
    "descriptor": "descriptor",
    "location_type": "location_type",
    "status": "status_raw",
    "community_board": "community_board",
    "incident_zip": "incident_zip",
    "incident_address": "incident_address",
    "street_name": "street_name",
    "address_type": "address_type",
    "city": "city",
    "open_data_channel_type": "open_data_channel_type",
}
UPPER_COLUMNS = {"agency": "agency_code", "borough": "borough"}
TIME_COLUMNS = {
    "created_date": "created_at",
    "closed_date": "closed_at",
    "due_date": "due_at",
    "resolution_action_updated_date": "resolution_updated_at",
    "_ingested_at": "ingested_at",
}
FATAL_FLAGS = [
    "dq_fatal_missing_request_id",
    "dq_fatal_missing_created_at",
    "dq_fatal_closed_before_created",
]
WARN_FLAGS = [
    "dq_warn_coords_outside_nyc",
    "dq_warn_missing_complaint_type",
    "dq_warn_missing_agency",
    "dq_warn_due_before_created",
]
STAGED_COLUMNS = [
    "request_id", "created_at", "closed_at", "due_at", "resolution_updated_at", "ingested_at",
    "agency_code", "agency_name", "complaint_type", "descriptor", "location_type", "status_raw",
    "borough", "community_board", "incident_zip", "incident_address", "street_name", "address_type",
    "city", "open_data_channel_type", "latitude", "longitude", "source_updated_at",
    *FATAL_FLAGS, *WARN_FLAGS, "is_quarantined",
]
# Reasons in the order in which they claim a row.
REASONS = {
    "dq_fatal_missing_request_id": "missing_request_id",
    "dq_fatal_missing_created_at": "unparseable_or_missing_created_date",
    "dq_fatal_closed_before_created": "closed_before_created",
}
QUARANTINED_COLUMNS = [
    "request_id", "created_at", "closed_at", "agency_code", "complaint_type", "status_raw",
    "ingested_at", "exclusion_reason", *FATAL_FLAGS,
]


def current_rows(landing: DataFrame, key: str | Column = "unique_key", keep_null_keys: bool = False) -> DataFrame:
    """The latest ingestion of each key; a later close decides between equals."""
    return latest_per_key(landing, key, ["_ingested_at", "closed_date"], keep_null_keys)


def inside_box(lat: Column, lon: Column, params: Params) -> Column:
    return lat.between(*params.lat_bounds) & lon.between(*params.lon_bounds)


def typed(current: DataFrame) -> DataFrame:
    """Cast and clean. Drops nothing: what cannot be read becomes null."""
    return current.select(
        F.trim("unique_key").alias("request_id"),
        *[safe_timestamp(src).alias(dst) for src, dst in TIME_COLUMNS.items()],
        *[norm_text(src, upper=True).alias(dst) for src, dst in UPPER_COLUMNS.items()],
        *[norm_text(src).alias(dst) for src, dst in TEXT_COLUMNS.items()],
        safe_double("latitude").alias("_lat"),
        safe_double("longitude").alias("_lon"),
    )


def flagged(rows: DataFrame, params: Params) -> DataFrame:
    """Fatal flags bar a row from the fact; warning flags spoil one attribute."""
    c = F.col
    early_close = c("closed_at").isNotNull() & (c("closed_at") < c("created_at"))
    early_due = c("due_at").isNotNull() & (c("due_at") < c("created_at"))
    located = c("_lat").isNotNull() & c("_lon").isNotNull()
    flags = {
        "dq_fatal_missing_request_id": c("request_id").isNull() | (c("request_id") == ""),
        "dq_fatal_missing_created_at": c("created_at").isNull(),
        "dq_fatal_closed_before_created": early_close,
        "dq_warn_coords_outside_nyc": located & ~inside_box(c("_lat"), c("_lon"), params),
        "dq_warn_missing_complaint_type": c("complaint_type").isNull(),
        "dq_warn_missing_agency": c("agency_code").isNull(),
        "dq_warn_due_before_created": early_due,
    }
    with_flags = rows.withColumns(flags)
    quarantine = c(FATAL_FLAGS[0]) | c(FATAL_FLAGS[1]) | c(FATAL_FLAGS[2])
    keep_point = ~c("dq_warn_coords_outside_nyc")
    created = c("created_at")
    return with_flags.withColumns(
        {
            "latitude": F.when(keep_point, c("_lat")),
            "longitude": F.when(keep_point, c("_lon")),
            "source_updated_at": F.greatest(
                created,
                F.coalesce("resolution_updated_at", "created_at"),
                F.coalesce("closed_at", "created_at"),
            ),
            "is_quarantined": quarantine,
        }
    ).select(*STAGED_COLUMNS)


def stage(landing: DataFrame, params: Params) -> DataFrame:
    return flagged(typed(current_rows(landing)), params)


def valid(staged: DataFrame) -> DataFrame:
    return staged.filter(~F.col("is_quarantined")).drop(*FATAL_FLAGS, "is_quarantined")


def quarantined(staged: DataFrame) -> DataFrame:
    """Excluded rows under the first rule they break, so reasons add up."""
    reason = None
    for flag, text in REASONS.items():
        reason = F.when(F.col(flag), text) if reason is None else reason.when(F.col(flag), text)
    return (
        staged.filter(F.col("is_quarantined"))
        .withColumn("exclusion_reason", reason)
        .select(*QUARANTINED_COLUMNS)
    )
