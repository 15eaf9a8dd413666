"""Dimensions of the star, each with a member for what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Params
from tidemark.functions import surrogate_key
from tidemark.operators import periods as cal
from tidemark.operators import scd2
from tidemark.operators.scd2 import NO_DESCRIPTOR, OPEN_END, UNKNOWN

TYPE_KEY = ["complaint_type", "descriptor"]
# Spellings of an unknown borough.
UNKNOWN_BOROUGHS = ["UNKNOWN", "Unspecified", "UNSPECIFIED"]


def dim_agency(valid: DataFrame) -> DataFrame:
    """Type 1: the most frequent name of each code, and the unknown member.

    Rows are counted per (code, name) before anything else, so an agency with
    half of the rows arrives as one count per task and name.
    """
    names = valid.groupBy("agency_code", "agency_name").agg(F.count(F.lit(1)).alias("n"))
    # The group without a code is the unknown member, which is there even when
    # no row lacks its agency.
    nobody = names.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("agency_code"),
        F.lit(None).cast("string").alias("agency_name"),
        F.lit(0).cast("bigint").alias("n"),
    )
    # Most rows first, then a name before no name, then alphabetically.
    order = F.struct(-F.col("n"), F.col("agency_name").isNull(), F.col("agency_name"))
    known = F.col("agency_code").isNotNull()
    return (
        names.unionByName(nobody)
        .groupBy("agency_code")
        .agg(
            F.min_by("agency_name", order).alias("name"),
            F.sum("n").alias("request_count"),
            F.count(F.lit(1)).alias("names"),
        )
        .select(
            F.coalesce("agency_code", F.lit(UNKNOWN)).alias("agency_key"),
            "agency_code",
            F.when(known, F.col("name")).otherwise(F.lit("Unknown or missing agency")).alias("agency_name"),
            "request_count",
            F.when(known, F.col("names")).otherwise(F.lit(0)).alias("distinct_names_seen"),
            (~known).alias("is_unknown_member"),
        )
    )


def geography_parts() -> list:
    return [F.coalesce(F.col(c), F.lit(UNKNOWN)).alias(c) for c in ("borough", "community_board", "incident_zip")]


def dim_geography(valid: DataFrame) -> DataFrame:
    """Type 1, one row per combination seen."""
    combos = valid.groupBy(*geography_parts()).agg(F.count(F.lit(1)).alias("request_count"))
    return combos.select(
        surrogate_key("borough", "community_board", "incident_zip").alias("geography_key"),
        "borough",
        "community_board",
        "incident_zip",
        F.col("borough").isin(UNKNOWN_BOROUGHS).alias("is_borough_unknown"),
        (F.col("incident_zip") == UNKNOWN).alias("is_zip_unknown"),
        "request_count",
    )


def dim_date(spark: SparkSession, params: Params) -> DataFrame:
    return cal.date_spine(spark, params)


def type_observations(valid: DataFrame, spans: DataFrame, params: Params) -> DataFrame:
    records = valid.filter(F.col("complaint_type").isNotNull()).select(
        "created_at",
        "complaint_type",
        F.coalesce("descriptor", F.lit(NO_DESCRIPTOR)).alias("descriptor"),
        F.coalesce("agency_code", F.lit(UNKNOWN)).alias("agency_code"),
    )
    return scd2.observe(records, spans, params, TYPE_KEY, "agency_code").select(
        "vintage_date",
        "vintage_seq",
        *TYPE_KEY,
        "owning_agency_code",
        "period_request_count",
        "distinct_agencies_in_period",
    )


def dim_complaint_type(observations: DataFrame, valid: DataFrame, spans: DataFrame, params: Params) -> DataFrame:
    """Type 2 over (type, descriptor), tracking the owning agency."""
    history = scd2.versions(observations, spans, TYPE_KEY, "owning_agency_code", "complaint_type_key")
    end = F.lit(OPEN_END).cast("timestamp_ntz")
    unknown = (
        valid.filter(F.col("complaint_type").isNull())
        .agg(F.count(F.lit(1)).alias("request_count_in_version"))
        .select(
            F.lit(UNKNOWN).alias("complaint_type_key"),
            F.lit(None).cast("string").alias("complaint_type"),
            F.lit(None).cast("string").alias("descriptor"),
            F.lit(0).alias("version_number"),
            F.lit(UNKNOWN).alias("owning_agency_code"),
            F.lit(params.window_start.date()).alias("valid_from_vintage_date"),
            F.lit("9999-12-31").cast("date").alias("valid_to_vintage_date"),
            F.lit("1900-01-01").cast("timestamp_ntz").alias("valid_from_at"),
            end.alias("valid_to_at_inclusive"),
            end.alias("valid_to_at"),
            F.lit(True).alias("is_current"),
            F.lit(0).alias("periods_covered"),
            "request_count_in_version",
            F.lit(0).cast("bigint").alias("max_distinct_agencies_in_a_period"),
            F.lit(True).alias("is_unknown_member"),
        )
    )
    return history.unionByName(unknown)
