"""The landing append log: scan, write, slices, manifest and profile."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import Params
from tidemark.functions import as_ntz
from tidemark.operators.latest import latest_per_key
from tidemark.operators.sampling import systematic_sample
from tidemark.store import Store

# The source columns, in order; every one of them arrives as text.
SOURCE_COLUMNS = [
    "unique_key",
    "created_date",
    "closed_date",
    "agency",
    "agency_name",
    "complaint_type",
    "descriptor",
    "location_type",
    "incident_zip",
    "incident_address",
    "street_name",
    "address_type",
    "city",
    "status",
    "due_date",
    "resolution_action_updated_date",
    "community_board",
    "borough",
    "open_data_channel_type",
    "latitude",
    "longitude",
]
INGESTED_AT = "_ingested_at"
LANDING_COLUMNS = [*SOURCE_COLUMNS, INGESTED_AT]
LANDING_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in LANDING_COLUMNS])


def scan_ndjson(spark: SparkSession, paths: str | list[str], partitions: int | None = None) -> DataFrame:
    """Newline-delimited JSON under the declared all-text schema.

    Nothing is inferred: a month whose column is all null keeps its type. A
    gzip file cannot be split, so few large files need ``partitions`` to spread
    the rows before any wide step.
    """
    df = spark.read.schema(LANDING_SCHEMA).json(paths)
    return df.repartition(partitions) if partitions else df


def append_ndjson(df: DataFrame, where: str, ingested_at: datetime | str) -> None:
    """Stamp the rows and append them as gzip NDJSON, one folder per month slice."""
    stamped = df.withColumn(INGESTED_AT, F.lit(str(ingested_at)))
    (
        stamped.withColumn("slice", slice_label("created_date"))
        .hint("rebalance", "slice")
        .write.mode("append")
        .partitionBy("slice")
        .option("compression", "gzip")
        .json(where)
    )


def replace_slices(df: DataFrame, where: str) -> None:
    """Write whole slices: a slice pulled again replaces its earlier files, so
    a restart after a partial pull cannot leave duplicates behind."""
    (
        df.withColumn("slice", slice_label("created_date"))
        .hint("rebalance", "slice")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("slice")
        .parquet(where)
    )


def slice_label(created: str) -> Column:
    return F.substring(F.col(created), 1, 7)


def source_slice(
    df: DataFrame,
    start: Column,
    end: Column,
    created: str = "created_date",
    agencies: Iterable[str] | None = None,
    agency: str = "agency",
    columns: Iterable[str] | None = None,
) -> DataFrame:
    """Half-open window, optional agency list, chosen columns: all of it
    reaches the scan as pushed filters and a pruned schema."""
    out = df.filter((F.col(created) >= start) & (F.col(created) < end))
    if agencies is not None:
        out = out.filter(F.col(agency).isin(list(agencies)))
    return out.select(*columns) if columns is not None else out


def month_slices(spark: SparkSession, start: datetime, end: datetime) -> DataFrame:
    """Calendar months covering [start, end), clamped at both ends."""
    s, e = as_ntz(start), as_ntz(end)
    months = F.sequence(F.trunc(s.cast("date"), "MM"), F.trunc(e.cast("date"), "MM"), F.expr("interval 1 month"))
    month = F.col("month")
    return (
        spark.range(1)
        .select(F.explode(months).alias("month"))
        .select(
            F.date_format(month, "yyyy-MM").alias("slice"),
            F.greatest(month.cast("timestamp_ntz"), s).alias("slice_start"),
            F.least(F.add_months(month, 1).cast("timestamp_ntz"), e).alias("slice_end"),
        )
        .filter(F.col("slice_start") < F.col("slice_end"))
    )


def slice_counts(landing: DataFrame) -> DataFrame:
    return landing.groupBy(slice_label("created_date").alias("slice")).agg(F.count(F.lit(1)).alias("row_count"))


def landing_profile(landing: DataFrame) -> DataFrame:
    """Rows and distinct keys, overall (slice null) and per created month.

    Keys are deduplicated within (slice, key) first, so a key repeated without
    end is one row before it is shuffled.
    """
    keyed = landing.groupBy(slice_label("created_date").alias("slice"), "unique_key").agg(
        F.count(F.lit(1)).alias("n")
    )
    by_slice = keyed.groupBy("slice").agg(
        F.lit("slice").alias("scope"),
        F.sum("n").alias("row_count"),
        F.count("unique_key").alias("distinct_keys"),
    )
    whole = (
        keyed.groupBy("unique_key")
        .agg(F.sum("n").alias("n"))
        .agg(F.sum("n").alias("row_count"), F.count("unique_key").alias("distinct_keys"))
        .select(F.lit(None).cast("string").alias("slice"), F.lit("all").alias("scope"), "row_count", "distinct_keys")
    )
    columns = ["scope", "slice", "row_count", "distinct_keys"]
    return by_slice.select(columns).unionByName(whole.select(columns))


def source_aggregates(landing: DataFrame) -> DataFrame:
    """Row count and newest creation text, as asked of the source itself."""
    return landing.agg(F.count(F.lit(1)).alias("row_count"), F.max("created_date").alias("max_created_date"))


def parse_manifest(spark: SparkSession, text: str) -> DataFrame:
    """Flatten the JSON of a pull manifest to (slice, rows, complete).

    It takes the text, not a path: scans skip files whose names begin with an
    underscore, as manifests do.
    """
    entry = "struct<last_sort: string, last_key: string, rows: bigint, complete: boolean>"
    slices = F.from_json(F.lit(text), f"struct<slices: map<string, {entry}>>")["slices"]
    return (
        spark.range(1)
        .select(F.explode(slices).alias("slice", "e"))
        .select("slice", F.col("e.rows").alias("rows"), F.col("e.complete").alias("complete"))
    )


def manifest_tieout(landing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every slice with what the manifest promises and what landed."""
    landed = slice_counts(landing).withColumnRenamed("row_count", "landed_rows")
    m = manifest.select(F.col("slice").alias("m_slice"), F.col("rows").alias("manifest_rows"))
    return (
        landed.join(m, F.col("slice").eqNullSafe(F.col("m_slice")), "full_outer")
        .select(
            F.coalesce("slice", "m_slice").alias("slice"),
            F.coalesce("manifest_rows", F.lit(0)).alias("manifest_rows"),
            F.coalesce("landed_rows", F.lit(0)).alias("landed_rows"),
        )
        .withColumn("ties_out", F.col("manifest_rows") == F.col("landed_rows"))
    )


def require_complete(manifest: DataFrame) -> None:
    """Refuse to build on a partial pull."""
    open_slices = manifest.filter(~F.col("complete"))
    some = [r["slice"] for r in open_slices.select("slice").orderBy("slice").take(20)]
    if some:
        raise RuntimeError(f"pull is incomplete: {open_slices.count()} open slices, the first are {some}")


def require_tieout(tieout: DataFrame) -> None:
    off = tieout.filter(~F.col("ties_out"))
    some = [r.asDict() for r in off.orderBy("slice").take(20)]
    if some:
        raise RuntimeError(f"landed rows differ from the manifest in {off.count()} slices, the first are {some}")


def write_sample(
    landing: DataFrame, where: str, params: Params, store: Store, per_slice: int = 500
) -> DataFrame:
    """Write a systematic sample of each month slice as gzip NDJSON and answer
    its manifest, (slice, rows, complete).

    The current state is stored: positions, sample and manifest each read it."""
    current = latest_per_key(landing, "unique_key", [INGESTED_AT, "closed_date"])
    current = store.table("intermediate", "sampled_state", current)
    sliced = current.withColumn("slice", slice_label("created_date"))
    sample = systematic_sample(sliced, "slice", "unique_key", params, store, per_slice)
    sample.write.mode("overwrite").partitionBy("slice").option("compression", "gzip").json(where)
    return (
        sample.groupBy("slice").agg(F.count(F.lit(1)).alias("rows")).withColumn("complete", F.lit(True))
    )
