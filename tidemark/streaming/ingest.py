"""Resumable ingest: files that arrive become rows of the landing log once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.landing import LANDING_SCHEMA, slice_label

BATCH = "batch_id"


def ingest_available(
    spark: SparkSession,
    arrivals: str,
    landing: str,
    checkpoint: str,
    files_per_batch: int | None = None,
) -> None:
    """Append every file not seen before to the landing log, then stop.

    The checkpoint is the per-file progress. A run that dies is repeated by
    calling this again: finished batches are skipped and the unfinished one is
    replaced as a whole, so a restart neither loses nor doubles rows.
    """
    reader = spark.readStream.schema(LANDING_SCHEMA).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        reader.json(arrivals)
        .withColumn("slice", F.coalesce(slice_label("created_date"), F.lit("none")))
        .writeStream.format("parquet")
        .partitionBy("slice")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(landing)
    )
    query.awaitTermination()


def landed(spark: SparkSession, landing: str) -> DataFrame:
    """The landing log as the stream's own commit log lists it."""
    return spark.read.parquet(landing)


def ingest_slices(
    spark: SparkSession,
    arrivals: str,
    landing: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    after_rows: Callable[[int], None] | None = None,
) -> None:
    """Append every file not seen before, with the progress of each slice, then stop.

    A micro-batch writes its rows and then what they add to each slice, both into folders of
    its own number; only a batch with both is read. One that dies in between is repeated and
    replaces what it left, so rows and progress agree after every batch. ``after_rows`` is
    called with the batch's number between the two.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("slice", F.coalesce(slice_label("created_date"), F.lit("none")))
        rows.write.mode("overwrite").parquet(f"{landing}/rows/{BATCH}={batch_id}")
        if after_rows is not None:
            after_rows(batch_id)
        # counted from what was written, so the two cannot differ
        stored = spark.read.schema(rows.schema).parquet(f"{landing}/rows/{BATCH}={batch_id}")
        cursor = F.max(F.struct(F.col("created_date").alias("s"), F.col("unique_key").alias("k")))
        added = stored.groupBy("slice").agg(F.count(F.lit(1)).alias("rows"), cursor.alias("last"))
        added.select("slice", "rows", F.col("last.s").alias("last_sort"), F.col("last.k").alias("last_key")).coalesce(
            1
        ).write.mode("overwrite").parquet(f"{landing}/progress/{BATCH}={batch_id}")

    reader = spark.readStream.schema(LANDING_SCHEMA).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        reader.json(arrivals)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _finished(spark: SparkSession, landing: str) -> list[int]:
    """Batches whose progress is written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{landing}/progress/{BATCH}=*/_SUCCESS")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in fs.globStatus(path) or [])


def landed_slices(spark: SparkSession, landing: str) -> DataFrame:
    """The rows of all finished batches, with their slice."""
    schema = T.StructType([*LANDING_SCHEMA.fields, T.StructField("slice", T.StringType())])
    paths = [f"{landing}/rows/{BATCH}={n}" for n in _finished(spark, landing)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def slice_manifest(spark: SparkSession, landing: str, expected: DataFrame | None = None) -> DataFrame:
    """The manifest of all finished batches: slice, rows, last_sort, last_key, complete.

    ``expected``: slice and rows as the source counts them. A slice is complete once as many
    have landed; one that is expected and has not begun is there with no rows. Without it
    every slice counts as complete.
    """
    paths = [f"{landing}/progress/{BATCH}={n}" for n in _finished(spark, landing)]
    shape = "slice string, rows bigint, last_sort string, last_key string"
    added = spark.read.schema(shape).parquet(*paths) if paths else spark.createDataFrame([], shape)
    last = F.max(F.struct("last_sort", "last_key"))
    have = added.groupBy("slice").agg(F.sum("rows").alias("rows"), last.alias("_last"))
    have = have.select("slice", "rows", "_last.last_sort", "_last.last_key")
    if expected is None:
        return have.withColumn("complete", F.lit(True))
    want = expected.select(F.col("slice").alias("_slice"), F.col("rows").alias("_rows"))
    both = have.join(want, F.col("slice") == F.col("_slice"), "full_outer")
    return both.select(
        F.coalesce("slice", "_slice").alias("slice"), F.coalesce("rows", F.lit(0)).alias("rows"), "last_sort", "last_key",
        (F.coalesce("rows", F.lit(0)) >= F.coalesce("_rows", F.lit(0))).alias("complete"),
    )
