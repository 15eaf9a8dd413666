"""Append-only and merged tables fed by micro-batches.

A table is a folder of immutable batch folders. A batch is written under its
own id, so one that is repeated after a failure replaces itself, and nothing is
overwritten while it is read. No watermark drops state: a close may come at any
time after the row it restates.

Work per batch does not grow with the number of batches. Append-only rows lie in
buckets of their key, and a batch looks only into the buckets it touches, at the
key column. Every few batches the merged table settles into a base; a reader
takes the newest base and the batches after it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.latest import latest_per_key
from tidemark.store import ROWS_PER_FILE

BATCH, BASE, BUCKET = "batch_id", "base_id", "key_bucket"


def _ids(spark: SparkSession, target: str, kind: str) -> list[int]:
    """Ids of the complete folders of a kind."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{kind}=*/_SUCCESS")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in fs.globStatus(path) or [])


def _batches(spark: SparkSession, target: str, schema: T.StructType, buckets: bool = False) -> DataFrame:
    extra = [T.StructField(BATCH, T.LongType()), *([T.StructField(BUCKET, T.IntegerType())] if buckets else [])]
    with_batch = T.StructType([*schema.fields, *extra])
    return spark.read.schema(with_batch).option("basePath", target).parquet(f"{target}/{BATCH}=*")


def _write(df: DataFrame, target: str, batch: int, kind: str = BATCH) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{target}/{kind}={batch}")


def _refuse_fresh_checkpoint(spark: SparkSession, target: str, batch_id: int) -> None:
    """A first batch over a table that has later ones comes from a lost checkpoint."""
    if batch_id == 0 and any(i > 0 for i in _ids(spark, target, BATCH)):
        raise RuntimeError(f"{target} holds later batches: a fresh checkpoint would overwrite its first")


def append_only_sink(
    target: str, key: str, order: Sequence[str], schema: T.StructType, buckets: int = 64
) -> Callable[[DataFrame, int], None]:
    """First state wins. Of earlier batches only the key column in the touched buckets is read."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _refuse_fresh_checkpoint(spark, target, batch_id)
        bucket = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(buckets)).cast("int")
        first = latest_per_key(batch, key, order, newest=False).withColumn(BUCKET, bucket)
        if batch_id > 0:
            # at most ``buckets`` numbers
            touched = [r[0] for r in batch.select(bucket).distinct().collect()]
            held = (
                _batches(spark, target, schema, buckets=True)
                .filter((F.col(BATCH) < batch_id) & F.col(BUCKET).isin(touched))
                .select(F.col(key).alias("_held"))
            )
            first = first.join(held, F.col(key).eqNullSafe(F.col("_held")), "left_anti")
        first.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{target}/{BATCH}={batch_id}")

    return apply


def merge_sink(
    target: str, key: str, order: Sequence[str], schema: T.StructType | None = None, settle_every: int = 16
) -> Callable[[DataFrame, int], None]:
    """Last state wins. A batch is stored in its own latest state; every ``settle_every``
    batches all versions so far are settled into a base."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _refuse_fresh_checkpoint(spark, target, batch_id)
        _write(latest_per_key(batch, key, order), target, batch_id)
        if (batch_id + 1) % settle_every == 0:
            settled = read_merged(spark, target, schema or batch.schema, key, order, upto=batch_id)
            _write(settled, target, batch_id, BASE)

    return apply


def run_available(
    source: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str
) -> None:
    """Feed everything that has arrived to the sink, then stop."""
    query = (
        source.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_append_only(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    return _batches(spark, target, schema, buckets=True).drop(BATCH, BUCKET)


def read_merged(
    spark: SparkSession, target: str, schema: T.StructType, key: str, order: Sequence[str], upto: int | None = None
) -> DataFrame:
    """Current state: the newest version of each key over the newest base and the batches after it."""
    bases = [b for b in _ids(spark, target, BASE) if upto is None or b < upto]
    base = bases[-1] if bases else -1
    rows = _batches(spark, target, schema).filter(F.col(BATCH) > base).drop(BATCH)
    if bases:
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{target}/{BASE}={base}"))
    return latest_per_key(rows, key, order)


def first_seen_stream(rows: DataFrame, key: str = "request_id") -> DataFrame:
    """Append-only as a stateful stream, for sources that deliver one state of
    a key per micro-batch. Its state keeps every key for ever, so run it on the
    RocksDB state store."""
    return rows.dropDuplicates([key])
