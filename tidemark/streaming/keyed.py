"""The merged table as keyed state: one value per request, kept in RocksDB.

Work and memory per micro-batch follow from the batch, not from the table: a row is
compared with the one state row of its key. No watermark and no time to live forget a key,
because a close may come at any time after the row it restates. What the stream emits are
changes, so a consumer never reads the table to find out what moved; the table itself is
what the state holds and is read from the checkpoint.

A batch that is repeated after a failure starts from the state of the last finished one and
replaces its own folder of changes, so a restart neither loses nor doubles a change.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import AbstractContextManager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.store import CLEAN_UP, settings

# Fixed value: the class name of Spark's own store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: The state of a key is a whole row, and rows of many keys are alike: blocks of many rows, packed by
#: zstd, take less than half the disk of Spark's own setting. A task closes its own copy of the state
#: when it has committed, or the copies of all runs stay beside the executors until a timer finds them;
#: a run of several batches loads it again for each. What a batch shuffled is removed with its end.
SETTINGS = {
    PROVIDER: ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.blockSizeKB": "64",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    CLEAN_UP: "true",
}
STATE, CHANGE, BATCH = "newest", "change", "batch_id"
NEW, RESTATED = "new", "restated"


def _key(key: str) -> list[Column]:
    """Two columns that are never null; all null keys are one key."""
    c = F.col(key).cast("string")
    return [c.isNull().alias("_absent"), F.coalesce(c, F.lit("")).alias("_key")]


def changes(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Streaming changes of the merged table: the rows, and whether the key is new or restated.

    The state of a key is its newest row with the time of the batch that brought it, and the
    time of the key's first batch. ``order`` is compared first, then every other column,
    descending with null last, which is the rule of ``latest_per_key``; of equal rows the one
    that came first stays. A batch's time is fixed in its offsets, so a repeated batch has it again;
    the clock of the driver must not be set back between two runs.
    """
    names = rows.schema.names
    compared = [*order, *[n for n in names if n not in order]]
    came = F.unix_micros(F.current_timestamp())
    newest = F.max(F.struct(*compared, (-F.col("_came")).alias("_came")))
    held = (
        rows.select("*", *_key(key), came.alias("_came"))
        .groupBy("_absent", "_key")
        .agg(newest.alias(STATE), F.min("_came").alias("_first"))
    )
    # update mode hands out every key of a batch; those it did not move are no change
    moved = held.withColumn("_now", came).filter(F.col(f"{STATE}._came") == -F.col("_now"))
    return moved.select(
        *[F.col(f"{STATE}.{n}").alias(n) for n in names],
        F.when(F.col("_first") == F.col("_now"), NEW).otherwise(RESTATED).alias(CHANGE),
    )


def rocksdb(spark: SparkSession) -> AbstractContextManager[None]:
    """The session with the RocksDB state store, which keyed state needs."""
    return settings(spark, SETTINGS)


def merge_available(rows: DataFrame, target: str, checkpoint: str, key: str, order: Sequence[str], after_write=None) -> None:
    """Merge everything that has arrived, then stop. Changes go to a folder per batch of ``target``.

    ``after_write``: called with the batch id once its changes are written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/{BATCH}={batch_id}")
        if after_write is not None:
            after_write(batch_id)

    with rocksdb(rows.sparkSession):
        query = (
            changes(rows, key, order)
            .writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def read_changes(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """All changes with their batch."""
    full = T.StructType([*schema.fields, T.StructField(CHANGE, T.StringType()), T.StructField(BATCH, T.LongType())])
    return spark.read.schema(full).option("basePath", target).parquet(f"{target}/{BATCH}=*")


def read_state(spark: SparkSession, checkpoint: str, schema: T.StructType) -> DataFrame:
    """The merged table: the state as the last finished batch left it."""
    with rocksdb(spark):
        # the state of an aggregate names each value by its function
        held = spark.read.format("statestore").load(checkpoint)
        return held.select(*[F.col(f"value.max.{f.name}").cast(f.dataType).alias(f.name) for f in schema.fields])
