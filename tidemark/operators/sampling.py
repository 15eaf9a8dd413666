"""Positions within strata, systematic samples and keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Params
from tidemark.operators.joins import lookup_join
from tidemark.store import Store


def stratum_positions(
    df: DataFrame,
    stratum: str,
    key: str,
    params: Params,
    store: Store,
    partitions: int | None = None,
) -> DataFrame:
    """(stratum, key, position, stratum_size), position counted from zero.

    ``key`` must be unique within its stratum. The pairs are range-partitioned
    and stored with the number of their range, each range is ranked by itself,
    and the sizes of the ranges before it are added. So a stratum that holds a
    third of the rows is ranked by as many tasks as it fills ranges.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.select(stratum, key)
        .repartitionByRange(n, stratum, key)
        .withColumn("_range", F.spark_partition_id())
    )
    # The bounds of the ranges come from a sample, so they are fixed by storing
    # them before they are used twice.
    stored = store.table("intermediate", f"positions_{stratum}_{key}", ranged)
    before = Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = (
        stored.groupBy(F.col(stratum).alias("_s"), F.col("_range").alias("_r"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.sum("_n").over(before) - F.col("_n"))
        .withColumn("stratum_size", F.sum("_n").over(Window.partitionBy("_s")))
        .drop("_n")
    )
    offsets = store.table("intermediate", f"offsets_{stratum}_{key}", offsets)
    on = F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))
    within = Window.partitionBy("_range", stratum).orderBy(key)
    return lookup_join(stored, offsets, on, params, "inner").select(
        stratum,
        key,
        (F.row_number().over(within) - 1 + F.col("_offset")).alias("position"),
        "stratum_size",
    )


def systematic_sample(
    df: DataFrame,
    stratum: str,
    key: str,
    params: Params,
    store: Store,
    k: int = 500,
) -> DataFrame:
    """Every stride-th row of each stratum in key order, the first k of them.

    The stride is the whole part of size / k; a stratum of k rows or fewer is
    taken whole.
    """
    at = stratum_positions(df, stratum, key, params, store)
    stride = F.greatest(F.expr(f"stratum_size div {int(k)}"), F.lit(1))
    chosen = at.filter((F.col("position") % stride == 0) & (F.floor(F.col("position") / stride) < k)).select(
        F.col(stratum).alias("_s"), F.col(key).alias("_k")
    )
    chosen = store.table("intermediate", f"chosen_{stratum}_{key}", chosen)
    on = F.col(stratum).eqNullSafe(F.col("_s")) & F.col(key).eqNullSafe(F.col("_k"))
    return lookup_join(df, chosen, on, params, "inner").select(*df.columns)


def keyset_page(
    df: DataFrame,
    sort: str,
    tie: str,
    n: int,
    after: tuple[Column, Column] | None = None,
) -> DataFrame:
    """The next n rows strictly after a composite cursor, in cursor order."""
    if after is not None:
        s, t = after
        df = df.filter((F.col(sort) > s) | ((F.col(sort) == s) & (F.col(tie) > t)))
    return df.orderBy(sort, tie).limit(n)


def top_n_or_other(df: DataFrame, label: str, measure: str, n: int, other: str = "Other") -> DataFrame:
    """Relabel all but the n largest labels by their total.

    Totals hold one row per label. Ties go to the alphabetically first, a null
    label last. ``is_other`` tells the rest from a label that is spelled alike.
    """
    total = df.groupBy(label).agg(F.sum(measure).alias("_total"))
    top = (
        total.orderBy(F.desc("_total"), F.col(label).asc_nulls_last())
        .limit(n)
        .select(F.col(label).alias("_top"), F.lit(False).alias("_rest"))
    )
    rest = F.coalesce("_rest", F.lit(True))
    return (
        df.join(F.broadcast(top), F.col(label).eqNullSafe(F.col("_top")), "left")
        .withColumn("is_other", rest)
        .withColumn(label, F.when(F.col("is_other"), F.lit(other)).otherwise(F.col(label)))
        .drop("_top", "_rest")
    )
