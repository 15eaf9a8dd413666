"""Exact grouped medians without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grouped_median(
    histogram: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    bucket_width: int = 86400,
) -> DataFrame:
    """Two rows at most per group: the middle value or values, as ``median_part``.

    Input is a histogram, one row per (keys, value) with its count, for whole
    numbers. Counts per (keys, bucket) locate the one or two buckets that hold
    the middle ranks, and only their values are ranked. So the largest thing a
    single task sorts is the distinct values of one bucket, however many rows a
    group has. The median is the average of the parts, weighted by ``parts``.
    """
    keys = list(keys)
    h = histogram.filter(F.col(value).isNotNull()).withColumn(
        "_bucket", F.floor(F.col(value) / F.lit(bucket_width)).cast("bigint")
    )
    by_bucket = h.groupBy(*keys, "_bucket").agg(F.sum(weight).alias("_in_bucket"))
    group = Window.partitionBy(*keys)
    running = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    located = (
        by_bucket.withColumn("_upto", F.sum("_in_bucket").over(running))
        .withColumn("_total", F.sum("_in_bucket").over(group))
        .withColumn("_before", F.col("_upto") - F.col("_in_bucket"))
        .withColumn("_lo", F.expr("(_total - 1) div 2"))
        .withColumn("_hi", F.expr("_total div 2"))
        .filter((F.col("_before") <= F.col("_hi")) & (F.col("_upto") > F.col("_lo")))
    )
    picked = located.select(
        *[F.col(k).alias(f"_p_{k}") for k in keys],
        F.col("_bucket").alias("_p_bucket"),
        "_before",
        "_lo",
        "_hi",
    )
    same = F.col("_bucket") == F.col("_p_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_p_{k}"))
    within = (
        Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = (
        h.join(picked, same)
        .withColumn("_end", F.col("_before") + F.sum(weight).over(within))
        .withColumn("_start", F.col("_end") - F.col(weight))
    )
    covers_lo = (F.col("_start") <= F.col("_lo")) & (F.col("_lo") < F.col("_end"))
    covers_hi = (F.col("_start") <= F.col("_hi")) & (F.col("_hi") < F.col("_end"))
    return ranked.select(
        *keys,
        F.col(value).alias("median_part"),
        (covers_lo.cast("int") + covers_hi.cast("int")).alias("parts"),
    ).filter(F.col("parts") > 0)
