"""Comparing two captures by digests, so that only what differs is joined.

A capture is cut into buckets of its key. A bucket's digest is its number of rows and two
sums over hashes of its rows, which no order of rows changes; groups of buckets have digests
over those of their buckets. Two captures are compared from the groups down, and only rows of
buckets that differ are shuffled and joined; all others are known to be equal.

Digests are computed once, when a capture is stored, so a comparison of many captures with
the next one reads small tables first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.snapshots import compare_states

#: Buckets of a group.
GROUP = 256


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(buckets)).cast("int")


def bucket_digests(capture: DataFrame, key: str, fields: Sequence[str], buckets: int) -> DataFrame:
    """bucket, n, sum_a, sum_b: counted per task before the shuffle, one row per bucket after it.

    A null and an empty text hash apart, and the field's place is part of its hash.
    """
    parts = [F.struct(F.lit(i).alias("i"), F.col(c).isNull().alias("none"), F.col(c).alias("v")) for i, c in enumerate([key, *fields])]

    def total(seed: str) -> Column:
        return F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(38,0)"))

    return capture.groupBy(bucket_of(key, buckets).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), total("a").alias("sum_a"), total("b").alias("sum_b")
    )


def differing_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Buckets whose digests are not the same in two captures, from the groups down."""

    def groups(d: DataFrame) -> DataFrame:
        own = F.xxhash64("bucket", "n", "sum_a", "sum_b").cast("decimal(38,0)")
        return d.groupBy(F.floor(F.col("bucket") / GROUP).alias("group")).agg(F.sum(own).alias("digest"))

    theirs = groups(b).select(F.col("group").alias("_group"), F.col("digest").alias("_digest"))
    apart = groups(a).join(theirs, F.col("group") == F.col("_group"), "full_outer").filter(
        ~F.col("digest").eqNullSafe(F.col("_digest"))
    ).select(F.coalesce("group", "_group").alias("group"))
    group = F.floor(F.col("bucket") / GROUP)
    mine = a.withColumn("group", group).join(apart, "group", "left_semi")
    other = b.withColumn("group", group).join(apart, "group", "left_semi").select(
        F.col("bucket").alias("_bucket"), F.struct("n", "sum_a", "sum_b").alias("_d")
    )
    return mine.join(other, F.col("bucket") == F.col("_bucket"), "full_outer").filter(
        ~F.when(F.col("bucket").isNotNull(), F.struct("n", "sum_a", "sum_b")).eqNullSafe(F.col("_d"))
    ).select(F.coalesce("bucket", "_bucket").alias("bucket"))


def diff_by_digests(
    a: DataFrame, b: DataFrame, key: str, fields: Sequence[str], buckets: int,
    digests: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """The rows of ``snapshot_diff``; only the buckets that differ are joined.

    ``digests``: those stored with the captures, else they are computed. Each key is in a
    capture once, as captures have it.
    """
    fields = list(fields)
    own, theirs = digests or (bucket_digests(a, key, fields, buckets), bucket_digests(b, key, fields, buckets))
    apart = differing_buckets(own, theirs)
    bucket = bucket_of(key, buckets)
    before = a.select(key, F.struct(*fields).alias("before"), bucket.alias("bucket"))
    after = b.select(key, F.struct(*fields).alias("after"), bucket.alias("bucket")).join(apart, "bucket", "left_semi")
    moved = before.join(apart, "bucket", "left_semi").join(after.drop("bucket"), key, "left")
    same = before.join(apart, "bucket", "left_anti").withColumn("after", F.col("before"))
    return compare_states(moved.drop("bucket").unionByName(same.drop("bucket")), key, fields)
