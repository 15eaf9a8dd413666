"""Distinct counts that can be kept per slice and united: one sketch a slice.

A sketch has a fixed size (2^lg_k registers) whatever it has seen. A new or replaced slice
needs its own rows alone; any set of slices, or all of them, is counted by uniting sketches.
The relative standard error of an estimate is 1.04 / sqrt(2^lg_k). The exact count stands in
``landing_profile``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.materialized import Materialized

#: 2^14 registers: 0.8% standard error in at most 16 KB.
LG_K = 14
SKETCHES = T.StructType(
    [T.StructField("slice", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("sketch", T.BinaryType())]
)


def relative_error(lg_k: int = LG_K) -> float:
    return 1.04 / 2 ** (lg_k / 2)


def slice_sketches(rows: DataFrame, label: Column, key: str, lg_k: int = LG_K) -> DataFrame:
    """slice, rows, sketch. Null keys are counted as rows and not as keys."""
    return rows.groupBy(label.alias("slice")).agg(
        F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(F.col(key), lg_k).alias("sketch")
    )


class DistinctCounts:
    """Sketches of all slices so far, in a table that every session extends."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = Materialized(spark, path, SKETCHES, "slice", buckets=4)

    def replace(self, sketches: DataFrame) -> None:
        """Take in slices, new ones or ones that were pulled again."""
        self.table.upsert(sketches)

    def per_slice(self) -> DataFrame:
        return self.table.read().select("slice", "rows", F.hll_sketch_estimate("sketch").alias("distinct_keys"))

    def over(self, condition: Column | None = None) -> DataFrame:
        """One row for the slices that meet a condition, or for all: no key is counted twice."""
        rows = self.table.read()
        rows = rows if condition is None else rows.filter(condition)
        return rows.agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("distinct_keys"),
        )
