"""Resolve an append log to one current row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import col


def latest_per_key(
    log: DataFrame,
    key: str | Column | Sequence[str],
    order: Sequence[str],
    keep_null_keys: bool = False,
    newest: bool = True,
) -> DataFrame:
    """Keep the row that sorts first by ``order`` descending, nulls last.

    With ``newest`` off it is the row that sorts last, so the earliest one.

    Every remaining column breaks ties, so two runs cannot choose differently.
    The filter on the rank is applied per input partition before the shuffle as
    well as after it, so a key that holds a third of the log moves one row per
    task. Rows without a key count as one key unless ``keep_null_keys`` is set.
    """
    keys = [col(key)] if isinstance(key, (str, Column)) else [col(k) for k in key]
    rest = [c for c in log.columns if c not in order]
    own = {key} if isinstance(key, str) else set() if isinstance(key, Column) else set(key)
    total = [
        F.col(c).desc_nulls_last() if newest else F.col(c).asc_nulls_first() for c in [*order, *rest] if c not in own
    ]

    def first_of_each(rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*total))
        return rows.withColumn("_rn", rank).filter(F.col("_rn") == 1).drop("_rn")

    if not keep_null_keys:
        return first_of_each(log)
    return first_of_each(log.filter(keys[0].isNotNull())).unionByName(log.filter(keys[0].isNull()))


def paired_states(
    log: DataFrame,
    key: str,
    order: Sequence[str],
    fields: Sequence[str],
    upto: str,
) -> DataFrame:
    """Two states of each key from one shuffle of the log: the latest of the
    rows whose leading order column is at most ``upto``, and the latest of all.

    Only the order columns and the fields are read; the fields break ties of the
    order, null counting as the smallest. Both states are maxima, so every task
    sends one row per key however often it repeats.
    """
    stamp = F.col(order[0])
    row = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.struct(*fields).alias("row"))
    both = log.groupBy(key).agg(F.max(F.when(stamp <= F.lit(upto), row)).alias("_b"), F.max(row).alias("_a"))
    return both.select(key, F.col("_b.row").alias("before"), F.col("_a.row").alias("after"))
