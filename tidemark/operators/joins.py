"""Lookups against a side whose size is measured, appends and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Params


def fits_broadcast(side: DataFrame, max_rows: int) -> bool:
    """Count the side. Every task counts its own rows, so one row per task moves."""
    return side.count() <= max_rows


def lookup_join(facts: DataFrame, side: DataFrame, on: Column, params: Params, how: str = "left") -> DataFrame:
    """Join facts to a lookup side on a condition that holds equalities.

    A side within ``params.broadcast_max_rows`` is broadcast and the facts do
    not move. A larger one is joined by shuffle; there the adaptive skew join
    splits the partition of a key that holds a third of the facts and repeats
    only the side rows of that partition (``cluster_settings`` forces it).
    Counting runs a job, so hand in sides that are stored.
    """
    if how not in ("inner", "left"):
        raise ValueError("a lookup keeps or drops unmatched facts: use inner or left")
    if fits_broadcast(side, params.broadcast_max_rows):
        side = F.broadcast(side)
    return facts.join(side, on, how)


def append_new(target: DataFrame, batch: DataFrame, key: str = "request_id") -> DataFrame:
    """First state wins: rows whose key is already there are skipped."""
    return target.unionByName(batch.join(target.select(key).distinct(), key, "left_anti"))


def upsert(target: DataFrame, batch: DataFrame, key: str = "request_id") -> DataFrame:
    """Last state wins: rows whose key comes again are replaced."""
    return target.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def orphans(facts: DataFrame, side: DataFrame, key: str, side_key: str | None = None) -> DataFrame:
    """Keys that the side does not hold, with the rows that carry them.

    Facts are counted per key before the join, so no key is hot in the shuffle.
    """
    known = side.select(F.col(side_key or key).alias(key)).distinct()
    counted = facts.groupBy(key).agg(F.count(F.lit(1)).alias("orphan_rows"))
    return counted.join(known, key, "left_anti")
