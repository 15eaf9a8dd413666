"""Type 2 history from period observations, and the as-of lookup into it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Params
from tidemark.functions import changed, surrogate_key
from tidemark.operators.joins import fits_broadcast, lookup_join
from tidemark.operators.periods import with_period

# The members that stand for "missing".
UNKNOWN = "UNKNOWN"
NO_DESCRIPTOR = "<<none>>"
OPEN_END = "9999-12-31 23:59:59"


def observe(
    records: DataFrame,
    spans: DataFrame,
    params: Params,
    key: Sequence[str],
    owner: str,
    at: str = "created_at",
) -> DataFrame:
    """One row per period and key: its owner, rows and number of owners.

    The owner is the one with most rows, the alphabetically first on a tie. Rows
    are counted per owner first, with map-side partial counts; what follows
    handles at most one row per period, key and owner. Those counts are placed
    by key once, which also serves the windows of ``versions``.
    """
    placed = with_period(records, at, spans, params, ["vintage_date", "vintage_seq"])
    grain = ["vintage_date", "vintage_seq", *key]
    per_owner = placed.groupBy(*grain, owner).agg(F.count(F.lit(1)).alias("n")).repartition(*key)
    return per_owner.groupBy(*grain).agg(
        F.min_by(owner, F.struct(-F.col("n"), F.col(owner))).alias(f"owning_{owner}"),
        F.sum("n").alias("period_request_count"),
        F.count(F.lit(1)).alias("distinct_agencies_in_period"),
    )


def versions(
    observations: DataFrame,
    spans: DataFrame,
    key: Sequence[str],
    owner: str,
    surrogate: str,
) -> DataFrame:
    """Collapse observations into versions valid over (from, to].

    A version opens when the key is first seen, when it returns after a period
    without rows, and when its owner changes. One that reaches the last period
    stays open. A key has at most one row per period here, so the windows are
    bounded by the calendar, and the collapse reuses their partitioning.
    """
    key = list(key)
    bounds = spans.select("vintage_seq", "period_start_at", "vintage_cutoff_at", "is_final_vintage")
    history = Window.partitionBy(*key).orderBy("vintage_seq")
    last_seq, last_owner = F.lag("vintage_seq").over(history), F.lag(owner).over(history)
    opens = (
        last_seq.isNull() | (F.col("vintage_seq") != last_seq + 1) | changed(F.col(owner), last_owner)
    )
    numbered = (
        observations.join(bounds, "vintage_seq")
        .withColumn("_opens", opens.cast("int"))
        .withColumn(
            "version_number",
            F.sum("_opens").over(history.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        )
    )
    collapsed = numbered.groupBy(*key, "version_number").agg(
        F.min(owner).alias(owner),
        F.min("vintage_date").alias("valid_from_vintage_date"),
        F.max("vintage_date").alias("valid_to_vintage_date"),
        F.min("period_start_at").alias("valid_from_at"),
        F.max("vintage_cutoff_at").alias("valid_to_at_inclusive"),
        F.max("is_final_vintage").alias("is_current"),
        (F.max("vintage_seq") - F.min("vintage_seq") + 1).alias("periods_covered"),
        F.sum("period_request_count").alias("request_count_in_version"),
        F.max("distinct_agencies_in_period").alias("max_distinct_agencies_in_a_period"),
    )
    return collapsed.select(
        surrogate_key(*key, "version_number").alias(surrogate),
        *key,
        F.col("version_number").cast("int").alias("version_number"),
        owner,
        "valid_from_vintage_date",
        "valid_to_vintage_date",
        "valid_from_at",
        "valid_to_at_inclusive",
        F.when(F.col("is_current"), F.lit(OPEN_END).cast("timestamp_ntz"))
        .otherwise(F.col("valid_to_at_inclusive"))
        .alias("valid_to_at"),
        "is_current",
        "periods_covered",
        "request_count_in_version",
        "max_distinct_agencies_in_a_period",
        F.lit(False).alias("is_unknown_member"),
    )


def as_of_lookup(
    facts: DataFrame,
    history: DataFrame,
    match: dict[str, Column],
    at: str,
    take: str,
    params: Params,
) -> DataFrame:
    """Attach column ``take`` of the version in force at ``at``.

    ``match`` maps history columns to fact expressions. Versions of a key do not
    overlap, so a fact finds one version or none and is never multiplied. A history
    within ``params.broadcast_max_rows`` is broadcast; a larger one is carried along.
    """
    if not fits_broadcast(history, params.broadcast_max_rows):
        return carry_forward(facts, history, match, at, take)
    side = history.select(
        *[F.col(c).alias(f"_h_{c}") for c in match],
        F.col("valid_from_at").alias("_h_from"),
        F.col("valid_to_at").alias("_h_to"),
        F.col(take).alias(f"_h_{take}"),
    )
    on = (F.col(at) > F.col("_h_from")) & (F.col(at) <= F.col("_h_to"))
    for column, expression in match.items():
        on = on & (expression == F.col(f"_h_{column}"))
    found = facts.join(F.broadcast(side), on, "left")
    return found.select(*[F.col(c) for c in facts.columns], F.col(f"_h_{take}").alias(take))


def time_slots(facts: DataFrame, at: str, slots: int) -> Column:
    """An expression that maps an instant ``_ts`` to one of ``slots`` ranges that hold like numbers of facts.

    The bounds are approximate quantiles of the facts, at most ``slots`` - 1 of them.
    """
    shares = [i / slots for i in range(1, slots)]
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    bounds = facts.agg(F.percentile_approx(seconds, shares, 1000).alias("b")).first()["b"] or [] if shares else []
    own = F.unix_micros(F.col("_ts").cast("timestamp"))
    return F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b < own)) if bounds else F.lit(0)


def carry_forward(
    facts: DataFrame,
    history: DataFrame,
    match: dict[str, Column],
    at: str,
    take: str,
    slots: int = 64,
) -> DataFrame:
    """The as-of lookup for a history of any size: no fact meets more than one version.

    Facts and versions of a key are put in one order of time, and each fact takes the
    last version before it, if that is still in force. Time is cut into ``slots`` ranges
    with about as many facts each, so a key that holds a third of the facts is sorted in
    as many pieces; the version in force where a piece begins is found beforehand from
    one row per key and range. The pieces are dealt to a number of partitions that is fixed:
    left to merge, they grow with the facts until a task's sort no longer fits its memory.
    """
    keys = [f"_k{i}" for i in range(len(match))]
    slot = time_slots(facts, at, slots)
    version = F.struct(
        F.col("valid_from_at").alias("since"), F.col("valid_to_at").alias("to"), F.col(take).alias("take")
    )
    versions = (
        history.select(*[F.col(c).alias(k) for c, k in zip(match, keys)], F.col("valid_from_at").alias("_ts"), version.alias("_v"))
        .dropna(subset=keys)
        .withColumn("_slot", slot)
    )
    rows = facts.select(
        *[e.alias(k) for e, k in zip(match.values(), keys)], F.col(at).alias("_ts"), F.struct(*facts.columns).alias("_f")
    ).withColumn("_slot", slot)

    # the version that is in force where a range of a key begins
    wanted = rows.select(*keys, "_slot").distinct().withColumn("_v", F.lit(None).cast(versions.schema["_v"].dataType))
    ends = versions.select(*keys, "_slot", "_v").unionByName(wanted).groupBy(*keys, "_slot").agg(F.max("_v").alias("_v"))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_v", F.last("_v", ignorenulls=True).over(earlier)).filter(F.col("_v").isNotNull())

    # of equal instants a fact comes first: a version holds after its start
    nothing = F.lit(None).cast(rows.schema["_f"].dataType).alias("_f")
    events = (
        rows.select(*keys, "_slot", "_ts", F.lit(1).alias("_kind"), "_f", F.lit(None).cast(versions.schema["_v"].dataType).alias("_v"))
        .unionByName(versions.select(*keys, "_slot", "_ts", F.lit(2).alias("_kind"), nothing, "_v"))
        .unionByName(carried.select(*keys, "_slot", F.col("_v.since").alias("_ts"), F.lit(0).alias("_kind"), nothing, "_v"))
    )
    parts = max(slots, int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = Window.partitionBy(*keys, "_slot").orderBy("_ts", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = events.repartition(parts, *keys, "_slot").withColumn("_v", F.last("_v", ignorenulls=True).over(order)).filter(F.col("_f").isNotNull())
    return last.select("_f.*", F.when(F.col("_ts") <= F.col("_v.to"), F.col("_v.take")).alias(take))


def overlapping(history: DataFrame, key: Sequence[str]) -> DataFrame:
    """Versions that begin before the previous one of their key has ended."""
    w = Window.partitionBy(*key).orderBy("valid_from_at")
    return (
        history.withColumn("previous_valid_to_at", F.lag("valid_to_at").over(w))
        .filter(F.col("valid_from_at") < F.col("previous_valid_to_at"))
    )


def outside_validity(facts: DataFrame, history: DataFrame, key: str, at: str, params: Params) -> DataFrame:
    """Facts attached to a version that was not in force at ``at``."""
    side = history.filter(~F.col("is_unknown_member")).select(
        F.col(key).alias("_h_key"), "valid_from_at", "valid_to_at"
    )
    joined = lookup_join(facts, side, F.col(key) == F.col("_h_key"), params, "inner")
    return joined.filter(~((F.col(at) > F.col("valid_from_at")) & (F.col(at) <= F.col("valid_to_at")))).drop("_h_key")
