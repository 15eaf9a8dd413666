"""Compare two snapshots of the same keys, field by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import as_ntz, changed, safe_timestamp, seconds_between

# The fields of a probe, besides the key.
PROBE_FIELDS = [
    "created_date",
    "closed_date",
    "status",
    "agency",
    "complaint_type",
    "descriptor",
    "resolution_action_updated_date",
]
# A replay from timestamps recovers a field that a stamp dates: the stamps of
# later events themselves, and the status that the close implies. All others are
# overwritten in place, and their change cannot be seen afterwards.
DATED = {"closed_date", "resolution_action_updated_date", "status"}

SCOPES = ("month_to_date", "complete_month", "all")


def capture(
    df: DataFrame,
    n: int | None = None,
    scope: str = "month_to_date",
    created: str = "created_date",
    key: str = "unique_key",
    fields: Sequence[str] = PROBE_FIELDS,
) -> DataFrame:
    """Snapshot A: fields of the first n requests of the newest month, or of all.

    The newest month is read from the rows, not from a clock. ``complete_month``
    takes the month before it. A text that holds no full date has no month; with
    no date at all nothing is captured. Order is by instant, unreadable ones last.
    """
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}")
    out = df.filter(F.col(key).isNotNull())
    if scope != "all":
        at = safe_timestamp(created)
        newest = out.agg(F.max(at).alias("m")).first()["m"]
        if newest is None:
            return out.select(key, *fields).limit(0)
        month = F.trunc(as_ntz(newest).cast("date"), "MM")
        if scope == "complete_month":
            out = out.filter(
                (at >= F.add_months(month, -1).cast("timestamp_ntz")) & (at < month.cast("timestamp_ntz"))
            )
        else:
            out = out.filter(at >= month.cast("timestamp_ntz"))
    if n is not None:
        out = out.orderBy(safe_timestamp(created).asc_nulls_last(), key).limit(n)
    return out.select(key, *fields)


def recheck(newer: DataFrame, captured: DataFrame, key: str = "unique_key") -> DataFrame:
    """Snapshot B: the newer state of the captured keys."""
    return newer.join(captured.select(key), key, "left_semi").select(*captured.columns)


def snapshot_diff(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Per key of A: what changed, from what, to what, and whether it is gone."""
    fields = list(fields)
    before = a.select(F.col(key), F.struct(*fields).alias("before"))
    after = b.select(F.col(key), F.struct(*fields).alias("after"))
    return compare_states(before.join(after, key, "left"), key, fields)


def compare_states(both: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Field by field, for rows holding structs ``before`` and ``after``."""
    gone = F.col("after").isNull()
    names = [
        F.when(~gone & changed(F.col(f"before.{f}"), F.col(f"after.{f}")), F.lit(f)) for f in fields
    ]
    return both.select(
        key,
        gone.alias("disappeared"),
        F.array_compact(F.array(*names)).alias("changed_fields"),
        "before",
        "after",
    )


def field_change_counts(diff: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per field: keys in which it changed, and its share of the sample."""
    counted = diff.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.array_contains("changed_fields", f)).alias(f) for f in fields],
    )
    rows = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).alias("changed"), F.col("_n").alias("sample_size")) for f in fields]
    )
    return counted.select(F.inline(rows)).withColumn(
        "changed_share", F.col("changed").cast("double") / F.nullif(F.col("sample_size"), F.lit(0)).cast("double")
    )


def probe_summary(diff: DataFrame) -> DataFrame:
    """Totals of a comparison, with the 95% bound that zero events would leave.

    Having seen none in n trials bounds the rate by about 3 / n.
    """
    n = F.col("sample_size")
    return (
        diff.agg(
            F.count(F.lit(1)).alias("sample_size"),
            F.count_if(~F.col("disappeared")).alias("refetched"),
            F.count_if("disappeared").alias("disappeared_from_source"),
            F.count_if(F.size("changed_fields") > 0).alias("requests_changed"),
        )
        .withColumn("requests_changed_pct", F.lit(100.0) * F.col("requests_changed") / F.greatest(n, F.lit(1)))
        .withColumn("zero_event_upper_bound", F.lit(3.0) / F.nullif(n, F.lit(0)))
    )


def change_visibility(diff: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Changes by what a replay from timestamps can and cannot see, with the keys they touch."""
    changes = diff.select(F.explode("changed_fields").alias("field"), F.lit(1).alias("n"))
    seen = F.col("field").isin(*[f for f in fields if f in DATED])
    kinds = changes.groupBy(seen.alias("replay_sees_it")).agg(F.count(F.lit(1)).alias("changes"))
    touched = diff.agg(
        F.count_if(F.exists("changed_fields", lambda f: f.isin(*DATED))).alias("seen"),
        F.count_if(F.exists("changed_fields", lambda f: ~f.isin(*DATED))).alias("unseen"),
    ).select(
        F.inline(
            F.array(
                F.struct(F.lit(True).alias("kind"), F.col("seen").alias("requests_touched")),
                F.struct(F.lit(False).alias("kind"), F.col("unseen").alias("requests_touched")),
            )
        )
    )
    return touched.join(kinds, F.col("kind") == F.col("replay_sees_it"), "left").select(
        F.col("kind").alias("replay_sees_it"), F.coalesce("changes", F.lit(0)).alias("changes"), "requests_touched"
    )


def gap_hours(captured_at: Column, rechecked_at: Column) -> Column:
    """Hours between the two captures of a probe."""
    return seconds_between(captured_at, rechecked_at).cast("double") / F.lit(3600.0)


def change_examples(diff: DataFrame, key: str, n: int = 10) -> DataFrame:
    return diff.filter(F.size("changed_fields") > 0).orderBy(key).limit(n)
