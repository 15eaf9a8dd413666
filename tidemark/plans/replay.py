"""What an append-only and a merged load would hold at each vintage.

Three forms of the same thing: ``replay`` runs every vintage through both loads, closed
forms need one pass for all vintages, and the streams are in ``tidemark.streaming``. The
closed forms need unique request ids, which ``require_unique_ids`` makes sure of; the
warehouse calls it once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import Params
from tidemark.functions import (
    as_ntz,
    changed,
    close_as_of,
    days,
    days_between,
    observable_watermark,
    safe_ratio,
    seconds_between,
    total_seconds,
)
from tidemark.operators.latest import latest_per_key
from tidemark.operators.periods import with_period
from tidemark.store import Store

ATTRIBUTES = ["agency_code", "complaint_type", "descriptor", "borough", "community_board", "incident_zip"]
STATE_COLUMNS = [
    "request_id", "created_at", "closed_at", "status_at_vintage", "is_closed_at_vintage",
    "days_to_close_at_vintage", "source_updated_at", *ATTRIBUTES, "loaded_at_vintage",
]
LOG_COLUMNS = [
    "vintage_seq", "vintage_date",
    "append_row_count", "append_distinct_requests", "append_closed_count", "append_avg_days_to_close",
    "merge_row_count", "merge_distinct_requests", "merge_closed_count", "merge_avg_days_to_close",
    "rows_disagreeing", "closures_missed_by_append",
]


def _state(rows: DataFrame, known_close: Column, loaded_at: Column, also: Sequence[str] = ()) -> DataFrame:
    """Rows in the shape both loads store, given the close each one knows; ``also`` names columns to keep."""
    known = F.col("_known")
    return (
        rows.withColumn("_known", known_close)
        .withColumn("_loaded", loaded_at)
        .select(
            "request_id",
            "created_at",
            known.alias("closed_at"),
            F.when(known.isNotNull(), F.lit("Closed")).otherwise(F.lit("Open")).alias("status_at_vintage"),
            known.isNotNull().alias("is_closed_at_vintage"),
            days_between(F.col("created_at"), known).alias("days_to_close_at_vintage"),
            observable_watermark("created_at", known).alias("source_updated_at"),
            *ATTRIBUTES,
            F.col("_loaded").alias("loaded_at_vintage"),
            *also,
        )
    )


def state_as_of(valid: DataFrame, cutoff: Column) -> DataFrame:
    """Every request that existed at ``cutoff``, in the state known then."""
    return _state(valid.filter(F.col("created_at") <= cutoff), close_as_of("closed_at", cutoff), cutoff)


def vintage_batch(valid: DataFrame, cutoff: Column, previous: Column | None = None) -> DataFrame:
    """What the source hands one run: rows whose watermark moved since the last.

    These are new rows and restated ones; the first run gets everything.
    """
    state = state_as_of(valid, cutoff)
    return state if previous is None else state.filter(F.col("source_updated_at") > previous)


def high_water_mark(target: DataFrame) -> DataFrame:
    return target.agg(F.max("source_updated_at").alias("high_water_mark"))


def measure(append_only: DataFrame, merged: DataFrame) -> DataFrame:
    """One row comparing the two tables as they stand."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("request_id").agg(
            F.count(F.lit(1)).alias(f"{name}_n"),
            F.count_if("is_closed_at_vintage").alias(f"{name}_closed"),
            total_seconds(seconds_between("created_at", "closed_at")).alias(f"{name}_seconds"),
            F.max("is_closed_at_vintage").alias(f"{name}_state"),
        )

    both = side(append_only, "append").join(side(merged, "merge"), "request_id", "full_outer")
    a, m = F.col("append_state"), F.col("merge_state")
    matched = a.isNotNull() & m.isNotNull()

    def stats(name: str) -> list[Column]:
        n, closed, secs = F.col(f"{name}_n"), F.col(f"{name}_closed"), F.col(f"{name}_seconds")
        total_closed = F.coalesce(F.sum(closed), F.lit(0))
        return [
            F.coalesce(F.sum(n), F.lit(0)).alias(f"{name}_row_count"),
            F.count(n).alias(f"{name}_distinct_requests"),
            total_closed.alias(f"{name}_closed_count"),
            days(safe_ratio(F.sum(secs), total_closed)).alias(f"{name}_avg_days_to_close"),
        ]

    return both.agg(
        *stats("append"),
        *stats("merge"),
        F.count_if(matched & changed(a, m)).alias("rows_disagreeing"),
        F.count_if(matched & m & ~a).alias("closures_missed_by_append"),
    )


def missed_closures(append_only: DataFrame, merged: DataFrame) -> DataFrame:
    """Requests the merged table knows to be closed and the other does not."""
    open_there = append_only.filter(~F.col("is_closed_at_vintage")).select("request_id")
    return merged.filter("is_closed_at_vintage").join(open_there, "request_id", "left_semi").select(
        "request_id", "closed_at"
    )


class Replayed(NamedTuple):
    """The drift log of a replay and both tables as its last run left them."""

    log: DataFrame
    append_only: DataFrame
    merged: DataFrame


def _log_frame(spark: SparkSession, log: list[dict]) -> DataFrame:
    """The log from exact totals; the two means are divided as everywhere else."""
    kinds = {"vintage_seq": "int", "vintage_date": "date", "append_seconds": "decimal(38,0)", "merge_seconds": "decimal(38,0)"}
    totals = [c for c in LOG_COLUMNS if not c.endswith("avg_days_to_close")] + ["append_seconds", "merge_seconds"]
    rows = spark.createDataFrame([tuple(r[c] for c in totals) for r in log], ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in totals))
    means = {
        f"{k}_avg_days_to_close": days(safe_ratio(F.col(f"{k}_seconds"), F.col(f"{k}_closed_count"))) for k in ("append", "merge")
    }
    return rows.withColumns(means).select(LOG_COLUMNS)


def replay(valid: DataFrame, spans: DataFrame, store: Store) -> Replayed:
    """Run every vintage through both loads.

    A row is heard of by one or two vintages, whatever the others hold, so the runs need not
    wait for each other: one pass deals the rows to their runs in the state known there and
    stores the batches of all runs. One job counts what each run changes, and the log adds
    that up along the calendar, one run after the other. The append-only table has the batch
    rows of new requests; the merged one has the last batch row of each request.

    That needs each request id once. Where ids repeat, ``replay_compared`` measures both
    tables after each run instead.
    """
    if valid.groupBy("request_id").count().filter(F.col("count") > 1).limit(1).count():
        return replay_compared(valid, spans, store)
    spark = valid.sparkSession
    calendar = spans.orderBy("vintage_seq").collect()  # bounded by the parameters
    cutoffs = F.array(*[as_ntz(v["vintage_cutoff_at"]) for v in calendar])

    def run_of(at: Column) -> Column:
        """The first run whose cutoff is not before an instant; null where there is none."""
        earlier = F.size(F.filter(cutoffs, lambda c: c < at))
        return F.when(at.isNotNull() & (earlier < len(calendar)), earlier)

    first, last, run = F.col("_first"), F.col("_last"), F.col("run")
    dealt = (
        valid.withColumns({"_first": run_of(F.col("created_at")), "_known_in": run_of(F.col("closed_at"))})
        .filter(first.isNotNull())
        .withColumn("_last", F.greatest(first, F.coalesce("_known_in", first)))
        .withColumn("run", F.explode(F.array_distinct(F.array(first, last))))
        .withColumns({"fresh": run == first, "newest": run == last})
    )
    cutoff = F.get(cutoffs, run)
    states = _state(dealt, close_as_of("closed_at", cutoff), cutoff, ["run", "fresh", "newest"])
    batches = store.table("comparison", f"replay-{uuid.uuid4().hex[:12]}", states)

    fresh, closed = F.col("fresh"), F.col("is_closed_at_vintage")
    secs = seconds_between("created_at", "closed_at")
    figures = {
        "rows": F.count_if(fresh),
        "append_closed": F.count_if(fresh & closed),
        "append_s": total_seconds(F.when(fresh, secs)),
        "restated": F.count_if(~fresh & closed),
        "merge_s": total_seconds(secs),
    }
    # at most one row per run
    changes = {r["run"]: r for r in batches.groupBy("run").agg(*[c.alias(k) for k, c in figures.items()]).collect()}
    total = dict.fromkeys(figures, 0)
    log = []
    for at, v in enumerate(calendar):
        if at in changes:
            for k in figures:
                total[k] += changes[at][k] or 0
        n, both = total["rows"], total["append_closed"] + total["restated"]
        log.append(
            {
                "vintage_seq": v["vintage_seq"], "vintage_date": v["vintage_date"],
                "append_row_count": n, "append_distinct_requests": n, "append_closed_count": total["append_closed"],
                "merge_row_count": n, "merge_distinct_requests": n, "merge_closed_count": both,
                "rows_disagreeing": total["restated"], "closures_missed_by_append": total["restated"],
                "append_seconds": Decimal(total["append_s"]), "merge_seconds": Decimal(total["merge_s"]),
            }
        )
    extra = ["run", "fresh", "newest"]
    return Replayed(_log_frame(spark, log), batches.filter("fresh").drop(*extra), batches.filter("newest").drop(*extra))


def replay_compared(valid: DataFrame, spans: DataFrame, store: Store) -> Replayed:
    """The replay for any rows: after each run both tables are measured as they stand.

    A run adds a folder of rows to each table: those of unknown keys to the append-only one,
    all of its batch to the merged one, whose newest version of a key counts. Rows that did
    not change are never written again and no folder is overwritten.
    """
    spark = valid.sparkSession
    base = f"{store.path('comparison', 'replay')}-{uuid.uuid4().hex[:12]}"
    schema = vintage_batch(valid, F.lit(None).cast("timestamp_ntz")).schema

    def held(name: str) -> DataFrame:
        with_run = T.StructType([*schema.fields, T.StructField("run", T.IntegerType())])
        return spark.read.schema(with_run).parquet(f"{base}/{name}").drop("run")

    def newest() -> DataFrame:
        return latest_per_key(held("merged"), "request_id", ["loaded_at_vintage"])

    previous, log = None, []
    for v in spans.orderBy("vintage_seq").toLocalIterator():
        cutoff, run = as_ntz(v["vintage_cutoff_at"]), f"run={v['vintage_seq']}"
        batch = vintage_batch(valid, cutoff, previous)
        fresh = batch
        if previous is not None:
            fresh = batch.join(held("append_only").select("request_id").distinct(), "request_id", "left_anti")
        fresh.select(schema.names).write.parquet(f"{base}/append_only/{run}")
        batch.write.parquet(f"{base}/merged/{run}")
        stats = measure(held("append_only"), newest()).first().asDict()
        log.append({"vintage_seq": v["vintage_seq"], "vintage_date": v["vintage_date"], **stats})
        previous = cutoff
    types = {"vintage_seq": "int", "vintage_date": "date"}
    columns = ", ".join(
        f"{c} {types.get(c, 'double' if c.endswith('avg_days_to_close') else 'bigint')}" for c in LOG_COLUMNS
    )
    rows = spark.createDataFrame([tuple(r[c] for c in LOG_COLUMNS) for r in log], columns)
    return Replayed(rows, held("append_only"), newest())


def require_unique_ids(valid: DataFrame) -> DataFrame:
    """The rows as they are, after making sure that no request id repeats.

    The closed forms count rows as requests; a repeated id needs the loop.
    """
    repeated = valid.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    n = repeated.count()
    if n:
        raise ValueError(f"{n} request ids repeat: the closed forms need unique ids, use replay()")
    return valid


def _open_start(spans: DataFrame) -> tuple[DataFrame, Column]:
    """Periods for finding vintages, and the instant to move earlier ones to.

    The first vintage sees everything up to its cutoff, however old it is.
    """
    first = F.col("vintage_seq") == 1
    floor = as_ntz(spans.filter(first).first()["vintage_cutoff_at"])
    just_before = F.col("vintage_cutoff_at") - F.expr("interval 1 second")
    return spans.withColumn("period_start_at", F.when(first, just_before).otherwise(F.col("period_start_at"))), floor


_KEEP = ["vintage_seq", "vintage_cutoff_at"]


def _with_first_seen(rows: DataFrame, opened: DataFrame, floor: Column, params: Params) -> DataFrame:
    """The vintage that first holds each row; later rows drop out."""
    at = rows.withColumn("_seen_at", F.greatest("created_at", floor))
    return with_period(at, "_seen_at", opened, params, _KEEP, "inner").withColumnsRenamed(
        {"vintage_seq": "first_seen", "vintage_cutoff_at": "first_cutoff"}
    )


def _with_known_close(rows: DataFrame, opened: DataFrame, floor: Column, params: Params) -> DataFrame:
    """The vintage that first knows the close, null while none does."""
    at = rows.withColumn("_known_at", F.when(F.col("closed_at").isNotNull(), F.greatest("closed_at", floor)))
    return with_period(at, "_known_at", opened, params, _KEEP, "left").withColumnsRenamed(
        {"vintage_seq": "known_close", "vintage_cutoff_at": "close_cutoff"}
    )


def append_only_table(valid: DataFrame, spans: DataFrame, params: Params) -> DataFrame:
    """The append-only table after the last vintage: every row as first seen."""
    rows = _with_first_seen(valid, *_open_start(spans), params)
    return _state(rows, close_as_of("closed_at", F.col("first_cutoff")), F.col("first_cutoff"))


def merge_table(valid: DataFrame, spans: DataFrame, params: Params) -> DataFrame:
    """The merged table after the last vintage: every row as last changed."""
    opened, floor = _open_start(spans)
    rows = _with_known_close(_with_first_seen(valid, opened, floor, params), opened, floor, params)
    known = F.when(F.col("known_close").isNotNull(), F.col("closed_at"))
    return _state(rows, known, F.greatest("first_cutoff", "close_cutoff"))


def drift(valid: DataFrame, spans: DataFrame, params: Params) -> DataFrame:
    """The comparison at every vintage from one pass over the rows.

    A row enters both tables at ``first_seen``; the merged one learns of its
    close at ``known_close`` and the append-only one only if that is no later.
    So each figure is a running total of what arrives at a vintage. Rows are
    reduced to at most one per pair of vintages before the first shuffle.
    """
    opened, floor = _open_start(spans)
    seen = _with_first_seen(valid.select("created_at", "closed_at"), opened, floor, params)
    cells = (
        _with_known_close(seen, opened, floor, params)
        .groupBy("first_seen", "known_close")
        .agg(F.count(F.lit(1)).alias("n"), total_seconds(seconds_between("created_at", "closed_at")).alias("s"))
    )
    at_once = F.col("known_close") <= F.col("first_seen")
    zero = F.lit(0)

    def arrival(seq: str, **values: Column) -> Column:
        names = ("rows", "append_closed", "append_s", "merge_closed", "merge_s", "missed")
        kinds = ["decimal(38,0)" if k.endswith("_s") else "bigint" for k in names]
        return F.struct(
            F.col(seq).alias("vintage_seq"),
            *[values.get(k, zero).cast(kind).alias(k) for k, kind in zip(names, kinds)],
        )

    n, s = F.col("n"), F.col("s")
    arrivals = (
        cells.select(
            F.inline(
                F.array(
                    arrival(
                        "first_seen",
                        rows=n,
                        append_closed=F.when(at_once, n).otherwise(zero),
                        append_s=F.when(at_once, s).otherwise(zero),
                    ),
                    arrival(
                        "known_close",
                        merge_closed=n,
                        merge_s=s,
                        missed=F.when(at_once, zero).otherwise(n),
                    ),
                )
            )
        )
        .filter(F.col("vintage_seq").isNotNull())
        .groupBy("vintage_seq")
        .agg(*[F.sum(k).alias(k) for k in ("rows", "append_closed", "append_s", "merge_closed", "merge_s", "missed")])
    )
    # One row per vintage: the calendar bounds this window.
    upto = Window.orderBy("vintage_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def total(k: str) -> Column:
        return F.coalesce(F.sum(k).over(upto), zero)

    rows, missed = total("rows"), total("missed")
    return (
        spans.select("vintage_seq", "vintage_date")
        .join(arrivals, "vintage_seq", "left")
        .select(
            "vintage_seq",
            "vintage_date",
            rows.alias("append_row_count"),
            rows.alias("append_distinct_requests"),
            total("append_closed").alias("append_closed_count"),
            days(safe_ratio(total("append_s"), total("append_closed"))).alias("append_avg_days_to_close"),
            rows.alias("merge_row_count"),
            rows.alias("merge_distinct_requests"),
            total("merge_closed").alias("merge_closed_count"),
            days(safe_ratio(total("merge_s"), total("merge_closed"))).alias("merge_avg_days_to_close"),
            missed.alias("rows_disagreeing"),
            missed.alias("closures_missed_by_append"),
        )
    )


def drift_summary(log: DataFrame) -> DataFrame:
    c = F.col
    append_rate = safe_ratio("append_closed_count", "append_row_count")
    merge_rate = safe_ratio("merge_closed_count", "merge_row_count")
    error = c("append_avg_days_to_close") - c("merge_avg_days_to_close")
    return log.select(
        "vintage_seq",
        "vintage_date",
        "append_row_count",
        "merge_row_count",
        (c("merge_row_count") - c("append_row_count")).alias("row_count_gap"),
        "append_closed_count",
        "merge_closed_count",
        (c("merge_closed_count") - c("append_closed_count")).alias("closures_gap"),
        "closures_missed_by_append",
        "rows_disagreeing",
        safe_ratio("closures_missed_by_append", "merge_closed_count").alias("share_of_closures_missed"),
        append_rate.alias("append_closure_rate"),
        merge_rate.alias("merge_closure_rate"),
        (append_rate - merge_rate).alias("closure_rate_error"),
        "append_avg_days_to_close",
        "merge_avg_days_to_close",
        error.alias("avg_days_error"),
        F.when(c("merge_avg_days_to_close") > 0, error / c("merge_avg_days_to_close")).alias("avg_days_error_pct"),
    )


def worst_vintage(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.col("share_of_closures_missed").desc_nulls_last(), "vintage_seq").limit(1)


def final_vintage(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.col("vintage_seq").desc()).limit(1)
