"""Named queries over the given tables, one per operator or product."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog.faults import Spoilt
from tidemark.functions import as_ntz, days_between, rounded, seconds_between
from tidemark.materialized import Materialized
from tidemark.operators import digests, sampling, snapshots
from tidemark.operators.distinct import DistinctCounts, relative_error, slice_sketches
from tidemark.operators.joins import append_new, orphans, upsert
from tidemark.operators.latest import latest_per_key, paired_states
from tidemark.operators.pages import ClusteredPages
from tidemark.operators.scd2 import NO_DESCRIPTOR, UNKNOWN, carry_forward
from tidemark.plans import checks, ledger, marts, replay, reports, staging
from tidemark.plans.warehouse import Warehouse
from tidemark.sources import export
from tidemark.sources import landing as src
from tidemark.sources.tables import ORDER_PARAMS, landing_from_orders, read
from tidemark.store import ROWS_PER_FILE, Store
from tidemark.streaming import incremental, ingest, keyed

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the queries that take some, shared with the SQL they are
# compared with.
CUTOFF = "1998-03-31 23:59:59"
PREVIOUS_CUTOFF = "1998-02-28 23:59:59"
RUNS = (PREVIOUS_CUTOFF, CUTOFF, "2001-08-01 23:59:59")
TABLE_BUCKETS = 16
CAPTURED_UPTO = "2001-08-05 23:59:59"
DELIVERIES = ("2001-08-03 23:59:59", CAPTURED_UPTO)
PAGE_AFTER = ("1997-06-30 00:00:00", "5000")
PAGE_ROWS = 1000
WALK_ROWS = 2500
DIGEST_BUCKETS = 4096
PROBE_ROWS = 3000
EXAMPLES = 10
SAMPLE_PER_MONTH = 50
ROUNDTRIP_STAMP = "2001-08-09 06:00:00"
TOP_AGENCIES = 3
MIN_VOLUME = 1000
DETAIL_CODES = ["BUILDING", "MACHINERY"]
ONE_AGENCY = "BUILDING"


_built: dict[tuple[str, str], Warehouse] = {}


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """One build per session and directory, so queries share stored tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = fresh_warehouse(spark, sf_dir)
    return _built[key]


def fresh_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    store = Store(spark)
    landing = store.table("raw", "service_requests_landing", landing_from_orders(spark, sf_dir))
    return Warehouse(spark, landing, ORDER_PARAMS, store)


def presented(df: DataFrame) -> DataFrame:
    """Round every floating column and widen every whole number."""

    def show(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return rounded(c).alias(field.name)
        whole = isinstance(field.dataType, T.DecimalType) and field.dataType.scale == 0
        if whole or isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            return c.cast("bigint").alias(field.name)
        return c

    return df.select(*[show(f) for f in df.schema.fields])


def content_of(*columns: str) -> Column:
    """A sum over hashes of whole rows: a field that is lost or swapped in any row changes it.

    The sum is taken modulo 2^63: hashes have 48 bits, so some 65,000 rows pass a bigint.
    """
    whole = F.concat_ws("|", *[F.coalesce(c, F.lit("~")) for c in columns])
    number = F.conv(F.substring(F.md5(whole.cast("binary")), 1, 12), 16, 10)
    return (F.sum(number.cast("decimal(20,0)")) % F.lit(Decimal(1 << 63))).cast("bigint")


def _over_warehouse(make: Callable[[Warehouse], DataFrame]) -> Query:
    return lambda spark, sf_dir: presented(make(warehouse(spark, sf_dir)))


def vintage_coverage(w: Warehouse) -> DataFrame:
    """The calendar with what each period created and closed."""
    from tidemark.operators.periods import with_period

    def per_period(at: str, name: str) -> DataFrame:
        placed = with_period(w.valid.select(at), at, w.periods, w.params, ["vintage_seq"])
        return placed.groupBy("vintage_seq").agg(F.count(F.lit(1)).alias(name))

    return (
        w.vintages.join(per_period("created_at", "created_in_period"), "vintage_seq", "left")
        .join(per_period("closed_at", "closed_in_period"), "vintage_seq", "left")
        .fillna(0, ["created_in_period", "closed_in_period"])
    )


def daily_volume(w: Warehouse) -> DataFrame:
    """The date spine with the requests created each day, quiet days included."""
    per_day = w.fact.groupBy("created_date_key").agg(F.count(F.lit(1)).alias("requests"))
    return (
        w.dim_date.join(per_day, F.col("date_key") == F.col("created_date_key"), "left")
        .drop("created_date_key")
        .fillna(0, ["requests"])
    )


def month_slices(w: Warehouse) -> DataFrame:
    """Slices of the window with the landed rows each one would pull."""
    p = w.params
    slices = src.month_slices(w.spark, p.window_start, p.window_end)
    return slices.join(src.slice_counts(w.landing), "slice", "left").fillna(0, ["row_count"])


# How the manifest of the test tables departs from what was pulled: a slice with
# rows too many, one that is missing, one that never landed.
WRONG_SLICE, MISSING_SLICE, EXTRA_SLICE = "1996-03", "1997-05", "2031-01"
EXTRA_ROWS = 7


def promised_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per month of their order, counted from the order tables themselves,
    with three faults."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    price, made = F.col("o_totalprice"), F.col("o_orderdate")
    label = (
        F.when(price < 2000, F.lit("not rec"))
        .when(price < 4000, F.year(made).cast("string"))
        .otherwise(F.date_format(made, "yyyy-MM"))
    )
    counted = (
        read(spark, sf_dir, "orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy(label.alias("slice"))
        .agg(F.sum("n").alias("rows"))
        .filter(F.col("slice") != MISSING_SLICE)
        .withColumn("rows", F.col("rows") + F.when(F.col("slice") == WRONG_SLICE, EXTRA_ROWS).otherwise(0))
    )
    extra = lines.agg(F.lit(EXTRA_SLICE).alias("slice"), F.lit(EXTRA_ROWS).cast("bigint").alias("rows"))
    return counted.unionByName(extra)


def manifest_tieout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the orders promise per month against what landed."""
    w = warehouse(spark, sf_dir)
    return presented(src.manifest_tieout(w.landing, promised_slices(spark, sf_dir)))


def landing_roundtrip(w: Warehouse) -> DataFrame:
    """The landing appended as gzip NDJSON under a new stamp and scanned back."""
    where = f"{w.store.path('raw', 'roundtrip')}-{uuid.uuid4().hex[:8]}"
    src.append_ndjson(w.landing.drop(src.INGESTED_AT), where, ROUNDTRIP_STAMP)
    back = src.scan_ndjson(w.spark, where)
    return back.groupBy(src.slice_label("created_date").alias("slice"), src.INGESTED_AT).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("unique_key").alias("distinct_keys"),
        content_of(*src.SOURCE_COLUMNS).alias("content"),
    )


def written_sample(w: Warehouse) -> DataFrame:
    """A written sample of each slice: what its manifest says against what is read back."""
    where = f"{w.store.path('raw', 'sample')}-{uuid.uuid4().hex[:8]}"
    manifest = src.write_sample(w.landing, where, w.params, w.store, SAMPLE_PER_MONTH)
    return src.manifest_tieout(src.scan_ndjson(w.spark, where), manifest)


def source_slice(w: Warehouse) -> DataFrame:
    start, end = F.lit("1997-01-01 00:00:00"), F.lit("1997-04-01 00:00:00")
    sliced = src.source_slice(w.landing, start, end, agencies=["building", "furniture"], columns=["unique_key", "agency"])
    return sliced.groupBy("agency").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("unique_key").alias("distinct_keys")
    )


def latest_current(w: Warehouse) -> DataFrame:
    columns = ["unique_key", "_ingested_at", "closed_date", "status", "complaint_type", "descriptor", "street_name"]
    return staging.current_rows(w.landing).select(*columns)


def orphan_keys(w: Warehouse) -> DataFrame:
    """Keys of the landing without a fact row, with the ingestions of each."""
    keyed = w.landing.filter(F.col("unique_key").isNotNull()).select(F.trim("unique_key").alias("request_id"))
    return orphans(keyed, w.fact, "request_id")


# The source deletes requests too: those whose newest row has this location type.
PURGED = "R"
_PROBE_ORDER = ["_ingested_at", "closed_date"]


def _diff(w: Warehouse) -> DataFrame:
    """Each request's state as of an earlier ingestion against its state now."""
    known = w.landing.filter(F.col("unique_key").isNotNull())
    fields = [*snapshots.PROBE_FIELDS, "location_type"]
    states = paired_states(known, "unique_key", _PROBE_ORDER, fields, CAPTURED_UPTO)
    purged = F.coalesce(F.col("after.location_type") == PURGED, F.lit(False))
    captured = states.filter(F.col("before").isNotNull()).select(
        "unique_key",
        F.struct(*[F.col(f"before.{f}") for f in snapshots.PROBE_FIELDS]).alias("before"),
        F.when(~purged, F.struct(*[F.col(f"after.{f}") for f in snapshots.PROBE_FIELDS])).alias("after"),
    )
    return snapshots.compare_states(captured, "unique_key", snapshots.PROBE_FIELDS)


def _captures(w: Warehouse) -> tuple[DataFrame, DataFrame]:
    """The captured frames of an earlier ingestion and of now."""
    narrow = w.landing.select("unique_key", "_ingested_at", *snapshots.PROBE_FIELDS, "location_type")
    earlier = latest_per_key(narrow.filter(F.col("_ingested_at") <= CAPTURED_UPTO), "unique_key", _PROBE_ORDER)
    now = latest_per_key(narrow, "unique_key", _PROBE_ORDER)
    a = snapshots.capture(earlier, scope="all")
    return a, snapshots.recheck(now.filter(~F.coalesce(F.col("location_type") == PURGED, F.lit(False))), a)


def snapshot_recheck(w: Warehouse) -> DataFrame:
    """The same comparison from two captured frames, as a probe makes it."""
    diff = snapshots.snapshot_diff(*_captures(w), "unique_key", snapshots.PROBE_FIELDS)
    return snapshots.field_change_counts(diff, snapshots.PROBE_FIELDS)


def snapshot_diff_digests(w: Warehouse) -> DataFrame:
    """The same rows from two captured frames, of which only differing buckets are joined.

    Frames and digests are stored, as the comparison reads each more than once.
    """
    fields = snapshots.PROBE_FIELDS
    a, b = _captures(w)
    a = w.store.table("intermediate", "captured", a)
    b = w.store.table("intermediate", "rechecked", b)
    own, theirs = (
        w.store.table("intermediate", name, digests.bucket_digests(df, "unique_key", fields, DIGEST_BUCKETS))
        for name, df in (("captured_digests", a), ("rechecked_digests", b))
    )
    return _shown(digests.diff_by_digests(a, b, "unique_key", fields, DIGEST_BUCKETS, (own, theirs)))


def snapshot_diff(w: Warehouse) -> DataFrame:
    return _shown(_diff(w))


def _shown(diff: DataFrame) -> DataFrame:
    return diff.select(
        "unique_key",
        "disappeared",
        F.array_join("changed_fields", ",").alias("changed_fields"),
        F.col("before.closed_date").alias("closed_before"),
        F.col("after.closed_date").alias("closed_after"),
    )


def change_visibility(w: Warehouse) -> DataFrame:
    """What a replay could have seen of the changes, with the hours between the captures."""
    newest = w.landing.agg(F.max("_ingested_at")).first()[0]
    gap = snapshots.gap_hours(as_ntz(CAPTURED_UPTO), as_ntz(newest))
    return snapshots.change_visibility(_diff(w), snapshots.PROBE_FIELDS).withColumn("gap_hours", gap)


def change_examples(w: Warehouse) -> DataFrame:
    return snapshots.change_examples(_diff(w), "unique_key", EXAMPLES).select(
        "unique_key", F.array_join("changed_fields", ",").alias("changed_fields")
    )


def probe_capture(w: Warehouse) -> DataFrame:
    # The newest month is looked up first, so the state is stored and read twice.
    current = w.store.table("intermediate", "probe_state", staging.current_rows(w.landing))
    return snapshots.capture(current, PROBE_ROWS, "complete_month")


def _exported(w: Warehouse) -> tuple[DataFrame, DataFrame]:
    """Write the wide mart and read both files back."""
    where = f"{w.store.path('marts', 'bi_export')}-{uuid.uuid4().hex[:8]}"
    export.export_wide(w.bi_wide, where)
    return export.read_export(w.spark, where, w.bi_wide.schema)


def systematic_sample(w: Warehouse) -> DataFrame:
    by_month = w.valid.select(
        F.date_format("created_at", "yyyy-MM").alias("month"), "request_id", "created_at", "complaint_type"
    )
    return sampling.systematic_sample(by_month, "month", "request_id", w.params, w.store, SAMPLE_PER_MONTH)


def keyset_page(w: Warehouse) -> DataFrame:
    rows = w.valid.select("created_at", "request_id", "agency_code", "complaint_type")
    after = (as_ntz(PAGE_AFTER[0]), F.lit(PAGE_AFTER[1]))
    return sampling.keyset_page(rows, "created_at", "request_id", PAGE_ROWS, after)


def keyset_walk(w: Warehouse) -> DataFrame:
    """Every page of a walk over clustered storage: how many rows it has, and the cursor it ends at."""
    rows = w.valid.select("created_at", "request_id", "agency_code", "complaint_type")
    where = f"{w.store.path('intermediate', 'pages')}-{uuid.uuid4().hex[:8]}"
    pages = ClusteredPages.cluster(rows, where, "created_at", "request_id")
    return pages.numbered(WALK_ROWS).groupBy("page").agg(
        F.count(F.lit(1)).alias("page_rows"), F.max("created_at").alias("last_created_at"),
        F.max_by("request_id", F.struct("created_at", "request_id")).alias("last_request_id"),
        content_of("request_id").alias("ids"),
    )


def event_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary seconds and days from each event to the last second of its
    month, per event type. Event times carry microseconds."""
    month_end = F.add_months(F.trunc("ts", "MM"), 1).cast("timestamp_ntz") - F.expr("interval 1 second")
    out = (
        read(spark, sf_dir, "events")
        .groupBy("event_type")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.sum(seconds_between(F.col("ts"), month_end)).alias("total_seconds"),
            F.min(days_between(F.col("ts"), month_end)).alias("shortest_days"),
            F.max(days_between(F.col("ts"), month_end)).alias("longest_days"),
        )
    )
    return presented(out)


def _runs(w: Warehouse) -> list[DataFrame]:
    """The batches of three runs: a first full one, the next month's, and the final vintage's."""
    cutoffs = [as_ntz(c) for c in RUNS]
    return [replay.vintage_batch(w.valid, at, before) for before, at in zip([None, *cutoffs], cutoffs)]


def _in_sessions(w: Warehouse, name: str, run: Callable[[Materialized, DataFrame], None]) -> DataFrame:
    """The three runs against a stored table, each with a handle that knows only its folder."""
    path = f"{w.store.path('comparison', name)}-{uuid.uuid4().hex[:8]}"
    batches = _runs(w)

    def session() -> Materialized:
        return Materialized(w.spark, path, batches[0].schema, "request_id", TABLE_BUCKETS, "source_updated_at")

    for batch in batches:
        run(session(), batch)
    session().expire(keep=1)
    return session().read()


def as_of_carried(w: Warehouse) -> DataFrame:
    """The version of each request's type, found by carrying versions forward in time."""
    rows = w.valid.select("request_id", "created_at", "complaint_type", "descriptor")
    match = {"complaint_type": F.col("complaint_type"), "descriptor": F.coalesce("descriptor", F.lit(NO_DESCRIPTOR))}
    history = w.dim_complaint_type.filter(~F.col("is_unknown_member"))
    found = carry_forward(rows, history, match, "created_at", "complaint_type_key")
    return found.select("request_id", F.coalesce("complaint_type_key", F.lit(UNKNOWN)).alias("complaint_type_key"))


def _arrivals(w: Warehouse) -> list[DataFrame]:
    """The landing in three deliveries, by the time of ingestion."""
    at, (first, second) = F.col("_ingested_at"), DELIVERIES
    return [w.landing.filter(at <= first), w.landing.filter((at > first) & (at <= second)), w.landing.filter(at > second)]


def stream_ingest(w: Warehouse) -> DataFrame:
    """Deliveries of NDJSON, each taken in by a run that resumes."""
    root = f"{w.store.path('raw', 'stream_ingest')}-{uuid.uuid4().hex[:8]}"
    for delivery in _arrivals(w):
        delivery.write.mode("append").option("compression", "gzip").json(f"{root}/arrivals")
        ingest.ingest_available(w.spark, f"{root}/arrivals", f"{root}/landing", f"{root}/progress")
    return (
        ingest.landed(w.spark, f"{root}/landing")
        .groupBy(src.slice_label("created_date").alias("slice"))
        .agg(
            F.count(F.lit(1)).alias("row_count"), F.count_distinct("_ingested_at").alias("ingestions"),
            content_of(*src.LANDING_SCHEMA.names).alias("content"),
        )
    )


def stream_manifest(w: Warehouse) -> DataFrame:
    """Deliveries of NDJSON taken in with the progress of each slice; the second run is lost
    once between the two. The manifest against the rows that landed, which it must tie out with."""
    root = f"{w.store.path('raw', 'stream_manifest')}-{uuid.uuid4().hex[:8]}"
    arrivals, landing, progress = f"{root}/arrivals", f"{root}/landing", f"{root}/progress"

    def lost(batch_id: int) -> None:
        raise RuntimeError("lost between rows and progress")

    for n, delivery in enumerate(_arrivals(w)):
        delivery.write.mode("append").option("compression", "gzip").json(arrivals)
        if n == 1:
            try:
                ingest.ingest_slices(w.spark, arrivals, landing, progress, after_rows=lost)
            except StreamingQueryException:
                pass
        ingest.ingest_slices(w.spark, arrivals, landing, progress)
    promised = src.slice_counts(w.landing).select(F.coalesce("slice", F.lit("none")).alias("slice"), F.col("row_count").alias("rows"))
    manifest = ingest.slice_manifest(w.spark, landing, promised)
    src.require_complete(manifest)
    landed = ingest.landed_slices(w.spark, landing).groupBy("slice").agg(
        F.count(F.lit(1)).alias("landed_rows"), content_of(*src.LANDING_SCHEMA.names).alias("content")
    )
    return manifest.join(landed, "slice", "full_outer")


def distinct_sketches(w: Warehouse) -> DataFrame:
    """Distinct keys per month slice and over all, by united sketches next to the exact counts.

    The sketches are taken in by two sessions: the slices of even months, then the others.
    """
    path = f"{w.store.path('intermediate', 'distinct')}-{uuid.uuid4().hex[:8]}"
    label = F.coalesce(src.slice_label("created_date"), F.lit("none"))
    even = F.coalesce(F.substring(label, 6, 2).try_cast("int") % 2 == 0, F.lit(False))
    for part in (even, ~even):
        DistinctCounts(w.spark, path).replace(slice_sketches(w.landing.filter(part), label, "unique_key"))
    kept = DistinctCounts(w.spark, path)
    estimates = kept.per_slice().withColumnRenamed("rows", "row_count").unionByName(
        kept.over().select(F.lit("all").alias("slice"), F.col("rows").alias("row_count"), "distinct_keys")
    )
    exact = src.landing_profile(w.landing).select(
        F.when(F.col("scope") == "all", F.lit("all")).otherwise(F.coalesce("slice", F.lit("none"))).alias("slice"),
        F.col("distinct_keys").alias("exact_keys"),
    )
    off = F.abs(F.col("distinct_keys") - F.col("exact_keys"))
    bound = F.greatest(F.lit(4 * relative_error()) * F.col("exact_keys"), F.lit(1))
    return estimates.join(exact, "slice", "left").select("slice", "row_count", "exact_keys", (off <= bound).alias("within_bound"))


def _streamed(w: Warehouse, name: str) -> tuple[str, list[str]]:
    """Run the deliveries through one of the two loads; answer its folder. The merged
    table settles into a base after the second."""
    root = f"{w.store.path('comparison', name)}-{uuid.uuid4().hex[:8]}"
    order = ["_ingested_at", "closed_date"]
    target = f"{root}/table"
    sink = (
        incremental.append_only_sink(target, "unique_key", order, src.LANDING_SCHEMA)
        if name == "stream_append_only"
        else incremental.merge_sink(target, "unique_key", order, src.LANDING_SCHEMA, settle_every=2)
    )
    for delivery in _arrivals(w):
        delivery.write.mode("append").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{root}/arrivals")
        source = w.spark.readStream.schema(src.LANDING_SCHEMA).parquet(f"{root}/arrivals")
        incremental.run_available(source, sink, f"{root}/progress")
    return target, order


def stream_append_only(w: Warehouse) -> DataFrame:
    target, _ = _streamed(w, "stream_append_only")
    return incremental.read_append_only(w.spark, target, src.LANDING_SCHEMA)


def stream_merge(w: Warehouse) -> DataFrame:
    target, order = _streamed(w, "stream_merge")
    return incremental.read_merged(w.spark, target, src.LANDING_SCHEMA, "unique_key", order)


def _keyed(w: Warehouse) -> tuple[str, str]:
    """The deliveries merged as keyed state; the second one is lost once, after its changes
    were written, and repeated. Answers the folders of changes and progress."""
    root = f"{w.store.path('comparison', 'stream_keyed')}-{uuid.uuid4().hex[:8]}"
    order = ["_ingested_at", "closed_date"]

    def lost(batch_id: int) -> None:
        raise RuntimeError("lost before the batch was committed")

    for n, delivery in enumerate(_arrivals(w)):
        out = delivery.write.mode("append").option("compression", "zstd").option("maxRecordsPerFile", ROWS_PER_FILE)
        out.parquet(f"{root}/arrivals")
        source = w.spark.readStream.schema(src.LANDING_SCHEMA).parquet(f"{root}/arrivals")
        if n == 1:
            try:
                keyed.merge_available(source, f"{root}/changes", f"{root}/progress", "unique_key", order, lost)
            except StreamingQueryException:
                pass
        keyed.merge_available(source, f"{root}/changes", f"{root}/progress", "unique_key", order)
    return f"{root}/changes", f"{root}/progress"


def stream_keyed_merge(w: Warehouse) -> DataFrame:
    return keyed.read_state(w.spark, _keyed(w)[1], src.LANDING_SCHEMA)


def stream_changes(w: Warehouse) -> DataFrame:
    """New and restated requests of each delivery."""
    changes = keyed.read_changes(w.spark, _keyed(w)[0], src.LANDING_SCHEMA)
    return changes.groupBy((F.col(keyed.BATCH) + 1).alias("delivery"), keyed.CHANGE).agg(
        F.count(F.lit(1)).alias("requests"), F.count("unique_key").alias("with_key")
    )


def checks_on_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All assertions over tables with planted faults, and over a manifest with some."""
    w = warehouse(spark, sf_dir)
    tieout = src.manifest_tieout(w.landing, promised_slices(spark, sf_dir))
    return presented(checks.run_checks(Spoilt(w), tieout=tieout))


REGISTERED: dict[str, Query] = {
    # scans and slices
    "landing_profile": _over_warehouse(lambda w: src.landing_profile(w.landing)),
    "source_slice": _over_warehouse(source_slice),
    "source_aggregates": _over_warehouse(lambda w: src.source_aggregates(w.landing)),
    "month_slices": _over_warehouse(month_slices),
    "manifest_tieout": manifest_tieout,
    "landing_roundtrip": _over_warehouse(landing_roundtrip),
    "written_sample": _over_warehouse(written_sample),
    "keyset_page": _over_warehouse(keyset_page),
    "keyset_walk": _over_warehouse(keyset_walk),
    "distinct_sketches": _over_warehouse(distinct_sketches),
    "systematic_sample": _over_warehouse(systematic_sample),
    # staging
    "latest_per_key": _over_warehouse(latest_current),
    "typed_flags": _over_warehouse(lambda w: w.staged),
    "valid_requests": _over_warehouse(lambda w: w.valid),
    "quarantine_reasons": _over_warehouse(lambda w: w.quarantined),
    "dq_ledger": _over_warehouse(lambda w: w.ledger),
    "duplicate_ingestions": _over_warehouse(lambda w: ledger.duplicate_ingestions(w.landing)),
    # calendar and dimensions
    "vintage_dates": _over_warehouse(vintage_coverage),
    "date_spine": _over_warehouse(daily_volume),
    "type_observations": _over_warehouse(lambda w: w.observations),
    "dim_agency": _over_warehouse(lambda w: w.dim_agency),
    "dim_geography": _over_warehouse(lambda w: w.dim_geography),
    "scd2_dim": _over_warehouse(lambda w: w.dim_complaint_type),
    "fact": _over_warehouse(lambda w: w.fact),
    # marts
    "agency_month": _over_warehouse(lambda w: w.agency_month),
    "cohort_maturity": _over_warehouse(lambda w: w.cohort_maturity.orderBy("cohort_month")),
    "bi_wide": _over_warehouse(lambda w: marts.in_grain_order(w.bi_wide)),
    "bi_export": _over_warehouse(lambda w: _exported(w)[0]),
    "bi_export_parquet": _over_warehouse(lambda w: _exported(w)[1]),
    "bi_reaggregate": _over_warehouse(lambda w: marts.reaggregate(w.bi_wide, ["cohort_year", "agency_code"])),
    "top6_other": _over_warehouse(lambda w: marts.top_agencies_by_month(w.bi_wide, TOP_AGENCIES)),
    # vintages and drift
    "vintage_state": _over_warehouse(lambda w: replay.state_as_of(w.valid, as_ntz(CUTOFF))),
    "vintage_batch": _over_warehouse(lambda w: replay.vintage_batch(w.valid, as_ntz(CUTOFF), as_ntz(PREVIOUS_CUTOFF))),
    "append_only_table": _over_warehouse(lambda w: w.append_only),
    "merge_table": _over_warehouse(lambda w: w.merged),
    "incremental_append": _over_warehouse(lambda w: reduce(append_new, _runs(w))),
    "incremental_merge": _over_warehouse(lambda w: reduce(upsert, _runs(w))),
    "materialized_append": _over_warehouse(lambda w: _in_sessions(w, "materialized_append", Materialized.append_new)),
    "materialized_merge": _over_warehouse(lambda w: _in_sessions(w, "materialized_merge", Materialized.upsert)),
    "materialized_stack": _over_warehouse(lambda w: _in_sessions(w, "materialized_stack", Materialized.stack)),
    "replay_loop": _over_warehouse(lambda w: w.replayed.log),
    "replayed_append": _over_warehouse(lambda w: w.replayed.append_only),
    "replayed_merge": _over_warehouse(lambda w: w.replayed.merged),
    "as_of_carried": _over_warehouse(as_of_carried),
    "missed_closures": _over_warehouse(lambda w: replay.missed_closures(w.append_only, w.merged)),
    "table_disagreement": _over_warehouse(lambda w: replay.measure(w.append_only, w.merged)),
    "high_water_mark": _over_warehouse(lambda w: replay.high_water_mark(w.merged)),
    "drift_log": _over_warehouse(lambda w: w.drift_log),
    "drift_summary": _over_warehouse(lambda w: w.drift_summary.orderBy("vintage_seq")),
    "drift_worst_vintage": _over_warehouse(lambda w: replay.worst_vintage(w.drift_summary)),
    "drift_final_vintage": _over_warehouse(lambda w: replay.final_vintage(w.drift_summary)),
    # reports
    "agency_performance": _over_warehouse(
        lambda w: reports.agency_performance(w.agency_month, w.dim_agency, w.params, min_volume=MIN_VOLUME)
    ),
    "type_version_counts": _over_warehouse(lambda w: reports.type_version_counts(w.dim_complaint_type)),
    "multi_version_pairs": _over_warehouse(lambda w: reports.multi_version_pairs(w.dim_complaint_type)),
    "status_crosstab": _over_warehouse(lambda w: reports.status_crosstab(w.fact)),
    "status_disagreement": _over_warehouse(lambda w: reports.status_disagreement(w.fact, w.dim_agency, w.params)),
    "status_detail": _over_warehouse(lambda w: reports.status_detail(w.fact, w.dim_agency, DETAIL_CODES, w.params)),
    "closure_rate_by_status": _over_warehouse(lambda w: reports.closure_rate_by_status(w.fact, ONE_AGENCY)),
    "maturity_sensitivity": _over_warehouse(lambda w: reports.maturity_sensitivity(w.durations, w.params)),
    "flagged_but_kept": _over_warehouse(lambda w: reports.flagged_but_kept(w.fact)),
    "orphan_keys": _over_warehouse(orphan_keys),
    "backlog_share": _over_warehouse(lambda w: reports.backlog_share(w.fact, w.store)),
    # snapshots
    "snapshot_diff": _over_warehouse(snapshot_diff),
    "field_change_counts": _over_warehouse(
        lambda w: snapshots.field_change_counts(_diff(w), snapshots.PROBE_FIELDS)
    ),
    "snapshot_recheck": _over_warehouse(snapshot_recheck),
    "snapshot_diff_digests": _over_warehouse(snapshot_diff_digests),
    "probe_summary": _over_warehouse(lambda w: snapshots.probe_summary(_diff(w))),
    "probe_capture": _over_warehouse(probe_capture),
    "change_visibility": _over_warehouse(change_visibility),
    "change_examples": _over_warehouse(change_examples),
    # streams
    "stream_ingest": _over_warehouse(stream_ingest),
    "stream_manifest": _over_warehouse(stream_manifest),
    "stream_append_only": _over_warehouse(stream_append_only),
    "stream_merge": _over_warehouse(stream_merge),
    "stream_keyed_merge": _over_warehouse(stream_keyed_merge),
    "stream_changes": _over_warehouse(stream_changes),
    # assertions
    "checks_summary": _over_warehouse(checks.run_checks),
    "checks_on_faults": checks_on_faults,
    "event_durations": event_durations,
}
