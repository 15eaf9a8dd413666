import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidemark.catalog.queries import REGISTERED
from tidemark.functions import as_ntz
from tidemark.operators import sampling, snapshots
from tidemark.operators.latest import paired_states
from tidemark.plans import marts, reports
from tidemark.sources import export, landing
from tidemark.sources.landing import LANDING_SCHEMA
from tidemark.streaming import incremental, ingest


def row(key, **more):
    return {"unique_key": key, "created_date": "2025-02-01 08:00:00", "_ingested_at": "2025-03-01 00:00:00", **more}


def test_ndjson_round_trip_keeps_text_and_absent_fields(spark, landing_rows, tmp_path):
    where = str(tmp_path / "log")
    df = landing_rows(row("1", latitude="040.70"), row("2", created_date="2025-03-01 00:00:00")).drop("_ingested_at")
    landing.append_ndjson(df, where, "2025-04-01 00:00:00")
    landing.append_ndjson(df.limit(1), where, "2025-04-02 00:00:00")
    back = landing.scan_ndjson(spark, where)
    assert back.schema.fieldNames()[: len(LANDING_SCHEMA)] == LANDING_SCHEMA.fieldNames()
    assert all(f.dataType.simpleString() == "string" for f in back.select(*LANDING_SCHEMA.fieldNames()).schema)
    assert back.count() == 3 and back.filter("latitude = '040.70'").count() == 2
    assert {r.slice for r in spark.read.json(where).select("slice").collect()} == {"2025-02", "2025-03"}


def test_replacing_a_slice_leaves_the_others(spark, landing_rows, tmp_path):
    where = str(tmp_path / "slices")
    landing.replace_slices(landing_rows(row("1"), row("2", created_date="2025-03-01 00:00:00")), where)
    landing.replace_slices(landing_rows(row("1"), row("3")), where)
    assert sorted(r.unique_key for r in spark.read.parquet(where).collect()) == ["1", "2", "3"]


def test_manifest_ties_out_or_stops(spark, landing_rows):
    slices = {"2025-02": {"rows": 2, "complete": True}, "2025-03": {"rows": 1, "complete": False}}
    text = json.dumps({"slices": slices})
    manifest = landing.parse_manifest(spark, text)
    got = landing.manifest_tieout(landing_rows(row("1"), row("2")), manifest)
    assert {r.slice: r.ties_out for r in got.collect()} == {"2025-02": True, "2025-03": False}
    with pytest.raises(RuntimeError):
        landing.require_complete(manifest)
    with pytest.raises(RuntimeError):
        landing.require_tieout(got)
    landing.require_complete(manifest.filter("complete"))


def test_source_slice_reaches_the_scan(spark, landing_rows, tmp_path):
    where = str(tmp_path / "p")
    landing_rows(row("1", agency="A"), row("2", agency="B")).write.parquet(where)
    got = landing.source_slice(
        spark.read.parquet(where), F.lit("2025-02-01"), F.lit("2025-03-01"), agencies=["A"], columns=["unique_key"]
    )
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_date" in plan
    assert "ReadSchema: struct<unique_key:string,created_date:string,agency:string>" in plan
    assert [r.unique_key for r in got.collect()] == ["1"]


def test_profile_counts_keys_once(landing_rows):
    log = landing_rows(row("1"), row("1"), row(None), row("1", created_date="2025-03-02 00:00:00"))
    got = landing.landing_profile(log).collect()
    assert {(r.scope, r.slice): (r.row_count, r.distinct_keys) for r in got} == {
        ("all", None): (4, 1), ("slice", "2025-02"): (3, 1), ("slice", "2025-03"): (1, 1),
    }


@pytest.mark.parametrize("n, k", [(3, 5), (5, 5), (12, 5), (23, 5), (40, 5)])
def test_systematic_sample_equals_a_sorted_stride(spark, params, store, n, k):
    keys = [f"{i:04d}" for i in range(n)]
    df = spark.createDataFrame([(s, key) for s in ("x", "y") for key in keys], "s string, key string")
    got = sampling.systematic_sample(df, "s", "key", params, store, k)
    want = keys if n <= k else keys[:: n // k][:k]
    by = {}
    for r in got.collect():
        by.setdefault(r.s, []).append(r.key)
    assert {s: sorted(v) for s, v in by.items()} == {"x": want, "y": want}


def test_positions_of_a_hot_stratum_cross_ranges(spark, params, store):
    df = spark.range(5000).select(F.lit("hot").alias("s"), F.format_string("%05d", "id").alias("key"))
    got = sampling.stratum_positions(df, "s", "key", params, store, partitions=7)
    assert got.filter("position <> cast(key as bigint) or stratum_size <> 5000").count() == 0
    stored = store.open("intermediate", "positions_s_key")
    assert stored.select("_range").distinct().count() == 7


def test_keyset_pages_walk_the_whole_table(spark, ntz):
    rows = [("2025-01-01 00:00:00", f"{i}") for i in range(5)] + [("2025-01-02 00:00:00", "0")]
    df = ntz(rows, "at string, key string", ["at"])
    seen, after = [], None
    while True:
        page = sampling.keyset_page(df, "at", "key", 2, after).collect()
        if not page:
            break
        seen += [(str(r["at"]), r["key"]) for r in page]
        after = (as_ntz(page[-1]["at"]), F.lit(page[-1]["key"]))
    assert seen == rows


def test_top_n_or_other(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1), ("a", 1)], "label string, n long")
    got = sampling.top_n_or_other(df, "label", "n", 2).groupBy("label").agg(F.sum("n").alias("n"))
    assert {r.label: r.n for r in got.collect()} == {"a": 6, "b": 3, "Other": 4}


def test_top_n_keeps_a_null_label_and_one_named_like_the_rest(spark):
    rows = [(None, 10), ("a", 5), ("b", 3), ("Other", 4)]
    df = spark.createDataFrame(rows, "label string, n long")
    got = sampling.top_n_or_other(df, "label", "n", 3).collect()
    assert sorted(((r.label, r.n, r.is_other) for r in got), key=repr) == sorted(
        [(None, 10, False), ("a", 5, False), ("Other", 4, False), ("Other", 3, True)], key=repr
    )


FIELDS = snapshots.PROBE_FIELDS


def test_snapshot_diff(spark, landing_rows):
    a = landing_rows(
        row("same"), row("one", status="Open"), row("two", status="Open", agency="A"), row("null"), row("gone")
    )
    b = landing_rows(
        row("same"), row("one", status="Closed"), row("two", status="Closed", agency="B"),
        row("null", descriptor="x"), row("new"),
    )
    a = snapshots.capture(a, scope="all")
    diff = snapshots.snapshot_diff(a, snapshots.recheck(b, a), "unique_key", FIELDS)
    got = {r.unique_key: (r.disappeared, r.changed_fields) for r in diff.collect()}
    assert got == {
        "same": (False, []), "one": (False, ["status"]), "two": (False, ["status", "agency"]),
        "null": (False, ["descriptor"]), "gone": (True, []),
    }
    counts = {r.field: r.changed for r in snapshots.field_change_counts(diff, FIELDS).collect()}
    assert counts["status"] == 2 and counts["agency"] == 1 and counts["created_date"] == 0
    s = snapshots.probe_summary(diff).first()
    assert (s.sample_size, s.refetched, s.disappeared_from_source, s.requests_changed) == (5, 4, 1, 3)
    assert s.requests_changed_pct == 60.0 and s.zero_event_upper_bound == 0.6
    assert [r.unique_key for r in snapshots.change_examples(diff, "unique_key", 2).collect()] == ["null", "one"]


def test_capture_reads_dates_as_staging_does(landing_rows):
    """A bare year is no date; order is by instant; without a date nothing is captured."""
    df = landing_rows(
        row("year", created_date="2031"), row("b", created_date="2001/5/2 00:00:00"),
        row("a", created_date="2001-05-01 00:00:00"), row("old", created_date="2001-04-30 00:00:00"),
    )
    assert {r.unique_key for r in snapshots.capture(df).collect()} == {"a", "b"}
    assert [r.unique_key for r in snapshots.capture(df, 1).collect()] == ["a"]
    assert [r.unique_key for r in snapshots.capture(df, scope="complete_month").collect()] == ["old"]
    assert snapshots.capture(landing_rows(row("x", created_date="2031"))).collect() == []


def test_change_visibility(spark, landing_rows):
    a = landing_rows(row("same"), row("one", status="Open"), row("two", status="Open", agency="A"), row("gone"))
    b = landing_rows(row("same"), row("one", status="Closed"), row("two", status="Closed", agency="B"))
    diff = snapshots.snapshot_diff(a, b, "unique_key", FIELDS)
    got = {r.replay_sees_it: (r.changes, r.requests_touched) for r in snapshots.change_visibility(diff, FIELDS).collect()}
    assert got == {True: (2, 2), False: (1, 1)}


def test_capture_scopes(landing_rows):
    df = landing_rows(
        row("a"), row("b", created_date="2025-03-05 00:00:00"), row("c", created_date="2025-03-01 00:00:00")
    )
    assert [r.unique_key for r in snapshots.capture(df, 1).collect()] == ["c"]
    assert [r.unique_key for r in snapshots.capture(df, scope="complete_month").collect()] == ["a"]
    with pytest.raises(ValueError):
        snapshots.capture(df, scope="year")


def test_paired_states_equal_two_resolutions(landing_rows):
    log = landing_rows(
        row("a", status="1"), row("a", status="2", _ingested_at="2025-03-02 00:00:00"),
        row("b", status="9", _ingested_at="2025-03-02 00:00:00"), row("c", status="x"), row("c", status="y"),
        row("d", status="u", _ingested_at=None),
    )
    upto = "2025-03-01 00:00:00"
    got = paired_states(log, "unique_key", ["_ingested_at", "closed_date"], FIELDS, upto)
    assert {r.unique_key: (r.before and r.before.status, r.after.status) for r in got.collect()} == {
        "a": ("1", "2"), "b": (None, "9"), "c": ("y", "y"), "d": (None, "u"),
    }


def test_ingest_resumes_without_loss_or_repetition(spark, tmp_path):
    arrivals, where, progress = (str(tmp_path / n) for n in ("arrivals", "landing", "progress"))
    (tmp_path / "arrivals").mkdir()

    def arrive(name, keys):
        with gzip.open(tmp_path / "arrivals" / name, "wt") as f:
            for k in keys:
                f.write(json.dumps({"unique_key": k, "created_date": "2025-02-01 00:00:00"}) + "\n")

    arrive("a.json.gz", ["1", "2"])
    ingest.ingest_available(spark, arrivals, where, progress)
    arrive("b.json.gz", ["3"])
    ingest.ingest_available(spark, arrivals, where, progress, files_per_batch=1)
    ingest.ingest_available(spark, arrivals, where, progress)
    assert sorted(r.unique_key for r in ingest.landed(spark, where).collect()) == ["1", "2", "3"]


def test_streams_keep_first_and_last_state(spark, landing_rows, tmp_path):
    order = ["_ingested_at", "closed_date"]
    later, latest = "2025-03-02 00:00:00", "2025-03-03 00:00:00"
    first = landing_rows(row("a", status="1"), row("a", status="2", _ingested_at=later), row(None, status="n"))
    second = landing_rows(
        row("a", status="3", _ingested_at=latest), row("b", status="1", _ingested_at=latest), row(None, status="m")
    )
    src, a, m = (str(tmp_path / n) for n in ("src", "append", "merge"))
    for delivery in (first, second):
        delivery.write.mode("append").parquet(src)
        stream = spark.readStream.schema(LANDING_SCHEMA).parquet(src)
        incremental.run_available(stream, incremental.append_only_sink(a, "unique_key", order, LANDING_SCHEMA), a + "_p")
        incremental.run_available(stream, incremental.merge_sink(m, "unique_key", order), m + "_p")
    kept = {r.unique_key: r.status for r in incremental.read_append_only(spark, a, LANDING_SCHEMA).collect()}
    merged = incremental.read_merged(spark, m, LANDING_SCHEMA, "unique_key", order)
    last = {r.unique_key: r.status for r in merged.collect()}
    assert kept == {"a": "1", "b": "1", None: "n"}
    assert last["a"] == "3" and last["b"] == "1"
    # a batch that is repeated replaces itself
    incremental.append_only_sink(a, "unique_key", order, LANDING_SCHEMA)(second, 1)
    assert incremental.read_append_only(spark, a, LANDING_SCHEMA).count() == 3
    # settled after the second batch: the base and what comes after it read alike
    settle = incremental.merge_sink(m, "unique_key", order, LANDING_SCHEMA, settle_every=2)
    settle(second, 1)
    before = {r.unique_key: r.status for r in merged.collect()}
    assert incremental._ids(spark, m, "base_id") == [1]
    settle(landing_rows(row("z", status="new")), 2)
    after = incremental.read_merged(spark, m, LANDING_SCHEMA, "unique_key", order)
    assert {r.unique_key: r.status for r in after.collect()} == before | {"z": "new"}
    for sink in (settle, incremental.append_only_sink(a, "unique_key", order, LANDING_SCHEMA)):
        with pytest.raises(RuntimeError):  # a lost checkpoint starts again at batch 0
            sink(second, 0)


def test_stateful_first_seen_stream(spark, landing_rows, tmp_path):
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        src = str(tmp_path / "src")
        for status in ("1", "2"):
            landing_rows(row("a", status=status)).write.mode("append").parquet(src)
            stream = incremental.first_seen_stream(spark.readStream.schema(LANDING_SCHEMA).parquet(src), "unique_key")
            stream.writeStream.option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start(
                str(tmp_path / "out")
            ).awaitTermination()
        assert [r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["1"]
    finally:
        spark.conf.set(conf, before)


def test_export_rounds_only_floats_and_repeats(spark, tmp_path):
    small = "/root/testdata/sf0.001"
    wide = REGISTERED["bi_wide"](spark, small)
    assert export.round_floats(wide).schema["request_volume"].dataType.simpleString() == "bigint"
    texts = []
    for n, parts in enumerate(("3", "9")):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        export.export_wide(wide, str(tmp_path / str(n)))
        files = sorted((tmp_path / str(n) / "csv").glob("part-*.csv"))
        lines = [line for f in files for line in f.read_text().splitlines()]
        texts.append([line for line in lines if not line.startswith("cohort_month")])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert texts[0] == texts[1] and len(texts[0]) == wide.count()
    grain = wide.groupBy(*marts.BI_GRAIN).count().filter("count > 1")
    assert grain.count() == 0


def test_sensitivity_marks_windows_with_too_few_cohorts(spark, ntz, params):
    facts = ntz(
        [
            ("2025-01-01 00:00:00", "2025-01-03 00:00:00"),
            ("2025-02-01 00:00:00", "2025-02-08 00:00:00"),
            ("2025-05-20 00:00:00", None),
        ],
        "created_at string, closed_at string", ["created_at", "closed_at"],
    )
    facts = facts.select(F.trunc("created_at", "MM").alias("cohort_month"), "*", F.lit(True).alias("is_within_target"))
    histogram = marts.duration_histogram(facts, ["cohort_month"])
    rows = {r.window_days: r for r in reports.maturity_sensitivity(histogram, params, [30, 120, 180]).collect()}
    assert (rows[30].mature_cohorts, rows[30].delta, rows[30].direction) == (2, 5.0, "slower")
    assert (rows[120].mature_cohorts, rows[120].delta, rows[120].direction) == (1, None, "too few")
    assert rows[180].mature_cohorts == 0


def test_absent_status_disagrees_with_nothing(spark, ntz, params):
    facts = ntz(
        [("A", "2025-01-01 00:00:00", "2025-01-03 00:00:00", True, s) for s in ("Closed", "Open", None)],
        "agency_key string, created_at string, closed_at string, is_closed boolean, status_raw string",
        ["created_at", "closed_at"],
    )
    agency = spark.createDataFrame([("A", "A")], "agency_key string, agency_code string")
    r = reports.status_disagreement(facts, agency, params).first()
    assert (r.disagreeing, r.mean_days, r.share_of_agency) == (1, 2.0, 1 / 3)
    crosstab = reports.status_crosstab(facts).collect()
    assert {(x.source_says_closed, x.requests) for x in crosstab} == {(True, 1), (False, 1), (None, 1)}


def test_newest_month_ignores_the_session_zone(spark, landing_rows):
    df = landing_rows(row("a", created_date="2025-03-01 00:30:00"), row("b", created_date="2025-02-28 23:00:00"))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r.unique_key for r in snapshots.capture(df).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["a"]


def test_sample_is_written_with_its_manifest(spark, landing_rows, params, store, tmp_path):
    where = str(tmp_path / "sample")
    log = landing_rows(*[row(f"{i:03d}") for i in range(12)], row(None), row("x", created_date="2025-03-01 00:00:00"))
    manifest = landing.write_sample(log, where, params, store, per_slice=5)
    assert {r.slice: (r.rows, r.complete) for r in manifest.collect()} == {"2025-02": (5, True), "2025-03": (1, True)}
    back = landing.scan_ndjson(spark, where)
    assert sorted(r.unique_key or "" for r in back.collect()) == ["", "001", "003", "005", "007", "x"]
    assert all(r.ties_out for r in landing.manifest_tieout(back, manifest).collect())
