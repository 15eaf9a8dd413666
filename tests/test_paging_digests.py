import math

import pytest
from pyspark.sql import functions as F

from tidemark.catalog import queries
from tidemark.operators import digests, snapshots
from tidemark.operators.distinct import DistinctCounts, relative_error, slice_sketches
from tidemark.operators.pages import ClusteredPages
from tidemark.sources.landing import LANDING_SCHEMA, require_complete
from tidemark.streaming import ingest

ROWS = 5000


@pytest.fixture(scope="module")
def table(spark):
    """Rows in no order, a third of them at one instant."""
    i = F.col("id")
    at = F.when(i % 3 == 0, 777).otherwise(i * 7919 % 1000)
    return spark.range(ROWS, numPartitions=5).select(at.alias("at"), F.concat(F.lit("k"), i).alias("key"), (i * 2).alias("v")).cache()


def test_a_walk_returns_every_row_once_in_order(table, tmp_path):
    pages = ClusteredPages.cluster(table, str(tmp_path / "p"), "at", "key", files=12)
    got = [tuple(r) for p in pages.walk(700) for r in p.collect()]
    assert got == sorted(tuple(r) for r in table.collect())


def test_a_page_opens_only_its_files(table, tmp_path):
    pages = ClusteredPages.cluster(table, str(tmp_path / "p"), "at", "key", files=20)
    per_file = {r["file"]: r["rows"] for r in pages.bounds.collect()}
    assert len(per_file) > 15
    want = [tuple(r) for r in table.orderBy("at", "key").collect()]
    read, at, after = 0, 0, None
    while at < ROWS:
        names = pages.files(100, after)
        page = [tuple(r) for r in pages.page(100, after).collect()]
        assert page == want[at : at + 100]
        read += sum(per_file[n] for n in names)
        at, after = at + len(page), (F.lit(page[-1][0]), F.lit(page[-1][1]))
        assert len(names) <= 3
    # a page of 100 reads at most the rest of one file and what the next one holds
    assert read <= ROWS / 100 * 3 * max(per_file.values())
    assert pages.page(10, (F.lit(10**6), F.lit(""))).collect() == []


def test_numbered_rows_lie_in_the_pages_of_a_walk_without_a_job_per_page(table, spark, tmp_path, monkeypatch):
    pages = ClusteredPages.cluster(table, str(tmp_path / "p"), "at", "key", files=12)
    walked = [(n, tuple(r)) for n, p in enumerate(pages.walk(70), 1) for r in p.collect()]
    got = [(r.page, tuple(r)[:3]) for r in pages.numbered(70).collect()]
    assert sorted(got) == walked and len({n for n, _ in got}) == -(-ROWS // 70)

    class Stub:
        valid = table.select(
            F.timestamp_seconds("at").cast("timestamp_ntz").alias("created_at"), F.col("key").alias("request_id"),
            F.lit("a").alias("agency_code"), F.lit("t").alias("complaint_type"),
        )

        class store:
            path = staticmethod(lambda layer, name: str(tmp_path / name))

    monkeypatch.setattr(ClusteredPages, "page", lambda *a: pytest.fail("a job for one page"))
    monkeypatch.setattr(queries, "WALK_ROWS", 70)
    assert queries.keyset_walk(Stub).count() == -(-ROWS // 70)


def test_numbered_rows_of_an_empty_table(table, tmp_path):
    assert ClusteredPages.cluster(table.filter("false"), str(tmp_path / "p"), "at", "key").numbered(10).collect() == []


def test_the_sum_over_rows_has_no_bound_on_rows(spark):
    """Fails by an overflow where the sum of 48-bit hashes is kept in 64 bits."""
    import hashlib

    rows = spark.range(200_000).select(F.col("id").cast("string").alias("k"))
    want = sum(int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) for i in range(200_000))
    assert want > 1 << 63
    assert rows.agg(queries.content_of("k")).first()[0] == want % (1 << 63)


def test_rows_without_a_cursor_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "at int, key string")
    with pytest.raises(ValueError, match="1 rows"):
        ClusteredPages.cluster(df, str(tmp_path / "p"), "at", "key")


def test_pages_of_an_empty_table(table, tmp_path):
    pages = ClusteredPages.cluster(table.filter("false"), str(tmp_path / "p"), "at", "key")
    assert list(pages.walk(10)) == [] and pages.page(5).collect() == []


@pytest.fixture(scope="module")
def captures(spark):
    i = F.col("id")
    a = spark.range(4000).select(
        F.concat(F.lit("k"), i).alias("unique_key"), F.when(i % 7 != 0, F.lit("open")).alias("status"), F.lit("").alias("note")
    )
    b = a.filter("unique_key != 'k77'").select(
        "unique_key",
        F.when(F.col("unique_key") == "k8", "closed").otherwise(F.col("status")).alias("status"),
        F.when(F.col("unique_key") != "k9", F.col("note")).alias("note"),
    ).unionByName(spark.createDataFrame([("extra", "open", "")], "unique_key string, status string, note string"))
    return a.cache(), b.cache()


def test_digests_find_the_same_differences(captures):
    a, b = captures
    got = digests.diff_by_digests(a, b, "unique_key", ["status", "note"], 512)
    want = snapshots.snapshot_diff(a, b, "unique_key", ["status", "note"])
    assert got.count() == 4000 and got.exceptAll(want).count() == 0
    changed = {r.unique_key: r.changed_fields for r in got.filter("size(changed_fields) > 0 or disappeared").collect()}
    assert changed == {"k8": ["status"], "k9": ["note"], "k77": []}


def test_only_buckets_that_differ_are_compared(captures):
    a, b = captures
    d = [digests.bucket_digests(x, "unique_key", ["status", "note"], 512) for x in (a, b)]
    apart = {r.bucket for r in digests.differing_buckets(*d).collect()}
    keys = a.unionByName(b).filter("unique_key in ('k8', 'k9', 'k77', 'extra')")
    assert apart == {r[0] for r in keys.select(digests.bucket_of("unique_key", 512)).distinct().collect()}
    assert digests.differing_buckets(d[0], d[0]).collect() == []


def test_digests_tell_null_from_empty_and_swapped_fields(spark):
    def one(*row):
        df = spark.createDataFrame([row], "k string, a string, b string")
        return digests.bucket_digests(df, "k", ["a", "b"], 4).first()

    rows = [one("k", None, ""), one("k", "", None), one("k", "", ""), one("k", "x", "y"), one("k", "y", "x")]
    assert len({(r.sum_a, r.sum_b) for r in rows}) == 5


def test_distinct_counts_are_kept_by_slice(spark, tmp_path):
    i = F.col("id")
    rows = spark.range(60_000).select((i % 20_000).cast("string").alias("key"), F.concat(F.lit("s"), F.floor(i / 15_000)).alias("s"))
    rows = rows.unionByName(spark.createDataFrame([(None, "s0")], "key string, s string"))
    path, label = str(tmp_path / "d"), F.col("s")
    for part in ("s0", "s1", "s2", "s3", "s1"):  # one slice is pulled again
        DistinctCounts(spark, path).replace(slice_sketches(rows.filter(label == part), label, "key"))
    kept = DistinctCounts(spark, path)
    for r in kept.per_slice().collect():
        assert r.rows == 15_000 + (r.slice == "s0")
        assert math.isclose(r.distinct_keys, 15_000, rel_tol=3 * relative_error())
    whole = kept.over().first()
    assert whole.rows == 60_001 and math.isclose(whole.distinct_keys, 20_000, rel_tol=3 * relative_error())
    assert kept.over(F.col("slice") == "none").first().distinct_keys == 0


def test_progress_of_slices_is_committed_with_the_rows(spark, landing_rows, tmp_path):
    arrivals, landing, progress = (str(tmp_path / n) for n in ("in", "landing", "progress"))

    def arrive(*rows):
        landing_rows(*rows).coalesce(1).write.mode("append").json(arrivals)

    def dies(batch_id):
        raise RuntimeError("lost between rows and progress")

    arrive({"unique_key": "1", "created_date": "2025-01-03"}, {"unique_key": "2", "created_date": "2025-02-03"})
    ingest.ingest_slices(spark, arrivals, landing, progress)
    arrive({"unique_key": "3", "created_date": "2025-02-05"}, {"unique_key": "4", "created_date": "2025-02-05"})
    with pytest.raises(Exception, match="lost between"):
        ingest.ingest_slices(spark, arrivals, landing, progress, after_rows=dies)
    expected = spark.createDataFrame([("2025-01", 1), ("2025-02", 3), ("2025-03", 2)], "slice string, rows long")
    left = ingest.slice_manifest(spark, landing, expected)
    assert {r.slice: (r.rows, r.complete) for r in left.collect()} == {
        "2025-01": (1, True), "2025-02": (1, False), "2025-03": (0, False),
    }
    assert ingest.landed_slices(spark, landing).count() == 2
    with pytest.raises(RuntimeError, match="2 open slices"):
        require_complete(left)
    arrive({"unique_key": "5", "created_date": "2025-03-01"}, {"unique_key": "6", "created_date": "2025-03-01"})
    ingest.ingest_slices(spark, arrivals, landing, progress)
    done = ingest.slice_manifest(spark, landing, expected)
    require_complete(done)
    assert {(r.slice, r.rows, r.last_sort, r.last_key) for r in done.collect()} == {
        ("2025-01", 1, "2025-01-03", "1"), ("2025-02", 3, "2025-02-05", "4"), ("2025-03", 2, "2025-03-01", "6"),
    }
    rows = ingest.landed_slices(spark, landing)
    assert rows.count() == rows.select("unique_key").distinct().count() == 6
    assert rows.columns == [*LANDING_SCHEMA.names, "slice"]
