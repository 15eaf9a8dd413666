import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.materialized import BUCKET, CommitConflict, Materialized

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.LongType()), T.StructField("note", T.StringType())])


@pytest.fixture
def table(spark, tmp_path):
    def session(buckets=8):
        """A handle that knows nothing but the folder, as a later session does."""
        return Materialized(spark, str(tmp_path / "t"), SCHEMA, "id", buckets, watermark="v")

    return session


@pytest.fixture
def rows(spark):
    return lambda *data: spark.createDataFrame(list(data), SCHEMA)


def found(t):
    return {r.id: (r.v, r.note) for r in t.read().collect()}


def folders(t):
    return {n: sorted(t.folder.names(f"data/{n}")) for n in t.folder.names("data")}


def test_two_sessions_append_and_the_first_state_wins(table, rows):
    table().append_new(rows(("a", 1, "x"), ("b", 1, "x"), (None, 1, "n")))
    table().append_new(rows(("a", 2, "late"), ("c", 2, "y"), (None, 2, "late")))
    assert found(table()) == {"a": (1, "x"), "b": (1, "x"), "c": (2, "y"), None: (1, "n")}
    assert table().high_water_mark() == "2"
    assert table().state()["number"] == 2


def test_upsert_writes_only_the_buckets_of_its_keys(spark, table, rows):
    t = table(32)
    t.upsert(spark.range(400).select(F.col("id").cast("string").alias("id"), F.lit(1).cast("long").alias("v"), F.lit("x").alias("note")))
    first = folders(t)
    assert len([n for n in next(iter(first.values())) if n.startswith(BUCKET)]) == 32
    batch = rows(("7", 2, "new"), ("8", 2, "new"), ("9999", 2, "new"))
    touched = {f"{BUCKET}={b}" for b in t._touched(batch)}
    table(32).upsert(batch)
    (added,) = set(folders(t)) - set(first)
    assert {n for n in folders(t)[added] if n.startswith(BUCKET)} == touched and len(touched) <= 3
    assert {k: v for k, v in folders(t).items() if k != added} == first
    got = found(table(32))
    assert len(got) == 401 and got["7"] == got["9999"] == (2, "new") and got["10"] == (1, "x")


def test_stacked_deltas_settle_into_the_same_table(table, rows):
    for v in range(1, 4):
        table().stack(rows(("a", v, "x"), (f"k{v}", v, "y"), (None, v, "n")))
    want = {"a": (3, "x"), "k1": (1, "y"), "k2": (2, "y"), "k3": (3, "y"), None: (3, "n")}
    assert found(table()) == want
    table().settle()
    t = table()
    assert all(len(names) == 1 for names in t.state()["files"].values())
    assert found(t) == want
    before = t.state()
    t.settle()
    assert t.state() == before


def test_a_run_that_dies_between_data_and_commit_is_not_seen(table, rows, monkeypatch):
    t = table()
    t.upsert(rows(("a", 1, "x")))
    with monkeypatch.context() as m:
        m.setattr(Materialized, "_take", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            t.upsert(rows(("a", 2, "y"), ("b", 2, "y")))
    assert found(table()) == {"a": (1, "x")} and table().high_water_mark() == "1"
    table().upsert(rows(("a", 2, "y"), ("b", 2, "y")))
    assert found(table()) == {"a": (2, "y"), "b": (2, "y")}
    orphaned = [n for n in t.folder.names("data")]
    assert len(orphaned) == 3
    table().expire(keep=1, grace_seconds=0)
    assert len(t.folder.names("data")) == 1 and found(table()) == {"a": (2, "y"), "b": (2, "y")}


def test_the_second_of_two_runs_from_one_commit_conflicts(table, rows, monkeypatch):
    t = table()
    t.upsert(rows(("a", 1, "x")))
    stale = t.state()
    table().upsert(rows(("a", 2, "y")))
    monkeypatch.setattr(t, "state", lambda: stale)
    with pytest.raises(CommitConflict):
        t.upsert(rows(("a", 3, "z")))
    assert found(table()) == {"a": (2, "y")}


def test_expiry_keeps_what_kept_commits_name(table, rows):
    t = table()
    t.append_new(rows(*[(str(i), 1, "x") for i in range(40)]))
    t.upsert(rows(("1", 2, "y")))
    t.upsert(rows(("1", 3, "z")))
    earlier = t.state()["number"]
    assert t.expire(keep=3, grace_seconds=0) == []
    gone = t.expire(keep=1, grace_seconds=0)
    assert any(g.startswith("commits/") for g in gone) and any(BUCKET in g for g in gone)
    assert t.state()["number"] == earlier and len(found(t)) == 40 and found(t)["1"] == (3, "z")
    assert t.expire(keep=1) == []


def test_young_data_is_left_alone(table, rows):
    t = table()
    t.upsert(rows(("a", 1, "x")))
    t.upsert(rows(("a", 2, "x")))
    assert all(g.startswith("commits/") for g in t.expire(keep=1))
    assert len(t.folder.names("data")) == 2


def test_another_table_in_the_folder_is_refused(spark, table, rows, tmp_path):
    table().upsert(rows(("a", 1, "x")))
    with pytest.raises(ValueError, match="another table"):
        Materialized(spark, str(tmp_path / "t"), T.StructType([T.StructField("id", T.LongType())]), "id")


def test_the_high_water_mark_compares_values_not_texts(table, rows):
    for v in (9, 10, 2):
        table().stack(rows(("a", v, "x")))
    assert table().high_water_mark() == "10"


def test_empty_table_and_empty_batch(table, rows):
    t = table()
    assert t.read().collect() == [] and t.high_water_mark() is None
    t.append_new(rows())
    assert t.read().collect() == [] and t.read().columns == SCHEMA.names
    t.upsert(rows(("a", 1, None)))
    t.upsert(rows())
    assert found(t) == {"a": (1, None)} and t.high_water_mark() == "1"
