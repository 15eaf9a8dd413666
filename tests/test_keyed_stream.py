import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators.latest import latest_per_key
from tidemark.streaming import keyed

SCHEMA = "id string, at int, closed string, note string"
PARTS = [
    [("a", 1, None, "x"), ("b", 1, None, "x"), (None, 1, None, "n"), ("", 1, None, "empty")],
    [("a", 2, "c1", "x"), ("a", 2, "c2", "x"), ("c", 1, "c", None), ("b", 0, "old", "y")],
    [("b", 1, None, "y"), (None, 3, None, "m"), ("c", 1, "c", None), ("a", 2, None, "z")],
]


@pytest.fixture
def feed(spark, tmp_path):
    def stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return arrive, stream, str(tmp_path / "changes"), str(tmp_path / "progress")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_state_is_the_newest_row_of_each_key_after_a_restart_in_the_middle(spark, feed):
    arrive, stream, target, progress = feed
    arrive(PARTS[0])
    keyed.merge_available(stream(), target, progress, "id", ["at", "closed"])
    arrive(PARTS[1])
    arrive(PARTS[2])

    def dies(batch_id):
        if batch_id == 1:
            raise RuntimeError("lost in the middle of a batch, its changes written")

    with pytest.raises(Exception, match="lost in the middle"):
        keyed.merge_available(stream(), target, progress, "id", ["at", "closed"], dies)
    keyed.merge_available(stream(), target, progress, "id", ["at", "closed"])

    log = spark.createDataFrame(sum(PARTS, []), SCHEMA)
    state = keyed.read_state(spark, progress, log.schema)
    assert rows(state) == rows(latest_per_key(log, "id", ["at", "closed"]))
    assert state.count() == log.select("id").distinct().count()

    changes = keyed.read_changes(spark, target, log.schema)
    new = changes.filter(F.col("change") == keyed.NEW)
    assert rows(new.select("id")) == rows(log.select("id").distinct())
    # a row that is not newer than the held one is no change
    assert changes.filter("id = 'b'").count() == 2 and changes.filter("id = 'c'").count() == 1
    last = changes.withColumn("n", F.row_number().over(keyed_window())).filter("n = 1").drop("n", "change", "batch_id")
    assert rows(last) == rows(state)


def keyed_window():
    from pyspark.sql import Window

    return Window.partitionBy("id").orderBy(F.desc("batch_id"))


def test_the_store_of_the_session_is_put_back(spark):
    before = spark.conf.get(keyed.PROVIDER, None)
    with keyed.rocksdb(spark):
        assert spark.conf.get(keyed.PROVIDER) == keyed.ROCKSDB
    assert spark.conf.get(keyed.PROVIDER, None) == before


def test_changes_are_found_without_a_python_call_per_key(spark, feed):
    """Keys are compared by Spark's own aggregate: no worker is started for a row or a key."""
    arrive, stream, target, progress = feed
    arrive(PARTS[0])
    with keyed.rocksdb(spark):
        query = keyed.changes(stream(), "id", ["at", "closed"]).writeStream.outputMode("update").format("noop")
        query = query.option("checkpointLocation", progress).trigger(availableNow=True).start()
        query.awaitTermination()
        plan = query._jsq.explainInternal(False)
    assert "StateStoreSave" in plan and "Python" not in plan and "Pandas" not in plan


def test_equal_and_older_rows_are_no_change_however_often_they_come(spark, feed):
    arrive, stream, target, progress = feed
    for _ in range(3):
        arrive([("a", 2, None, "x"), (None, 1, None, None)])
        keyed.merge_available(stream(), target, progress, "id", ["at", "closed"])
    arrive([("a", 2, "c", None), ("a", 1, "z", "z")])
    keyed.merge_available(stream(), target, progress, "id", ["at", "closed"])
    got = keyed.read_changes(spark, target, spark.createDataFrame([], SCHEMA).schema).collect()
    assert sorted(((r.id, r.closed, r.change, r.batch_id) for r in got), key=repr) == sorted(
        [("a", None, "new", 0), (None, None, "new", 0), ("a", "c", "restated", 3)], key=repr
    )


def test_a_run_leaves_no_copy_of_its_state_and_no_shuffle_files(spark, feed):
    """What stays of a run are the checkpoint and the changes; else every run's own copy of the state stays on disk."""
    from pathlib import Path

    arrive, stream, target, progress = feed
    local = Path(spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf()))
    left = lambda: {p for p in local.rglob("*") if p.suffix == ".sst" or p.name.startswith("MANIFEST")}
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = blocks.getAllBlocks()
        return {n for n in (found.apply(i).name() for i in range(found.size())) if n.startswith("shuffle_")}

    before, shuffles = left(), shuffled()
    for part in PARTS:
        arrive(part)
        keyed.merge_available(stream(), target, progress, "id", ["at", "closed"])
    for _ in range(50):
        if not (left() - before or shuffled() - shuffles):
            break
        time.sleep(0.2)
    assert not left() - before and not shuffled() - shuffles
    log = spark.createDataFrame(sum(PARTS, []), SCHEMA)
    assert rows(keyed.read_state(spark, progress, log.schema)) == rows(latest_per_key(log, "id", ["at", "closed"]))


def test_the_state_of_alike_rows_is_packed(spark, feed, tmp_path):
    """Rows of many keys share most of their words: a tenth of their text is the most that the state may take."""
    arrive, stream, target, progress = feed
    words = [" ".join(f"{w}{i % 7}" for w in ("department", "complaint", "address", "district", "channel") * 8) for i in range(7)]
    arrive([(str(i), i, None, words[i * i % 7]) for i in range(20_000)])
    keyed.merge_available(stream(), target, progress, "id", ["at", "closed"])
    state = sum(p.stat().st_size for p in tmp_path.rglob("*.sst"))
    assert 0 < state < sum(len(words[i * i % 7]) for i in range(20_000)) / 10
