import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sampling
from tidemark.store import CLEAN_UP, Store, shared_root


def test_partitioned_table_prunes_and_reads_back(spark, store):
    df = spark.range(1000).withColumn("month", (F.col("id") % 3).cast("string"))
    back = store.table("marts", "t", df, ["month"])
    assert back.count() == 1000 and sorted(back.columns) == ["id", "month"]
    plan = back.filter("month = '1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_a_second_write_leaves_the_first_readable(spark, store):
    first = store.table("marts", "t", spark.range(3))
    second = store.table("marts", "t", spark.range(5))
    assert (first.count(), second.count()) == (3, 5)
    assert len(store.versions("marts", "t")) == 2 and store.open("marts", "t").count() == 5


def test_two_samples_on_one_store_stay_right(spark, params, store):
    keys = [f"{i:03d}" for i in range(60)]
    df = spark.createDataFrame([("x", k) for k in keys], "s string, key string")
    five = sampling.systematic_sample(df, "s", "key", params, store, 5)
    two = sampling.systematic_sample(df.filter("key < '030'"), "s", "key", params, store, 2)
    assert sorted(r.key for r in five.collect()) == keys[::12]
    assert sorted(r.key for r in two.collect()) == keys[:30:15]
    assert sorted(r.key for r in five.collect()) == keys[::12]


def test_a_later_store_opens_what_exists(spark, tmp_path):
    root = str(tmp_path / "kept")
    Store.at(spark, root).table("marts", "t", spark.range(4))
    later = Store.at(spark, root, reuse=True)
    assert later.table("marts", "t", spark.range(9)).count() == 4
    assert later.table("marts", "other", spark.range(9)).count() == 9
    assert later.table("intermediate", "t", spark.range(2)).count() == 2
    assert later.open("staging", "t") is None


def session(named, master):
    """Only what the choice of the folder looks at."""
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: named or default),
        sparkContext=SimpleNamespace(master=master),
    )


def test_root_comes_from_the_session(spark):
    named = session("hdfs:///shared/", "spark://host:7077")
    assert shared_root(named) == "hdfs:///shared"
    assert Store(named).root.startswith("hdfs:///shared/tidemark-")
    assert "tidemark-" in shared_root(session(None, "local[2]"))
    with pytest.raises(ValueError):
        Store(named).path("elsewhere", "t")


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[2,1,1024]", "yarn"])
def test_without_a_shared_folder_a_cluster_stops(master):
    with pytest.raises(RuntimeError):
        Store(session(None, master))


def test_a_stored_file_has_a_bound_on_its_rows(spark, store, monkeypatch):
    """A scan packs files into tasks by their size, so this bounds what a task sorts."""
    monkeypatch.setattr("tidemark.store.ROWS_PER_FILE", 10)
    held = store.table("staging", "bounded", spark.range(100, numPartitions=2).toDF("id"))
    assert len(held.inputFiles()) == 10 and held.count() == 100


def test_a_stored_table_leaves_no_shuffle_files(spark, store):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = blocks.getAllBlocks()
        return {n for n in (found.apply(i).name() for i in range(found.size())) if n.startswith("shuffle_")}

    setting, before = spark.conf.get(CLEAN_UP), shuffled()
    frames = [spark.range(1000).selectExpr(f"id % {n} AS k").groupBy("k").count() for n in (5, 7, 11)]
    held = [store.table("raw", "counts", df) for df in frames]
    for _ in range(10):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(CLEAN_UP) == setting
    for df, back in zip(frames, held):
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
