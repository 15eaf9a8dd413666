"""Layered tables in the shared folder.

A table that several later steps read is written once and read back. That cuts
the lineage, lets column pruning and filters reach the scan, gives the planner
real sizes, and survives the loss of any executor.

Each write makes a new version of its table in a folder of its own. What was
handed out before keeps reading the version it was made from, so two calls with
different inputs never disturb each other. ``open`` finds the newest complete
version, also from a later session.
"""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Layer names are fixed values and are used verbatim as path parts.
LAYERS = ("raw", "staging", "intermediate", "marts", "comparison")

#: Rows of one stored file. A scan counts a file at its size and its open cost, by default 4 of
#: the 128 MB of a task, so a task gets some 30 files and its sorts have a bound at any size.
ROWS_PER_FILE = 50_000


#: Whether Spark removes the shuffle files of an action with its end, instead of some time later.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """The session with these settings; what was set before is put back."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a local master may fall back to a temporary folder; on a cluster
    without a shared folder nothing can be stored safely, so this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        return tempfile.mkdtemp(prefix="tidemark-")
    raise RuntimeError("no shared folder: set spark.checkpoint.dir or give the store a root")


class Store:
    """Tables under one root. Sample and full builds take different roots.

    With ``reuse``, a table that has a complete version is opened instead of
    written again.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, reuse: bool = False):
        self.spark = spark
        base = shared_root(spark) if root is None else root
        self.root = f"{base}/tidemark-{uuid.uuid4().hex[:12]}"
        self.reuse = reuse

    @classmethod
    def at(cls, spark: SparkSession, root: str, reuse: bool = False) -> "Store":
        """A store that lives exactly at ``root``, so a later session finds it."""
        store = cls(spark, root, reuse)
        store.root = root.rstrip("/")
        return store

    def path(self, layer: str, name: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer!r}")
        return f"{self.root}/{layer}/{name}"

    def versions(self, layer: str, name: str) -> list[str]:
        """Folders of the complete versions of a table, oldest first."""
        jvm = self.spark._jvm
        base = jvm.org.apache.hadoop.fs.Path(self.path(layer, name))
        fs = base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = fs.globStatus(jvm.org.apache.hadoop.fs.Path(base, "v*/_SUCCESS")) if fs.exists(base) else []
        return sorted(str(found.getPath().getParent().toString()) for found in done or [])

    def open(self, layer: str, name: str) -> DataFrame | None:
        """The newest complete version of a table, if there is one."""
        found = self.versions(layer, name)
        return self.spark.read.parquet(found[-1]) if found else None

    def table(
        self,
        layer: str,
        name: str,
        df: DataFrame,
        partition_by: Iterable[str] = (),
    ) -> DataFrame:
        """Write ``df`` as the next version of a table and read it back.

        What was shuffled for it is removed with the end of the write. A partitioned table
        is rebalanced first: a partition's rows come
        together into few files, and one that holds most rows is split.
        """
        if self.reuse and layer != "intermediate":
            held = self.open(layer, name)
            if held is not None:
                return held
        where = f"{self.path(layer, name)}/v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        columns = list(partition_by)
        if columns:
            df = df.hint("rebalance", *columns)
        out = df.write.option("maxRecordsPerFile", ROWS_PER_FILE)
        with settings(self.spark, {CLEAN_UP: "true"}):
            (out.partitionBy(*columns) if columns else out).parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)
