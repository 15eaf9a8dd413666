"""Tables that later sessions extend: data folders, and commits that say which of them count.

Rows lie in buckets of their key. A run writes one new data folder with the buckets it
changes, and nothing that exists is touched; then a commit, a small file that names for
each bucket the folders that hold it, base first, deltas after, takes effect as a whole by
being renamed into place. A run that dies before that leaves a folder that no commit names.
Two runs from the same commit cannot both take effect: the second finds its number taken.

What a run reads and writes follows from the buckets its keys fall into:

* ``append_new`` reads the key column of those buckets and adds a delta, first state wins;
* ``upsert`` rewrites those buckets, last state wins;
* ``stack`` only adds a delta; readers let the newest delta of a key win, until ``settle``
  folds the deltas of a bucket into a base.

The shared folder must be on a file system whose rename is atomic.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.latest import latest_per_key

BUCKET, SEQ = "key_bucket", "_delta"


class CommitConflict(RuntimeError):
    """Another run has committed since this one read the table."""


class Folder:
    """A folder on the shared file system, reached from the driver for names and small files."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.gateway = spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Make a file appear with all its content, unless one of that name is there."""
        draft = f"draft-{uuid.uuid4().hex}"
        stream = self.fs.create(self._at(draft))
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self.conf)
        kinds = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._at(draft), self._at(name), kinds)
        except Exception as e:
            self.fs.delete(self._at(draft), False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def drop(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class Materialized:
    """One incrementally kept table. ``at`` opens what an earlier session left, or begins it.

    ``watermark``: a column whose largest value each commit notes, so that the next run can
    ask for what is newer without a scan.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 64, watermark: str | None = None
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)
        numbers = self._numbers()
        self.schema, self.key, self.buckets, self.watermark = schema, key, buckets, watermark
        if numbers:
            held = self._commit(numbers[-1])
            self.key, self.buckets, self.watermark = held["key"], held["buckets"], held["watermark"]
            self.schema = T.StructType.fromJson(held["schema"])
            wanted = T.StructType.fromJson(schema.jsonValue())
            if [(f.name, f.dataType) for f in wanted] != [(f.name, f.dataType) for f in self.schema] or key != self.key:
                raise ValueError(f"{path} holds another table: columns or key differ")

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.folder.names("commits") if n.endswith(".json") and n[0].isdigit()]

    def _commit(self, number: int) -> dict:
        return json.loads(self.folder.read(f"commits/{number:020d}.json"))

    def state(self) -> dict:
        """The newest commit: number, folders per bucket, rows written and the high-water mark."""
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "files": {}, "high_water": None}
        return self._commit(numbers[-1])

    def _take(self, before: dict, files: dict[str, list[str]], high_water: str | None) -> None:
        number = before["number"] + 1
        content = {
            "number": number, "key": self.key, "buckets": self.buckets, "watermark": self.watermark,
            "schema": self.schema.jsonValue(), "files": files, "high_water": high_water,
        }
        self.folder.fs.mkdirs(self.folder._at("commits"))
        if not self.folder.put_new(f"commits/{number:020d}.json", json.dumps(content)):
            raise CommitConflict(f"{self.path}: commit {number} was taken by another run")

    def bucket(self, key: str | None = None) -> Column:
        whole = F.coalesce(F.col(key or self.key).cast("string"), F.lit(""))
        return F.pmod(F.xxhash64(whole), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, before: dict) -> tuple[str, list[str], str | None]:
        """A new data folder, the buckets in it, and the high-water mark including it."""
        name = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        seen = Observation()
        marks = []
        if self.watermark:
            earlier = F.lit(before["high_water"]).cast(self.schema[self.watermark].dataType)
            marks = [F.greatest(F.max(self.watermark), earlier).cast("string").alias("mark")]
        out = rows.select(self.schema.names).observe(seen, F.count(F.lit(1)).alias("n"), *marks)
        out.withColumn(BUCKET, self.bucket()).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(
            f"{self.path}/data/{name}"
        )
        found = [n.split("=")[1] for n in self.folder.names(f"data/{name}") if n.startswith(f"{BUCKET}=")]
        mark = seen.get["mark"] if found and self.watermark else before["high_water"]
        return name, found, mark

    def _folders(self, files: dict[str, list[str]], buckets: Sequence[str] | None = None) -> dict[str, list[str]]:
        """Per data folder, in the order of their runs, the buckets of it that count."""
        found: dict[str, list[str]] = {}
        for b in files if buckets is None else [b for b in buckets if b in files]:
            for name in files[b]:
                found.setdefault(name, []).append(b)
        return {name: found[name] for name in sorted(found)}

    def _rows(self, files: dict[str, list[str]], buckets: Sequence[str] | None = None) -> DataFrame:
        """Rows of the buckets with the number of their delta."""
        parts = []
        for i, (name, own) in enumerate(self._folders(files, buckets).items()):
            paths = [f"{self.path}/data/{name}/{BUCKET}={b}" for b in own]
            parts.append(self.spark.read.schema(self.schema).parquet(*paths).withColumn(SEQ, F.lit(i)))
        if not parts:
            return self.spark.createDataFrame([], self.schema).withColumn(SEQ, F.lit(0))
        return reduce(DataFrame.unionByName, parts)

    def _touched(self, batch: DataFrame) -> list[str]:
        """The buckets of a batch: at most ``buckets`` numbers."""
        return [str(r[0]) for r in batch.select(self.bucket().alias("b")).distinct().collect()]

    def read(self) -> DataFrame:
        """The table as the newest commit names it; of a key in several deltas the newest one counts."""
        before = self.state()
        rows = self._rows(before["files"])
        stacked = before.get("files") and any(len(names) > 1 for names in before["files"].values())
        return (latest_per_key(rows, self.key, [SEQ]) if stacked else rows).drop(SEQ)

    def high_water_mark(self) -> str | None:
        return self.state()["high_water"]

    def append_new(self, batch: DataFrame) -> None:
        """First state wins: rows of unknown keys become a delta. A batch holds a key once."""
        before = self.state()
        held = self._rows(before["files"], self._touched(batch)).select(F.col(self.key).alias("_held"))
        fresh = batch.join(held, F.col(self.key).eqNullSafe(F.col("_held")), "left_anti")
        name, found, mark = self._write(fresh, before)
        self._take(before, before["files"] | {b: [*before["files"].get(b, []), name] for b in found}, mark)

    def upsert(self, batch: DataFrame) -> None:
        """Last state wins: the buckets that the batch touches are rewritten. A batch holds a key once."""
        before = self.state()
        held = latest_per_key(self._rows(before["files"], self._touched(batch)), self.key, [SEQ]).drop(SEQ)
        own = batch.select(F.col(self.key).alias("_own"))
        kept = held.join(own, F.col(self.key).eqNullSafe(F.col("_own")), "left_anti")
        name, found, mark = self._write(kept.unionByName(batch.select(self.schema.names)), before)
        self._take(before, before["files"] | {b: [name] for b in found}, mark)

    def stack(self, batch: DataFrame) -> None:
        """Last state wins, settled later: the batch becomes a delta. It holds a key once."""
        before = self.state()
        name, found, mark = self._write(batch, before)
        self._take(before, before["files"] | {b: [*before["files"].get(b, []), name] for b in found}, mark)

    def settle(self, deltas: int = 2) -> None:
        """Fold each bucket of at least ``deltas`` folders into a base; other buckets stay as they are."""
        before = self.state()
        several = [b for b, names in before["files"].items() if len(names) >= deltas]
        if several:
            rows = latest_per_key(self._rows(before["files"], several), self.key, [SEQ]).drop(SEQ)
            name, found, mark = self._write(rows, before)
            self._take(before, before["files"] | {b: [name] for b in found}, mark)

    def expire(self, keep: int = 2, grace_seconds: float = 24 * 3600) -> list[str]:
        """Remove commits but the newest ``keep``, and data that none of those names.

        Data younger than ``grace_seconds`` stays: a run may be about to commit it.
        """
        numbers = self._numbers()
        kept = [self._commit(n) for n in numbers[-keep:]]
        named = {f"{name}/{BUCKET}={b}" for c in kept for b, names in c["files"].items() for name in names}
        folders = {n.split("/")[0] for n in named}
        gone = []
        for n in numbers[:-keep]:
            gone.append(f"commits/{n:020d}.json")
        for name in self.folder.names("data"):
            if time.time_ns() - int(name[1:21]) < grace_seconds * 1e9:
                continue
            if name not in folders:
                gone.append(f"data/{name}")
            else:
                own = [n for n in self.folder.names(f"data/{name}") if n.startswith(f"{BUCKET}=")]
                gone += [f"data/{name}/{n}" for n in own if f"{name}/{n}" not in named]
        for name in gone:
            self.folder.drop(name)
        return gone
