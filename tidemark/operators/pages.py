"""Keyset pages over a table that is clustered by its cursor.

The rows are stored in files that each hold one range of (sort, tie), with a small table of
the bounds and sizes of the files. A page opens the files that its rows lie in and no others,
so walking all pages reads a row a bounded number of times however long the table is.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.sampling import keyset_page


class ClusteredPages:
    """Pages of a table that ``cluster`` has written to ``where``."""

    def __init__(self, spark: SparkSession, where: str, schema: T.StructType, sort: str, tie: str):
        self.spark, self.where, self.schema, self.sort, self.tie = spark, where.rstrip("/"), schema, sort, tie
        cursor = T.StructType([T.StructField("s", schema[sort].dataType), T.StructField("t", schema[tie].dataType)])
        self.bounds = spark.read.schema(
            T.StructType(
                [T.StructField("file", T.StringType()), T.StructField("lo", cursor), T.StructField("hi", cursor),
                 T.StructField("rows", T.LongType())]
            )
        ).parquet(f"{self.where}/bounds")

    @classmethod
    def cluster(cls, df: DataFrame, where: str, sort: str, tie: str, files: int | None = None) -> "ClusteredPages":
        """Write ``df`` by ranges of (sort, tie) into about ``files`` files, and their bounds.

        Rows without a sort or tie value are in no page of a walk, so they are refused.
        """
        spark, where = df.sparkSession, where.rstrip("/")
        n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartitionByRange(n, sort, tie).sortWithinPartitions(sort, tie).write.parquet(f"{where}/rows")
        written = spark.read.schema(df.schema).parquet(f"{where}/rows")
        cursor = F.struct(F.col(sort).alias("s"), F.col(tie).alias("t"))
        bounds = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.min(cursor).alias("lo"), F.max(cursor).alias("hi"), F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(sort).isNull() | F.col(tie).isNull()).alias("loose"),
        )
        bounds.coalesce(1).write.parquet(f"{where}/bounds")
        loose = spark.read.parquet(f"{where}/bounds").agg(F.sum("loose")).first()[0]
        if loose:
            raise ValueError(f"{loose} rows have no {sort} or no {tie}: they cannot be paged")
        return cls(spark, where, df.schema, sort, tie)

    def files(self, n: int, after: tuple[Column, Column] | None = None) -> list[str]:
        """The files that the next n rows after a cursor lie in, in order."""
        open_ = self.bounds
        if after is not None:
            open_ = open_.filter(F.col("hi") > F.struct(after[0].alias("s"), after[1].alias("t")))
        ahead = open_.orderBy("lo").select("file", "rows")
        want = 8
        while True:
            found = ahead.limit(want).collect()  # as many as the page needs, not as there are
            # the cursor may stand anywhere in the first file, so only later ones surely count
            have, names = 0, []
            for i, r in enumerate(found):
                names.append(r["file"])
                have += r["rows"] if i or after is None else 0
                if have >= n:
                    return names
            if len(found) < want:
                return names
            want *= 4

    def page(self, n: int, after: tuple[Column, Column] | None = None) -> DataFrame:
        """The next n rows strictly after a cursor, in its order."""
        names = self.files(n, after)
        rows = self.spark.read.schema(self.schema).parquet(*names) if names else self.spark.createDataFrame([], self.schema)
        return keyset_page(rows, self.sort, self.tie, n, after)

    def walk(self, n: int) -> Iterator[DataFrame]:
        """All pages, one after the other."""
        after = None
        while True:
            page = self.page(n, after)
            last = page.agg(F.max(F.struct(F.col(self.sort).alias("s"), F.col(self.tie).alias("t"))).alias("c")).first()["c"]
            if last is None:
                return
            yield page
            kinds = (self.schema[self.sort].dataType, self.schema[self.tie].dataType)
            after = (F.lit(last["s"]).cast(kinds[0]), F.lit(last["t"]).cast(kinds[1]))

    def numbered(self, n: int, name: str = "page") -> DataFrame:
        """All rows with the number, from 1, of the page of a walk by n that returns them.

        A walk takes a job per page, so many pages are better numbered at once: a row's place
        is its place in its file and the rows of the files before it. Cursors are unique, as
        a walk needs them.
        """
        before = Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
        starts = self.bounds.select(F.col("file").alias("_file"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_start"))
        rows = self.spark.read.schema(self.schema).parquet(f"{self.where}/rows").withColumn("_in", F.col("_metadata.file_path"))
        own = F.row_number().over(Window.partitionBy("_in").orderBy(self.sort, self.tie))
        placed = rows.withColumn("_own", own).join(F.broadcast(starts), F.col("_in") == F.col("_file"))
        page = F.floor((F.col("_start") + F.col("_own") - 1) / n).cast("bigint") + 1
        return placed.select(*self.schema.names, page.alias(name))
