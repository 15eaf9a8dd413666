"""Export of the wide mart, repeatable byte for byte."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.marts import in_grain_order

EXPORT_DECIMALS = 6


def round_floats(df: DataFrame, places: int = EXPORT_DECIMALS) -> DataFrame:
    """Round the floating columns, found in the schema; whole numbers stay."""
    return df.select(
        *[
            F.round(f.name, places).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def export_wide(wide: DataFrame, where: str) -> None:
    """CSV with header and Parquet, in grain order.

    The sort is by range, so the part files follow each other in order and are
    written by many tasks; nothing passes through a single one. Both files come
    from one sort. Hand in a stored table: it is what a lost task is redone from.
    """
    ordered = in_grain_order(round_floats(wide)).persist()
    try:
        ordered.write.mode("overwrite").option("header", "true").csv(f"{where}/csv")
        ordered.write.mode("overwrite").parquet(f"{where}/parquet")
    finally:
        ordered.unpersist()


def read_export(spark: SparkSession, where: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The CSV and the Parquet of an export, under the schema of what was exported."""
    csv = spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").csv(f"{where}/csv")
    return csv, spark.read.schema(schema).parquet(f"{where}/parquet")
