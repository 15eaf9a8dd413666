"""Read the order tables as an append log of restated service requests.

One line item is one ingestion of its order: the order key is the request, the
line number orders the ingestions, and the fields that vary by line are the
fields that a later ingestion restates. All rows of the tables are used. Some
attribute ranges are mapped to dirty text so that every quality rule has work.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Params
from tidemark.sources.landing import LANDING_COLUMNS

# Parameters of the order tables, whose dates run from 1995-01-01 to 2001-08-01.
ORDER_PARAMS = Params(
    window_start=datetime(1995, 1, 1),
    window_end=datetime(2001, 8, 2),
    build_as_of=datetime(2001, 8, 1),
    vintage_first=date(1995, 1, 31),
    sla_target_days=180,
    maturity_window_days=365,
    sensitivity_windows=(180, 365, 540, 720, 1080),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _stamp(c: Column) -> Column:
    return c.cast("string")


def _milli_degrees(c: Column) -> Column:
    text = c.cast("string")
    return F.concat(F.substring(text, 1, 2), F.lit("."), F.substring(text, 3, 3))


def landing_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log, with the ingestions of a request side by side.

    Parts are joined first and lines dealt by order after that, so all later joins find the
    lines of an order together and leave them so, side by side in the end. What keeps one
    row per request then drops the others before its shuffle. It also spreads a scan of few
    splits over the cores.
    """
    line = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    )
    orders = read(spark, sf_dir, "orders")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    nation = read(spark, sf_dir, "nation")
    region = read(spark, sf_dir, "region")
    # No hints: the planner knows the size of every scan and broadcasts only
    # the sides that fit; skewed order keys are split by the adaptive join.
    rows = (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .repartition("l_orderkey")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )

    c = F.col
    price = c("o_totalprice")
    created, shipped = c("o_orderdate"), c("l_shipdate")
    lost_key = (c("l_discount") == 0.1) & (c("l_tax") == 0.08)
    latitude = _milli_degrees(F.lit(40300) + (c("o_custkey") * 37) % 800)
    longitude = F.concat(F.lit("-"), _milli_degrees(F.lit(73600) + (c("o_custkey") * 53) % 800))

    landing = {
        "unique_key": F.when(lost_key & (c("l_quantity") == 50), F.lit("  "))
        .when(lost_key & (c("l_quantity") == 49), F.lit(None))
        .otherwise(c("l_orderkey").cast("string")),
        "created_date": F.when(price < 2000, F.lit("not recorded"))
        .when(price < 4000, F.year(created).cast("string"))
        .otherwise(_stamp(created)),
        "closed_date": F.when(c("l_linestatus") == "F", _stamp(shipped)),
        "agency": F.when(c("c_acctbal") < -900, F.lit("")).otherwise(F.lower("c_mktsegment")),
        "agency_name": F.when(c("o_orderpriority") == "1-URGENT", F.concat(F.lit("Department of "), c("c_mktsegment")))
        .when(c("o_orderpriority") == "5-LOW", F.lit(None))
        .otherwise(F.concat(c("c_mktsegment"), F.lit(" department"))),
        "complaint_type": F.when(c("p_size") == 50, F.lit("   ")).otherwise(c("p_type")),
        "descriptor": F.when(c("p_size") == 1, F.lit(None)).otherwise(c("p_brand")),
        "location_type": c("l_returnflag"),
        "incident_zip": F.when(c("c_custkey") % 50 == 49, F.lit("")).otherwise((c("c_custkey") % 50).cast("string")),
        "incident_address": c("c_name"),
        "street_name": c("p_name"),
        "address_type": c("l_returnflag"),
        "city": F.concat(F.lit(" "), c("n_name")),
        "status": F.when(price < 8000, F.lit(" "))
        .when(c("o_orderstatus") == "F", F.lit("Closed"))
        .when(c("o_orderstatus") == "O", F.lit("Open"))
        .otherwise(F.lit("In Progress")),
        "due_date": F.when(price > 495000, _stamp(created - F.expr("interval 1 day"))).otherwise(
            _stamp(created + F.expr("interval 30 day"))
        ),
        "resolution_action_updated_date": _stamp(shipped),
        "community_board": c("n_name"),
        "borough": F.when(c("c_nationkey") == 0, F.lit("Unspecified")).otherwise(F.lower("r_name")),
        "open_data_channel_type": c("o_orderpriority"),
        "latitude": F.when(c("c_acctbal") > 9900, F.concat(latitude, F.lit("d"))).otherwise(latitude),
        "longitude": longitude,
        "_ingested_at": _stamp(
            F.lit("2001-08-01 06:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(days=c("l_linenumber"))
        ),
    }
    # Sorted, since a stored table is cut into files that tasks read apart.
    return rows.sortWithinPartitions("l_orderkey").select(*[landing[name].alias(name) for name in LANDING_COLUMNS])
