"""Incident tables derived from the generic test tables.

The feeds this library works on are not public, so the checks and benchmarks
derive tables of the same shape from order lines (unit responses), orders
(incidents), customers (addresses) and vectors (coordinates, drive times).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firstdue.operators.drive_times import attach_drive_times
from firstdue.operators.responses import build_responses

# What stands in for the fixed values on these tables.
NATURES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
TRAINING = "5-LOW"
ENGINES = ["U1", "U2", "U3", "U6", "U7"]
YEARS = ["1995", "1996", "1997", "1998", "1999", "2000", "2001"]
BEFORE, AFTER = "1995", "2000"
TOWN = ", Springfield"
STATIONS = ["HQ", "Lowell", "FiveFifteen", "Highland", "Teele", "JoyWashington", "Union"]
TIE_BREAK = ["line", "part", "supp"]
RESPONSE_KEY = ["incident_id", "line", "part", "supp", "cents"]


# Declared, so that opening a table starts no job that looks into its files.
RAW_TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read.schema(RAW_TABLES[name]) if name in RAW_TABLES else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def _unit() -> Column:
    return F.concat(F.lit("U"), (F.col("l_suppkey") % 8).cast("string"))


def _arrival_columns() -> list[Column]:
    return [
        F.col("l_orderkey").alias("incident_id"),
        _unit().alias("unit"),
        (F.col("l_extendedprice") / 10000).alias("resp_time"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
    ]


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """One row per unit response."""
    lines, orders = raw(spark, folder, "lineitem"), raw(spark, folder, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        *_arrival_columns(),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.col("o_orderpriority").alias("nature"),
        F.year("o_orderdate").cast("string").alias("year"),
        F.to_date("o_orderdate").alias("date_short"),
        F.col("o_custkey").alias("addr_id"),
    )


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    return raw(spark, folder, "lineitem").select(*_arrival_columns())


def received(spark: SparkSession, folder: str) -> DataFrame:
    """Incidents with the time they came in, as text."""
    return raw(spark, folder, "orders").select(
        F.col("o_orderkey").alias("incident_id"),
        F.date_format("o_orderdate", "M/d/yyyy H:mm").alias("received_text"),
    )


def _element(i: int) -> Column:
    return F.element_at("embedding", i).cast("double")


def locations(spark: SparkSession, folder: str) -> DataFrame:
    address = F.concat(F.col("vec_id").cast("string"), F.lit(f" MAIN ST{TOWN}"))
    return raw(spark, folder, "embeddings").select(
        F.col("vec_id").alias("addr_id"),
        address.alias("full_address"),
        (F.lit(-71.10) + F.lit(0.1) * _element(1)).alias("lon"),
        (F.lit(42.3875) + F.lit(0.1) * _element(2)).alias("lat"),
    )


def drive_times(spark: SparkSession, folder: str) -> DataFrame:
    """Long table of minutes per address and station."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(station).alias("station"),
                (F.lit(2) + F.lit(10) * F.abs(_element(k))).alias("minutes"),
            )
            for k, station in enumerate(STATIONS, start=3)
        ]
    )
    return (
        raw(spark, folder, "embeddings")
        .select(F.col("vec_id").alias("addr_id"), F.inline(pairs))
        .withColumn("minutes_in_traffic", F.col("minutes") * 1.25)
    )


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Distance-service answers as landed text."""
    seconds = F.floor(F.col("minutes") * 60).cast("string")
    in_traffic = F.floor(F.col("minutes") * 75).cast("string")
    body = F.concat(
        F.lit('{"rows":[{"elements":[{"duration":{"value":'), seconds,
        F.lit('},"duration_in_traffic":{"value":'), in_traffic, F.lit("}}]}]}"),
    )
    return drive_times(spark, folder).select("addr_id", "station", body.alias("body"))


def dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """Dispatch records with untidy address parts."""
    orders, customers = raw(spark, folder, "orders"), raw(spark, folder, "customer")
    nations = raw(spark, folder, "nation")
    o = F.col("o_orderkey")
    number = (
        F.when(o % 10 == 0, "").when(o % 10 == 1, "0")
        .otherwise((F.col("o_custkey") % 300).cast("string"))
    )
    name1 = (
        F.when((o % 50 == 0) | (o % 100 == 20), "")
        .when(F.col("c_custkey") % 2 == 0, F.concat("n_name", F.lit(" AV")))
        .otherwise(F.concat("n_name", F.lit(" A ST")))
    )
    name2 = F.when((o % 100 == 0) | (o % 20 == 10), "").otherwise(
        F.concat("c_mktsegment", F.lit(" AV"))
    )
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            o.alias("incident_id"), number.alias("st_num"),
            name1.alias("st_name1"), name2.alias("st_name2"),
        )
    )


def main_street(spark: SparkSession, folder: str) -> DataFrame:
    """Dispatch records whose addresses the gazetteer knows in part."""
    return raw(spark, folder, "orders").select(
        F.col("o_orderkey").alias("incident_id"),
        F.col("o_custkey").cast("string").alias("st_num"),
        F.lit("MAIN ST").alias("st_name1"),
        F.lit("").alias("st_name2"),
    )


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """The fact table."""
    return build_responses(
        activity(spark, folder),
        arrivals(spark, folder),
        locations(spark, folder),
        location_key="addr_id",
        tie_break=TIE_BREAK,
    )


def first_responses(spark: SparkSession, folder: str) -> DataFrame:
    return responses(spark, folder).filter(F.col("is_first") == 1)


def timed_responses(spark: SparkSession, folder: str, traffic: bool = False) -> DataFrame:
    """First responses with the drive times of every station."""
    times = drive_times(spark, folder)
    return attach_drive_times(
        first_responses(spark, folder), times, "addr_id", STATIONS, traffic
    )
