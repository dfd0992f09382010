"""Roles of the analytics played by the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def clicks(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as a click log."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, folder, "events").select(
        "event_id",
        F.col("user_id").alias("ip"),
        (k % 10).alias("app"),
        (F.col("user_id") % 3).alias("device"),
        (F.col("user_id") % 4).alias("os"),
        F.col("event_type").alias("channel"),
        F.col("ts").cast("timestamp").alias("click_time"),
        (F.col("event_type") == "purchase").cast("int").alias("is_attributed"),
    )


def moves(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` as a pointer trace per order."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("session_id"),
        F.col("l_linenumber").cast("long").alias("movement_index"),
        F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_discount", "l_tax").alias("tie"),
        F.col("l_quantity").alias("x_coordinate"),
        (F.col("l_extendedprice") / 1000.0).alias("y_coordinate"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` as a web log: one request per order, one session per customer."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("session_id"),
        F.col("o_orderkey").alias("request_id"),
        F.col("o_orderdate").cast("timestamp").alias("request_time"),
        F.col("o_totalprice").alias("response_size"),
        F.when(F.col("o_orderstatus") == "F", 200).otherwise(404).alias("status_code"),
        F.col("o_orderpriority").alias("category"),
    )
