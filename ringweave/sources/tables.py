"""The driver tables and the words derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.operators.words import slot_words

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, gates): one gate per line number 1..7, from the least part key."""
    return slot_words(
        table(spark, sf_dir, "lineitem"),
        ["l_orderkey"],
        F.col("l_linenumber"),
        F.col("l_partkey"),
        range(1, 8),
    )


def customer_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, gates): one gate per order priority, from the least order key."""
    return slot_words(
        table(spark, sf_dir, "orders"),
        ["o_custkey"],
        F.col("o_orderpriority"),
        F.col("o_orderkey"),
        PRIORITIES,
    )


def nation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_nationkey, gates): one gate per market segment, from the least customer key."""
    return slot_words(
        table(spark, sf_dir, "customer"),
        ["c_nationkey"],
        F.col("c_mktsegment"),
        F.col("c_custkey"),
        SEGMENTS,
    )


def user_month_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, month, gates): one gate per day of the month, from the least event id."""
    events = table(spark, sf_dir, "events").select(
        "user_id", F.date_format("ts", "yyyy-MM").alias("month"), F.dayofmonth("ts").alias("day"), "event_id"
    )
    return slot_words(events, ["user_id", "month"], F.col("day"), F.col("event_id"), range(1, 32))
