"""Dated property-sale tables derived from the star schema.

``sales`` is typed and clean, ``dirty`` is the same as text with duplicates
and bad cells.  Both grow with the tables they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ESTIMATES = ("saleEstimate_lowerPrice", "saleEstimate_currentPrice", "saleEstimate_upperPrice")
# Each estimate is (base + key % 31) percent of the price.
ESTIMATE_BASE = dict(zip(ESTIMATES, (80, 90, 105)))


# Naming the schema saves a footer-reading job per scan.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
              " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
                " l_extendedprice double, l_discount double, l_tax double, l_returnflag string,"
                " l_linestatus string, l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return li.groupBy("l_orderkey").agg(
        F.round(revenue, 4).alias("revenue"),
        F.count("*").alias("n_lines"),
        F.countDistinct("l_suppkey").alias("n_supp"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_ret"),
        F.sum("l_quantity").alias("qty"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, price = F.col("o_orderkey"), F.col("revenue")
    segment = F.substring("c_mktsegment", 1, 2)

    def unless_multiple(n: int, c: Column) -> Column:
        return F.when(key % n != 0, c)

    # Both sides are fact tables that grow together, so neither is ever broadcast;
    # the aggregate already left the lines partitioned by order.
    rows = (
        orders.join(order_lines(spark, sf_dir).hint("merge"), F.col("l_orderkey") == key, "left")
        .join(customers, F.col("o_custkey") == F.col("c_custkey")))
    return rows.select(
        key.alias("row_id"),
        F.col("c_name").alias("fullAddress"),
        F.concat(segment, F.col("c_nationkey")).alias("outcode"),
        F.concat(segment, F.col("c_nationkey"), F.lit(" "), F.col("o_custkey") % 10).alias("postcode"),
        F.round(F.lit(51.5) + F.col("c_acctbal") / F.lit(100000.0), 7).alias("latitude"),
        F.round(F.lit(-0.13) + F.col("c_nationkey") / F.lit(100.0), 2).alias("longitude"),
        F.col("n_lines").cast("double").alias("bedrooms"),
        F.col("n_supp").cast("double").alias("bathrooms"),
        F.col("n_ret").cast("double").alias("livingRooms"),
        unless_multiple(11, F.col("qty")).alias("floorAreaSqM"),
        unless_multiple(17, F.col("o_orderpriority")).alias("propertyType"),
        *[unless_multiple(13, F.round(price * (base + key % 31) / F.lit(100.0), 6)).alias(name)
          for name, base in ESTIMATE_BASE.items()],
        F.col("o_orderdate").alias("history_date"),
        price.alias("history_price"))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("row_id")
    raw = sales(spark, sf_dir).select(
        (2 * key).alias("row_id"), "fullAddress",
        F.when(key % 97 == 0, "not-a-date").otherwise(
            F.col("history_date").cast("date").cast("string")).alias("history_date"),
        F.when(key % 89 == 0, "n/a").otherwise(F.col("history_price").cast("string")).alias("history_price"))
    again = raw.where("(row_id / 2) % 10 = 0").withColumn("row_id", key + 1)
    return raw.unionAll(again)


def hourly_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per event type, one epoch per hour with events, mean value as score."""
    hours = table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("run_id"), F.date_trunc("hour", F.col("ts")).alias("hour")
    ).agg(F.round(F.avg("value"), 6).alias("val_rmse"))
    return hours.selectExpr(
        "run_id", "cast(row_number() OVER (PARTITION BY run_id ORDER BY hour) AS int) AS epoch", "val_rmse")
