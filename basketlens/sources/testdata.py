"""Adapter from the star-schema test tables to the seven input tables.

The test tables have no payment type, freight or review score. Order priority, a
share of the price, and a score by return flag stand in for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Stated so that opening a table reads no file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}.parquet")


def from_testdata(spark: SparkSession, path: str, sold_only: bool = False) -> dict[str, DataFrame]:
    """The seven input tables over one scale-factor folder.

    With `sold_only` the orders are those delivered or shipped, filtered by the stored
    letter, so that the scan can skip the others.
    """
    customer, nation, region = (_read(spark, path, t) for t in ("customer", "nation", "region"))
    orders, lineitem, part = (_read(spark, path, t) for t in ("orders", "lineitem", "part"))

    customers = (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
        .join(region, nation.n_regionkey == region.r_regionkey, "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("r_name").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )
    )
    # Order status, review score.
    status = (
        F.when(F.col("o_orderstatus") == "F", "delivered")
        .when(F.col("o_orderstatus") == "O", "shipped")
        .when(F.col("o_orderstatus") == "P", "processing")
    )
    score = (
        F.when(F.col("l_returnflag") == "R", 1.0)
        .when(F.col("l_returnflag") == "A", 3.0)
        .when(F.col("l_returnflag") == "N", 5.0)
    )
    # price * tax in whole cents, halves rounded up
    cents, percent = (F.rint(F.col(c) * 100).cast("long") for c in ("l_extendedprice", "l_tax"))
    freight = F.call_function("div", cents * percent + 50, F.lit(100).cast("long")) / F.lit(100.0)
    return {
        "customers": customers,
        "orders": (orders.filter(F.col("o_orderstatus").isin("F", "O")) if sold_only else orders).select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            status.alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
        ),
        "order_items": lineitem.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_extendedprice").alias("price"),
            freight.alias("freight_value"),
        ),
        "order_payments": orders.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_totalprice").alias("payment_value"),
            F.col("o_orderpriority").alias("payment_type"),
            F.lit(1).alias("payment_sequential"),
        ),
        "products": part.select(
            F.col("p_partkey").alias("product_id"), F.col("p_type").alias("product_category_name")
        ),
        "product_translation": part.select(F.col("p_type").alias("product_category_name"))
        .distinct()
        .withColumn("product_category_name_english", F.concat(F.lit("cat_"), F.lower("product_category_name"))),
        "reviews": lineitem.select(F.col("l_orderkey").alias("order_id"), score.alias("review_score")),
    }


def purchase_events(spark: SparkSession, path: str) -> DataFrame:
    """Purchases of the event stream as transactions; unlike the orders they have a time of day."""
    from basketlens.functions.calendar import time_features

    bought = (
        _read(spark, path, "events")
        .filter(F.col("event_type") == "purchase")
        .select(
            F.col("event_id").alias("order_id"),
            F.col("user_id").alias("customer_id"),
            F.col("ts").alias("order_purchase_timestamp"),
            F.col("value").alias("order_total"),
        )
    )
    return bought.withColumns(time_features("order_purchase_timestamp"))
