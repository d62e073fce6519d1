"""Sales page: payments, states, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.exact import exact_sum, money_sum, sum_of_sums, total
from basketlens.operators.binning import top_k
from basketlens.plans.overview import keyed, with_category
from basketlens.plans.transactions import rows_per_row


def payment_mix(tx: DataFrame) -> DataFrame:
    """Orders per payment type; no rows without one."""
    if "payment_type" not in tx.columns:
        tx = tx.withColumn("payment_type", F.lit(None).cast("string"))
    return keyed(tx, "payment_type").groupBy("payment_type").agg(F.countDistinct("order_id").alias("orders"))


def state_revenue(tx: DataFrame, n: int = 15) -> DataFrame:
    """Revenue and orders of the top states; no rows without states."""
    if "customer_state" not in tx.columns:
        tx = tx.withColumn("customer_state", F.lit(None).cast("string"))
    per = (
        keyed(tx, "customer_state")
        .groupBy("customer_state")
        .agg(exact_sum("order_total", rows_per_row(tx)).alias("revenue"), F.countDistinct("order_id").alias("orders"))
    )
    return top_k(per, n, "revenue", "customer_state")


def category_performance(tx: DataFrame, n: int = 15) -> DataFrame:
    """Revenue, orders and items of the top categories.

    Two levels: per order in place, then over the categories.
    """
    tx, category = with_category(tx)
    items = F.sum("item_products") if rows_per_row(tx) else F.count("product_id")
    per_order = (
        keyed(tx, category)
        .groupBy("order_id", category)
        .agg(money_sum("order_total", rows_per_row(tx)).alias("t"), items.alias("items"))
    )
    per = per_order.groupBy(category).agg(
        F.coalesce(total(sum_of_sums("t")), F.lit(0.0)).alias("revenue"),
        F.count("order_id").alias("orders"),
        F.sum("items").alias("items_sold"),
    )
    return top_k(per, n, "revenue", category)
