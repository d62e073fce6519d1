"""Overview page: headline figures, monthly trend, top categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.exact import exact_sum, money_sum, sum_of_sums, total
from basketlens.operators.binning import top_k
from basketlens.plans.transactions import category_column, rows_per_row


def keyed(tx: DataFrame, *keys: str) -> DataFrame:
    """Rows whose group keys are all present; groups without a key are not reported."""
    for key in keys:
        tx = tx.filter(F.col(key).isNotNull())
    return tx


def overview_kpis(tx: DataFrame) -> DataFrame:
    """total_revenue, total_orders, total_customers, avg_order_value.

    Items collapse to one row per order and customer, in place after the join on
    order_id. One row per order is marked there, so that counting orders needs no
    shuffle; only the partial rows per customer are moved.
    """
    per = tx.groupBy("order_id", "customer_id").agg(money_sum("order_total", rows_per_row(tx)).alias("t"))
    # An order has one customer as a rule; the window sees the customers of one order.
    place = F.row_number().over(Window.partitionBy("order_id").orderBy("customer_id"))
    counts_once = F.col("order_id").isNotNull() & (place == 1)
    by_customer = (
        per.withColumn("o", counts_once.cast("long"))
        .groupBy("customer_id")
        .agg(F.sum("o").alias("o"), sum_of_sums("t").alias("t"))
    )
    return by_customer.agg(
        F.coalesce(total(sum_of_sums("t")), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.sum("o"), F.lit(0)).alias("total_orders"),
        F.count("customer_id").alias("total_customers"),
    ).withColumn("avg_order_value", F.try_divide("total_revenue", "total_orders"))


def monthly_revenue(tx: DataFrame) -> DataFrame:
    return (
        keyed(tx, "order_year_month")
        .groupBy("order_year_month")
        .agg(exact_sum("order_total", rows_per_row(tx)).alias("revenue"))
        .orderBy("order_year_month")
    )


def monthly_orders(tx: DataFrame) -> DataFrame:
    return (
        keyed(tx, "order_year_month")
        .groupBy("order_year_month")
        .agg(F.countDistinct("order_id").alias("orders"))
        .orderBy("order_year_month")
    )


def top_categories(tx: DataFrame, n: int = 10) -> DataFrame:
    """Categories by revenue; no rows if there is no category column."""
    tx, category = with_category(tx)
    return top_k(
        keyed(tx, category).groupBy(category).agg(exact_sum("order_total", rows_per_row(tx)).alias("revenue")),
        n, "revenue", category,
    )


def with_category(tx: DataFrame) -> tuple[DataFrame, str]:
    """tx with the category in use named `category` (all null if there is none)."""
    source = category_column(tx)
    return tx.withColumn("category", F.col(source) if source else F.lit(None).cast("string")), "category"


def orders_per_customer(tx: DataFrame) -> DataFrame:
    return keyed(tx, "customer_id").groupBy("customer_id").agg(F.countDistinct("order_id").alias("orders"))


def repeat_rate(tx: DataFrame) -> DataFrame:
    """Percentage of customers with more than one order."""
    repeat = F.sum((F.col("orders") > 1).cast("long"))
    return orders_per_customer(tx).agg(
        (F.try_divide(repeat.cast("double"), F.count("*")) * 100).alias("repeat_rate")
    )


def avg_items_per_order(tx: DataFrame) -> DataFrame:
    """Mean number of items with a product per order."""
    items = F.sum("item_products") if rows_per_row(tx) else F.count("product_id")
    return keyed(tx, "order_id").agg(
        F.try_divide(items.cast("double"), F.countDistinct("order_id")).alias("avg_items_per_order")
    )


def avg_review(tx: DataFrame) -> DataFrame:
    """Mean review score over item rows; NULL without reviews."""
    if "review_score" not in tx.columns:
        return tx.agg(F.max(F.lit(None).cast("double")).alias("avg_review"))
    rows = F.col(rows_per_row(tx)) if rows_per_row(tx) else F.lit(1)
    scored = keyed(tx, "review_score")
    return scored.agg(F.try_divide(F.sum(F.col("review_score") * rows), F.sum(rows)).alias("avg_review"))
