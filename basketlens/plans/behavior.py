"""Behavioural insights page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.exact import money_sum, sum_of_sums, total
from basketlens.operators.binning import top_k
from basketlens.plans.overview import keyed, orders_per_customer, with_category


def _by_flag(tx: DataFrame, flag: str) -> DataFrame:
    """Per value of a flag: orders, rows with an amount, and the amount.

    Two levels: per order in place, then over the two flag values.
    """
    per_order = tx.groupBy(flag, "order_id").agg(
        money_sum("order_total").alias("t"), F.count("order_total").alias("n")
    )
    return per_order.groupBy(flag).agg(
        F.count("order_id").alias("orders"), F.sum("n").alias("n"), total(sum_of_sums("t")).alias("t")
    )


def free_shipping_effect(tx: DataFrame) -> DataFrame:
    """Orders and mean order total (over item rows) with and without free shipping; 0 for an absent side."""
    side = F.col("has_free_shipping")

    def mean(where: Column) -> Column:
        amount, rows = F.max(F.when(where, F.col("t"))), F.max(F.when(where, F.col("n")))
        return F.coalesce(F.try_divide(amount, rows), F.lit(0.0))

    def orders(where: Column) -> Column:
        return F.coalesce(F.max(F.when(where, F.col("orders"))), F.lit(0))

    return _by_flag(tx, "has_free_shipping").agg(
        orders(side).alias("free_shipping_orders"),
        orders(~side).alias("paid_shipping_orders"),
        mean(side).alias("avg_order_free"),
        mean(~side).alias("avg_order_paid"),
    )


def social_proof(tx: DataFrame) -> DataFrame:
    """Item rows, orders and mean price for scores of at least 4 and below 3."""
    if "review_score" not in tx.columns:
        tx = tx.withColumn("review_score", F.lit(None).cast("double"))
    # The score limits.
    rated = keyed(tx, "review_score").withColumn(
        "side", F.when(F.col("review_score") >= 4, "high").when(F.col("review_score") < 3, "low")
    )
    per_order = (
        keyed(rated, "side")
        .groupBy("side", "order_id")
        .agg(F.count("*").alias("n"), F.count("price").alias("p"), money_sum("price").alias("t"))
    )
    sides = per_order.groupBy("side").agg(
        F.sum("n").alias("n"), F.count("order_id").alias("orders"), F.sum("p").alias("p"), total(sum_of_sums("t")).alias("t")
    )
    out = []
    for name in ("high", "low"):
        here = F.col("side") == name
        out += [
            F.coalesce(F.max(F.when(here, F.col("n"))), F.lit(0)).alias(f"{name}_rated_rows"),
            F.coalesce(F.max(F.when(here, F.col("orders"))), F.lit(0)).alias(f"{name}_rated_orders"),
            F.coalesce(
                F.try_divide(
                    F.max(F.when(here, F.col("t"))),
                    F.max(F.when(here, F.col("p"))),
                ),
                F.lit(0.0),
            ).alias(f"avg_{name}_rated_price"),
        ]
    return sides.agg(*out)


def choice_architecture(tx: DataFrame) -> DataFrame:
    """Distinct categories per customer: mean and maximum.

    A customer's set of categories is filled before the shuffle, so it is bounded by the catalogue.
    """
    tx, category = with_category(tx)
    bought = F.size(F.collect_set(category)).cast("long")
    per_customer = keyed(tx, "customer_id").groupBy("customer_id").agg(bought.alias("k"))
    return per_customer.agg(
        F.try_divide(F.sum("k").cast("double"), F.count("*")).alias("avg_categories"),
        F.max("k").alias("max_categories"),
    )


def orders_by_hour(tx: DataFrame) -> DataFrame:
    return (
        keyed(tx, "purchase_hour")
        .groupBy("purchase_hour")
        .agg(F.countDistinct("order_id").alias("orders"))
        .orderBy("purchase_hour")
    )


def peak_hours(tx: DataFrame, n: int = 3) -> DataFrame:
    """The n busiest hours as text in that order, and the orders of the busiest."""
    hours = (
        keyed(tx, "purchase_hour").groupBy("purchase_hour").agg(F.countDistinct("order_id").alias("orders"))
    )
    best = top_k(hours, n, "orders", "purchase_hour")
    # At most n rows are left, so the list is bounded.
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("orders")).alias("o"), "purchase_hour")))
    return best.agg(
        F.array_join(F.transform(ranked, lambda x: x["purchase_hour"].cast("string")), ", ").alias("peak_hours"),
        F.max("orders").alias("peak_hour_orders"),
    )


def status_quo_bias(tx: DataFrame) -> DataFrame:
    """Share of customers who came back, with both counts."""
    repeat = F.coalesce(F.sum((F.col("orders") > 1).cast("long")), F.lit(0))
    return orders_per_customer(tx).agg(
        F.coalesce(F.try_divide(repeat.cast("double"), F.count("*")), F.lit(0.0)).alias("status_quo_bias"),
        F.count("*").alias("total_customers"),
        repeat.alias("repeat_customers"),
    )


def weekend_vs_weekday(tx: DataFrame) -> DataFrame:
    """Orders, mean order total and revenue for weekend and weekday purchases."""
    return _by_flag(tx, "is_weekend").select(
        "is_weekend",
        "orders",
        F.try_divide(F.col("t").cast("double"), F.col("n")).alias("avg_order_total"),
        F.coalesce(F.col("t"), F.lit(0)).cast("double").alias("revenue"),
    )
