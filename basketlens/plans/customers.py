"""Customer-grain aggregates shared by the CLV, RFM, segmentation and churn pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.plans.overview import keyed


def per_customer(tx: DataFrame, *measures: Column) -> DataFrame:
    """One row per customer with the distinct orders as `frequency` and the given aggregates.

    Spark groups by customer and order first (in place after the join on order_id)
    and shuffles only those partial rows, so a customer with a third of all rows is
    spread over the tasks until one row per task is left of them.
    """
    return keyed(tx, "customer_id").groupBy("customer_id").agg(
        F.countDistinct("order_id").alias("frequency"), *measures
    )
