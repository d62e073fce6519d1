"""Customer lifetime value page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.calendar import elapsed_days
from basketlens.functions.exact import exact_sum
from basketlens.operators.binning import histogram, qcut, top_k
from basketlens.operators.ranking import exact_quantiles
from basketlens.plans.customers import per_customer
from basketlens.plans.transactions import rows_per_row
from basketlens.sources.staging import stage

# Segment names from low to high, days per year.
CLV_SEGMENTS = ["Low", "Medium", "High", "Very High"]
DAYS_PER_YEAR = 365


def clv(tx: DataFrame) -> DataFrame:
    """Per customer: frequency, monetary, first and last purchase, lifespan and yearly value."""
    base = per_customer(
        tx,
        exact_sum("order_total", rows_per_row(tx)).alias("monetary"),
        F.min("order_purchase_timestamp").alias("first_purchase"),
        F.max("order_purchase_timestamp").alias("last_purchase"),
    )
    lifespan = elapsed_days(F.col("first_purchase"), F.col("last_purchase")) + 1
    return (
        base.withColumn("lifespan_days", F.when(lifespan.isNotNull(), F.greatest(lifespan, F.lit(1))))
        .withColumn("avg_order_value", F.try_divide("monetary", "frequency"))
        .withColumn("purchase_frequency", F.try_divide("frequency", "lifespan_days"))
        .withColumn("clv", F.col("avg_order_value") * F.col("purchase_frequency") * DAYS_PER_YEAR)
    )


def clv_summary(customers: DataFrame) -> DataFrame:
    """Mean, median and sum of clv. `customers` is a staged result of clv()."""
    [median] = exact_quantiles(customers, "clv", [0.5])
    return customers.agg(
        F.avg("clv").alias("avg_clv"), F.coalesce(F.sum("clv"), F.lit(0.0)).alias("total_clv")
    ).select("avg_clv", F.lit(median).cast("double").alias("median_clv"), "total_clv")


def clv_segments(customers: DataFrame) -> DataFrame:
    """Customers, mean clv and mean monetary per clv quartile. `customers` is staged."""
    labelled = qcut(customers, "clv", len(CLV_SEGMENTS), "clv_segment", CLV_SEGMENTS)
    found = labelled.filter(F.col("clv_segment").isNotNull()).groupBy("clv_segment").agg(
        F.count("customer_id").alias("customer_count"),
        F.avg("clv").alias("avg_clv"),
        F.avg("monetary").alias("avg_monetary"),
    )
    # All four names are reported, as for any ordered category.
    names = customers.sparkSession.range(1, len(CLV_SEGMENTS) + 1).select(
        F.element_at(F.array(*[F.lit(s) for s in CLV_SEGMENTS]), F.col("id").cast("int")).alias("clv_segment"),
    )
    return names.join(found, "clv_segment", "left").withColumn(
        "customer_count", F.coalesce("customer_count", F.lit(0))
    )


def clv_top(customers: DataFrame, n: int = 20) -> DataFrame:
    columns = ["customer_id", "clv", "frequency", "monetary", "avg_order_value"]
    return top_k(customers.select(columns), n, "clv", "customer_id")


def clv_histogram(customers: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(customers, "clv", bins)


def staged_clv(tx: DataFrame) -> DataFrame:
    """clv(tx), computed once for the reports above."""
    return stage(clv(tx))
