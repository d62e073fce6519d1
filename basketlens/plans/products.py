"""Products page: ratings, prices, popularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.bins import width_bin, width_edges
from basketlens.functions.exact import exact_mean, exact_sum
from basketlens.operators.binning import bin_frame, histogram, top_k
from basketlens.operators.ranking import exact_quantiles
from basketlens.plans.overview import keyed, with_category
from basketlens.plans.transactions import rows_per_row
from basketlens.sources.staging import stage


def _scored(tx: DataFrame) -> DataFrame:
    if "review_score" in tx.columns:
        return tx
    return tx.withColumn("review_score", F.lit(None).cast("double"))


def category_ratings(tx: DataFrame, n: int = 15, min_reviews: int = 10) -> DataFrame:
    """Mean score, over item rows, of the best-rated categories with enough reviewed ones."""
    tx, category = with_category(_scored(tx))
    rows = F.col(rows_per_row(tx)) if rows_per_row(tx) else F.lit(1)
    reviewed = F.sum(F.when(F.col("review_score").isNotNull(), rows))
    per = (
        keyed(tx, category)
        .groupBy(category)
        .agg((F.sum(F.col("review_score") * rows) / reviewed).alias("avg_rating"), reviewed.alias("review_count"))
        .filter(F.col("review_count") >= min_reviews)
    )
    return top_k(per, n, "avg_rating", category)


def price_profile(tx: DataFrame) -> DataFrame:
    """One row per price with its item rows and review scores, staged.

    The price reports all start here, and take a profile that is made already; the joins
    behind tx then run once, and a price that a third of all rows share is a single row.
    """
    return stage(
        keyed(_scored(tx), "price")
        .groupBy("price")
        .agg(
            F.count("*").alias("rows"),
            F.sum("review_score").alias("score_sum"),
            F.count("review_score").alias("score_rows"),
        )
    )


def price_stats(tx: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Minimum, maximum, mean and median price over item rows."""
    prices = profile or price_profile(tx)
    [median] = exact_quantiles(prices, "price", [0.5], weight="rows")
    return prices.agg(
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.try_divide(exact_sum("price", weight="rows"), F.sum("rows")).alias("avg_price"),
    ).withColumn("median_price", F.lit(median).cast("double"))


def popular_products(tx: DataFrame, n: int = 20) -> DataFrame:
    """Products in the most orders, with their mean price."""
    per = (
        keyed(tx, "product_id")
        .groupBy("product_id")
        .agg(F.countDistinct("order_id").alias("orders"), exact_mean("price").alias("avg_price"))
    )
    return top_k(per, n, "orders", "product_id")


def rating_by_price_bin(tx: DataFrame, bins: int = 10, profile: DataFrame | None = None) -> DataFrame:
    """Mean score per equal-width price band, empty bands kept: bin, lower, upper, label, avg_review.

    The lowest band starts 0.1 % of the range below the minimum.
    """
    prices = profile or price_profile(tx)
    lo, hi = prices.agg(F.min("price"), F.max("price")).first()
    edges = width_edges(lo, hi, bins)
    scored = (
        prices.withColumn("bin", width_bin(F.col("price"), edges))
        .groupBy("bin")
        .agg(F.try_divide(F.sum("score_sum"), F.sum("score_rows")).alias("avg_review"))
    )
    # The lowest edge is shown lowered so that it includes the minimum, unless it was widened before.
    shown = edges if lo == hi else [lo - (hi - lo) * 0.001, *edges[1:]]
    frame = bin_frame(prices, shown)
    label = F.format_string("(%s, %s]", F.round("lower", 3).cast("string"), F.round("upper", 3).cast("string"))
    return frame.join(scored, "bin", "left").select("bin", "lower", "upper", label.alias("label"), "avg_review")


def price_review_corr(tx: DataFrame) -> DataFrame:
    """Pearson correlation of price and score over the rows that have both."""
    both = keyed(_scored(tx), "price", "review_score")
    return both.agg(F.nanvl(F.corr("price", "review_score"), F.lit(None)).alias("price_review_corr"))


def price_histogram(tx: DataFrame, bins: int = 50, profile: DataFrame | None = None) -> DataFrame:
    return histogram(profile or price_profile(tx), "price", bins, weight="rows")
