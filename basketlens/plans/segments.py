"""Customer segmentation page: scaled features, k-means, cluster labels."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.calendar import elapsed_days
from basketlens.functions.exact import exact_mean, exact_sum
from basketlens.operators.binning import rank_qcut, value_counts
from basketlens.operators.kmeans import lloyd, nearest, seeded
from basketlens.plans.customers import per_customer
from basketlens.sources.staging import stage

# The clustered measures, the squared moves of all centres below which k-means has settled, the label texts.
SCALED = ("order_count", "total_spent", "avg_order_value", "recency_days")
SHIFT = 1e-4
# Customers that starting centres are drawn from.
SEEDS = 20_000
# The scaled measures as columns, and centres to start from where a fit must be repeatable elsewhere: orders, spend, order value, recency.
POINT = tuple(f"__{c}" for c in SCALED)
FIXED_CENTRES = ((1.0, 1.0, 0.0, -0.5), (-0.5, -0.5, -0.5, -0.5), (-0.5, -0.5, 1.0, 0.0), (-1.0, -1.0, 0.0, 2.0))
HIGH_VALUE, INACTIVE, NEW, MEDIUM = "High Value", "Inactive", "New/Low Frequency", "Medium Value"


def segmentation_features(tx: DataFrame) -> DataFrame:
    """Per customer: orders, spend, mean item-row values and days since the last purchase, staged."""
    base = stage(
        per_customer(
            tx,
            exact_sum("order_total").alias("total_spent"),
            exact_mean("order_total").alias("avg_order_value"),
            exact_mean("price").alias("avg_price"),
            exact_mean("freight_value").alias("avg_shipping"),
            F.max("order_purchase_timestamp").alias("last_purchase"),
        )
    )
    last_sale = base.agg(F.max("last_purchase")).scalar()
    return base.withColumnRenamed("frequency", "order_count").withColumn(
        "recency_days", elapsed_days(F.col("last_purchase"), last_sale)
    ).drop("last_purchase")


def _scaled(features: DataFrame) -> dict[str, Column]:
    """Scaled measures by name; mean and deviation come from one scalar subquery."""
    stats = features.select(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in SCALED], *[F.stddev_pop(c).alias(f"{c}_std") for c in SCALED]
        )
    ).scalar()

    def scaled(c: str) -> Column:
        std = stats[f"{c}_std"]
        return (F.col(c) - stats[f"{c}_mean"]) / F.when(std == 0, F.lit(1.0)).otherwise(std)

    return {c: scaled(c) for c in SCALED}


def segmentation_scaled(features: DataFrame) -> DataFrame:
    """Features with the clustered measures at mean 0 and population deviation 1 (0 deviation: 1)."""
    return features.withColumns(_scaled(features))


def _points_of(features: DataFrame) -> DataFrame:
    """Features plus the scaled measures as points; a missing measure counts as the mean."""
    return features.withColumns({f"__{c}": F.coalesce(x, F.lit(0.0)) for c, x in _scaled(features).items()})


@contextmanager
def _points(features: DataFrame):
    """The points, kept for the many passes of k-means."""
    points = _points_of(features).select("customer_id", *POINT).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield points
    finally:
        points.unpersist()


def _starts(points: DataFrame, ks: Sequence[int], n_init: int, seed: int) -> list[np.ndarray]:
    """For each k, n_init sets of starting centres, drawn from SEEDS points with the smallest hashes. Fits see all points."""
    order = F.xxhash64("customer_id", F.lit(seed))
    rows = points.orderBy(order, "customer_id").limit(SEEDS).select(*POINT).collect()
    sample = np.array([tuple(r) for r in rows], float).reshape(-1, len(POINT))
    drawn = [seeded(sample, max(ks), seed + i) for i in range(n_init)] if len(sample) and len(ks) else []
    return [d[:k] for k in ks for d in drawn]


def _best_fits(
    points: DataFrame, ks: Sequence[int], n_init: int, seed: int, max_iter: int
) -> dict[int, tuple[np.ndarray, float]]:
    """Per k the centres of least cost over n_init starts, and that cost; all fits share their passes over the points."""
    fits, costs = lloyd(points, POINT, _starts(points, ks, n_init, seed), max_iter, SHIFT)
    best: dict[int, tuple[np.ndarray, float]] = {}
    for centres, cost in zip(fits, costs):
        if len(centres) not in best or cost < best[len(centres)][1]:
            best[len(centres)] = centres, float(cost)
    return best


def kmeans_elbow(features: DataFrame, max_k: int = 10, n_init: int = 10, seed: int = 42, max_iter: int = 300) -> DataFrame:
    """Least within-cluster cost per number of clusters: k, inertia. One row per k."""
    with _points(features) as points:
        n = points.count()
        ks = range(2, min(max_k + 1, n // 10 + 2))
        best = _best_fits(points, ks, n_init, seed, max_iter)
        rows = [(k, best[k][1]) for k in ks if k in best]
    return features.sparkSession.createDataFrame(rows, "k int, inertia double")


def kmeans_segments(features: DataFrame, k: int = 4, n_init: int = 10, seed: int = 42, max_iter: int = 300) -> DataFrame:
    """Features plus cluster and cluster_label."""
    with _points(features) as points:
        best = _best_fits(points, [k], n_init, seed, max_iter)
    # Without customers there is no centre, and no row to assign.
    return assigned(features, best[k][0] if best else np.zeros((1, len(POINT))))


def assigned(features: DataFrame, centres: np.ndarray) -> DataFrame:
    """Features plus the cluster of the nearest centre, and cluster_label."""
    clustered = _points_of(features).withColumn("cluster", nearest(POINT, centres)).drop(*POINT)
    return label_clusters(stage(clustered))


def fixed_segments(features: DataFrame, centres: Sequence[Sequence[float]] = FIXED_CENTRES, rounds: int = 5) -> DataFrame:
    """Features plus cluster and cluster_label, after `rounds` rounds from stated centres (of the scaled measures)."""
    with _points(features) as points:
        [found], _ = lloyd(points, POINT, [np.array(centres, float)], rounds)
    return assigned(features, found)


def spend_quartiles(features: DataFrame) -> DataFrame:
    """Features plus cluster and cluster_label, the clusters being quartiles of the amount spent (0 to 3).

    features is read several times: pass a staged table.
    """
    ranked = rank_qcut(features.withColumn("__spent", F.coalesce("total_spent", F.lit(0.0))), "__spent", "customer_id", 4, "q")
    return label_clusters(stage(ranked.withColumn("cluster", (F.col("q") - 1).cast("int")).drop("q", "__spent")))


def label_clusters(clustered: DataFrame) -> DataFrame:
    """Add cluster_label by comparing each cluster's means with the median of those means."""
    means = clustered.groupBy("cluster").agg(
        F.avg("total_spent").alias("spent"),
        F.avg("order_count").alias("orders"),
        F.avg("recency_days").alias("recency"),
    )
    # One row per cluster, so the medians see k rows.
    mid = means.select(
        F.struct(*[F.median(c).alias(c) for c in ("spent", "orders", "recency")])
    ).scalar()
    label = (
        F.when((F.col("spent") > mid["spent"]) & (F.col("orders") > mid["orders"]), HIGH_VALUE)
        .when(F.col("recency") > mid["recency"], INACTIVE)
        .when(F.col("orders") <= mid["orders"], NEW)
        .otherwise(MEDIUM)
    )
    labels = means.select("cluster", label.alias("cluster_label"))
    return clustered.join(F.broadcast(labels), "cluster").select(*clustered.columns, "cluster_label")


def kmeans_label_counts(segments: DataFrame) -> DataFrame:
    return value_counts(segments, "cluster_label", "customers")


def kmeans_profile(segments: DataFrame) -> DataFrame:
    """Customers and mean spend, orders, order value and recency per label."""
    return segments.groupBy("cluster_label").agg(
        F.count("customer_id").alias("customers"),
        F.avg("total_spent").alias("avg_total_spent"),
        F.avg("order_count").alias("avg_orders"),
        F.avg("avg_order_value").alias("avg_order_value"),
        F.avg("recency_days").alias("avg_recency"),
    )
