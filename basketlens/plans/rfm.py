"""RFM page: recency, frequency, monetary scores and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.bins import edge_bin, labelled, rank_bin, width_edges
from basketlens.functions.calendar import elapsed_days
from basketlens.functions.exact import exact_mean, exact_sum
from basketlens.operators.binning import histograms, value_counts
from basketlens.operators.ranking import global_ranks, ranked_quantiles
from basketlens.plans.customers import per_customer
from basketlens.plans.transactions import rows_per_row
from basketlens.sources.staging import stage

# Scores from the lowest to the highest quartile of recency.
RECENCY_SCORES = [4, 3, 2, 1]

# Segment rules in order; least R, F and M score (0 = any).
SEGMENT_RULES = (
    ("Champions", 3, 3, 3),
    ("Loyal Customers", 3, 2, 0),
    ("Potential Loyalists", 3, 0, 0),
    ("At Risk", 0, 3, 3),
)
LOW_RECENCY_SEGMENT = "Hibernating"
OTHER_SEGMENT = "Need Attention"


def rfm_values(tx: DataFrame) -> DataFrame:
    """Per customer: recency (days to the day after the last sale), frequency, monetary.

    The customers are staged: the last sale overall and every score read them again.
    """
    base = stage(
        per_customer(
            tx,
            F.max("order_purchase_timestamp").alias("last_purchase"),
            exact_sum("order_total", rows_per_row(tx)).alias("monetary"),
        )
    )
    today = base.agg(F.max("last_purchase")).scalar() + F.expr("INTERVAL 1 DAY")
    return base.select(
        "customer_id", elapsed_days(F.col("last_purchase"), today).alias("recency"), "frequency", "monetary"
    )


def segment(r: Column, f: Column, m: Column) -> Column:
    """Segment name by score; customers without a score need attention."""
    out = F.when(r.isNull() | f.isNull() | m.isNull(), OTHER_SEGMENT)
    for name, r_min, f_min, m_min in SEGMENT_RULES:
        out = out.when((r >= r_min) & (f >= f_min) & (m >= m_min), name)
    return out.when(r <= 2, LOW_RECENCY_SEGMENT).otherwise(OTHER_SEGMENT)


def rfm_scores(tx: DataFrame) -> DataFrame:
    """rfm_values plus R_score, F_score, M_score (1..4) and their text RFM_score."""
    values = rfm_values(tx)
    measures = ("recency", "frequency", "monetary")
    ranks = global_ranks(values, "customer_id", measures)
    # All three measures are ranked together; the quartiles of recency are among the ranks too.
    found = ranked_quantiles(ranks, {0: [i / 4 for i in range(5)], 1: [0.0], 2: [0.0]})
    edges = found[0]
    if len(set(edges)) <= 4:
        edges = width_edges(edges[0], edges[4], 4)

    def by_rank(measure: int, name: str) -> Column:
        # The rank of a single row has no quartiles; the equal-width bin around its value stands in.
        [v] = found[measure]
        bin_ = F.when(F.col("total") > 1, rank_bin(F.col("rank"), F.col("total"), 4))
        bin_ = F.coalesce(bin_, edge_bin(F.col("value"), width_edges(v, v, 4)))
        return F.max(F.when(F.col("measure") == measure, bin_)).alias(name)

    scores = ranks.groupBy("customer_id").agg(by_rank(1, "F_score"), by_rank(2, "M_score"))
    recent = labelled(edge_bin(F.col("recency").cast("double"), edges), RECENCY_SCORES)
    scored = values.withColumn("R_score", recent).join(scores, "customer_id")
    text = [F.col(c).cast("string") for c in ("R_score", "F_score", "M_score")]
    return scored.withColumn("RFM_score", F.concat(*text))


def rfm(tx: DataFrame) -> DataFrame:
    """rfm_scores plus the segment."""
    return rfm_scores(tx).withColumn("segment", segment(F.col("R_score"), F.col("F_score"), F.col("M_score")))


def rfm_segment_counts(customers: DataFrame) -> DataFrame:
    return value_counts(customers, "segment", "customers")


def rfm_segment_profile(customers: DataFrame) -> DataFrame:
    """Mean recency, frequency and monetary, and customers, per segment."""
    return customers.groupBy("segment").agg(
        F.avg("recency").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"),
        exact_mean("monetary").alias("avg_monetary"),
        F.count("customer_id").alias("customers"),
    )


def rfm_histograms(values: DataFrame, bins: int = 30) -> DataFrame:
    """Histograms of recency, frequency and monetary: measure, bin, lower, upper, count."""
    return histograms(values, ("recency", "frequency", "monetary"), bins)
