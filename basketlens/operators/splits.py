"""Best cut of every input of a decision stump, exactly, over data of any size.

Inputs are melted to (feature, value) with the number of rows and the sum of the label; equal values are one row, so a value
that most rows share is no burden. These rows are sorted over range partitions, and running sums over them tell for each
cut between two neighbouring values what lies on either side. The gain of a cut is the drop in the sum of squares around the mean
of its side; for a 0/1 label half of the drop in Gini impurity times the rows, so one search serves both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.exact import money_sum, sum_of_sums, total
from basketlens.operators.ranking import _range_parts


def best_splits(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """feature, threshold, gain, rows, left_rows, left_mean, right_mean: the cut of largest gain of every feature that can be cut.

    Rows with feature <= threshold are left. Thresholds lie midway between neighbouring values; of equal gains the
    smallest counts. Rows without a value of a feature, or without a label, are left out for it.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
    melted = df.filter(F.col(label).isNotNull()).select(F.explode(entries).alias("e"), F.col(label).cast("double").alias("y"))
    counted = (
        melted.select("e.feature", "e.value", "y")
        .filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count("*").alias("n"), money_sum("y").alias("y"))
    )
    parts = _range_parts(counted, ["feature", "value"])
    # One row per feature and range partition: at most shuffle partitions + features.
    of_part = parts.groupBy("feature", "__part").agg(
        F.sum("n").alias("pn"), sum_of_sums("y").alias("py"), F.min("value").alias("least")
    )
    in_order = Window.partitionBy("feature").orderBy("__part")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("feature")
    offsets = of_part.select(
        "feature", "__part",
        F.coalesce(F.sum("pn").over(earlier), F.lit(0)).alias("n0"),
        *[F.coalesce(F.sum(f"py.{f}").over(earlier), F.lit(0)).alias(f"y0_{f}") for f in ("exact", "rest")],
        F.sum("pn").over(whole).alias("rows"),
        *[F.sum(f"py.{f}").over(whole).alias(f"all_{f}") for f in ("exact", "rest")],
        F.lead("least").over(in_order).alias("after"),
    )
    here = Window.partitionBy("__part", "feature").orderBy("value")
    running = here.rowsBetween(Window.unboundedPreceding, 0)
    kind = "decimal(38,15)"

    def left(f: str) -> Column:
        return F.sum(f"y.{f}").over(running) + F.col(f"y0_{f}")

    sides = parts.join(F.broadcast(offsets), ["feature", "__part"]).select(
        "feature", "value", "rows",
        (F.sum("n").over(running) + F.col("n0")).alias("left_rows"),
        total(F.struct(left("exact").cast(kind).alias("exact"), left("rest").alias("rest"))).alias("left_sum"),
        total(F.struct(F.col("all_exact").cast(kind).alias("exact"), F.col("all_rest").alias("rest"))).alias("all_sum"),
        F.coalesce(F.lead("value").over(here), F.col("after")).alias("next"),
    )
    n, y, ny, yy = F.col("left_rows"), F.col("left_sum"), F.col("rows") - F.col("left_rows"), F.col("all_sum") - F.col("left_sum")
    cuts = sides.filter(F.col("next").isNotNull()).select(
        "feature", "value", "rows", "left_rows",
        ((F.col("value") + F.col("next")) / 2).alias("threshold"),
        (y * y / n + yy * yy / ny - F.col("all_sum") * F.col("all_sum") / F.col("rows")).alias("gain"),
        (y / n).alias("left_mean"), (yy / ny).alias("right_mean"),
    )
    fields = ("threshold", "gain", "rows", "left_rows", "left_mean", "right_mean")
    best = F.max_by(F.struct(*fields), F.struct("gain", -F.col("value")))
    return cuts.groupBy("feature").agg(best.alias("b")).select("feature", *[f"b.{f}" for f in fields])
