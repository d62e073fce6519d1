"""Churn page: features, split, random forest, scores and quality."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.calendar import elapsed_days
from basketlens.functions.exact import exact_mean, exact_sum
from basketlens.operators.binning import cut_edges, top_k, value_counts
from basketlens.operators.ranking import global_rank
from basketlens.operators.splits import best_splits
from basketlens.plans.customers import per_customer
from basketlens.sources.staging import stage

# Model inputs, risk bands.
FEATURES = (
    "order_count",
    "total_spent",
    "avg_order_value",
    "std_order_value",
    "recency_days",
    "customer_age_days",
    "avg_days_between_orders",
    "avg_shipping",
)
RISK_EDGES = [0.0, 0.3, 0.7, 1.0]
RISK_LABELS = ["Low", "Medium", "High"]


def churn_features(tx: DataFrame, threshold_days: int = 90) -> DataFrame:
    """Per customer: model inputs and is_churned (no purchase in the last threshold_days), staged base."""
    base = stage(
        per_customer(
            tx,
            exact_sum("order_total").alias("total_spent"),
            exact_mean("order_total").alias("avg_order_value"),
            F.coalesce(F.stddev_samp("order_total"), F.lit(0.0)).alias("std_order_value"),
            F.min("order_purchase_timestamp").alias("first_purchase"),
            F.max("order_purchase_timestamp").alias("last_purchase"),
            exact_mean("freight_value").alias("avg_shipping"),
        )
    ).withColumnRenamed("frequency", "order_count")
    last_sale = base.agg(F.max("last_purchase")).scalar()
    age = elapsed_days(F.col("first_purchase"), F.col("last_purchase")) + 1
    return (
        base.withColumn("recency_days", elapsed_days(F.col("last_purchase"), last_sale))
        .withColumn("customer_age_days", age)
        .withColumn("avg_days_between_orders", F.try_divide("customer_age_days", "order_count"))
        .withColumn("is_churned", F.coalesce(F.col("recency_days") > threshold_days, F.lit(False)).cast("int"))
    )


def churn_split(features: DataFrame, test_tenths: int = 3, seed: int = 42) -> DataFrame:
    """Add is_test: test_tenths of the customers, the same share of each class, chosen by a hash.

    Each class gives a fixed number of training rows: its share rounded down, the
    row left over to the class with the larger remainder. Customers are ranked by
    class and hash, so the split depends on ids and seed only, not on partitions.
    """
    counts = features.select(
        F.struct(F.count("*").alias("n"), F.coalesce(F.sum("is_churned"), F.lit(0)).cast("long").alias("n1"))
    ).scalar()
    n, n1 = counts["n"], counts["n1"]

    def div(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    n_train = n - div(n * test_tenths + 9, F.lit(10))
    share0, share1 = div((n - n1) * n_train, n), div(n1 * n_train, n)
    left = n_train - share0 - share1
    rest_larger = (n1 * n_train) % n > ((n - n1) * n_train) % n
    train1 = share1 + F.when(rest_larger, left).otherwise(F.lit(0))
    train0 = n_train - train1

    keyed = features.withColumn("__key", F.md5(F.concat_ws(":", F.col("customer_id").cast("string"), F.lit(str(seed)))))
    ranked = global_rank(keyed, ["is_churned", "__key", "customer_id"], rank="__rank")
    in_train = F.when(F.col("is_churned") == 0, F.col("__rank") <= train0).otherwise(
        F.col("__rank") - (n - n1) <= train1
    )
    return ranked.withColumn("is_test", ~in_train).drop("__key", "__rank")


@dataclass(frozen=True)
class ChurnModel:
    """A fitted forest, or the constant probability if training saw one class only."""

    forest: RandomForestClassificationModel | None
    constant: float
    features: tuple[str, ...]

    @property
    def importance(self) -> list[tuple[str, float]]:
        values = self.forest.featureImportances.toArray() if self.forest else [0.0] * len(self.features)
        return list(zip(self.features, values))

    def predict(self, customers: DataFrame) -> DataFrame:
        """Add churn_probability and predicted (0/1)."""
        if self.forest is None:
            return customers.withColumn("churn_probability", F.lit(self.constant)).withColumn(
                "predicted", F.lit(round(self.constant))
            )
        scored = self.forest.transform(_vectors(customers, self.features))
        return (
            scored.withColumn("churn_probability", vector_to_array("probability")[1])
            .withColumn("predicted", F.col("prediction").cast("int"))
            .select(*customers.columns, "churn_probability", "predicted")
        )


@dataclass(frozen=True)
class RecencyRule:
    """Churn likelier the longer ago the last order: half at `days`, certain at twice that."""

    days: int = 60

    def predict(self, customers: DataFrame) -> DataFrame:
        """Add churn_probability and predicted (0/1)."""
        likely = F.least(F.col("recency_days") / F.lit(2.0 * self.days), F.lit(1.0))
        scored = customers.withColumn("churn_probability", F.coalesce(likely, F.lit(0.0)))
        return scored.withColumn("predicted", (F.col("churn_probability") >= 0.5).cast("int"))


@dataclass(frozen=True)
class Stump:
    """One cut: the churned share of the training rows on either side of the best one, and what the best cut of every input gains."""

    feature: str | None
    threshold: float
    left: float
    right: float
    gains: tuple[tuple[str, float], ...]

    def predict(self, customers: DataFrame) -> DataFrame:
        """Add churn_probability and predicted (0/1)."""
        likely = F.lit(self.left)
        if self.feature is not None:
            value = F.coalesce(F.col(self.feature).cast("double"), F.lit(0.0))
            likely = F.when(value <= self.threshold, self.left).otherwise(self.right)
        scored = customers.withColumn("churn_probability", likely)
        return scored.withColumn("predicted", (F.col("churn_probability") >= 0.5).cast("int"))

    @property
    def importance(self) -> list[tuple[str, float]]:
        """Each input's share of all gains."""
        whole = sum(g for _, g in self.gains)
        return [(name, g / whole if whole else 0.0) for name, g in self.gains]


def fit_stump(split: DataFrame, feature_cols: Sequence[str] = FEATURES) -> Stump:
    """The best single cut of the training rows of a staged churn_split, searched exactly; missing inputs count as 0."""
    train = split.filter(~F.col("is_test"))
    filled = train.select("is_churned", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feature_cols])
    # One row per input.
    cuts = {r.feature: r for r in best_splits(filled, feature_cols, "is_churned").collect()}
    gains = tuple((c, cuts[c].gain if c in cuts else 0.0) for c in feature_cols)
    if not cuts:
        share = train.agg(F.avg("is_churned")).first()[0] or 0.0
        return Stump(None, 0.0, share, share, gains)
    best = max(cuts.values(), key=lambda r: (r.gain, -feature_cols.index(r.feature)))
    return Stump(best.feature, best.threshold, best.left_mean, best.right_mean, gains)


def _vectors(customers: DataFrame, names: Sequence[str]) -> DataFrame:
    filled = customers.withColumns({f"__{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names})
    return VectorAssembler(inputCols=[f"__{c}" for c in names], outputCol="__features").transform(filled)


def fit_churn(
    split: DataFrame,
    feature_cols: Sequence[str] = FEATURES,
    n_trees: int = 100,
    max_depth: int = 10,
    max_bins: int = 32,
    seed: int = 42,
) -> ChurnModel:
    """Fit on the training rows of a staged churn_split."""
    train = split.filter(~F.col("is_test"))
    seen = train.agg(F.count("*").alias("n"), F.sum("is_churned").alias("n1")).first()
    if not seen["n"] or seen["n1"] in (0, seen["n"]):
        return ChurnModel(None, 1.0 if seen["n1"] else 0.0, tuple(feature_cols))
    forest = RandomForestClassifier(
        featuresCol="__features",
        labelCol="is_churned",
        numTrees=n_trees,
        maxDepth=max_depth,
        maxBins=max_bins,
        seed=seed,
        featureSubsetStrategy="sqrt",
    ).fit(_vectors(train, feature_cols).select("is_churned", "__features"))
    return ChurnModel(forest, 0.0, tuple(feature_cols))


def risk_band(probability: Column | str) -> Column:
    """Low, Medium or High; a probability of exactly 0 has no band."""
    return cut_edges(probability, RISK_EDGES, RISK_LABELS)


def churn_scores(split: DataFrame, model: ChurnModel | RecencyRule | Stump) -> DataFrame:
    """All customers with churn_probability and churn_risk."""
    scored = model.predict(split).withColumn("churn_risk", risk_band("churn_probability"))
    return scored.drop("predicted", "is_test")


def churn_importance(split: DataFrame, model: ChurnModel | Stump) -> DataFrame:
    """Importance per model input, largest first."""
    rows = [(name, float(v)) for name, v in model.importance]
    return split.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def classification_metrics(scored: DataFrame, label: str = "is_churned", predicted: str = "predicted") -> DataFrame:
    """accuracy, precision, recall, f1 for class 1; 0 where a ratio has no denominator."""

    def count(actual: int, said: int) -> Column:
        return F.coalesce(F.sum(((F.col(label) == actual) & (F.col(predicted) == said)).cast("long")), F.lit(0))

    cells = scored.agg(
        count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn")
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select(
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def churn_metrics(split: DataFrame, model: ChurnModel | RecencyRule | Stump) -> DataFrame:
    """Quality on the test rows."""
    return classification_metrics(model.predict(split.filter("is_test")))


def churn_rate(features: DataFrame) -> DataFrame:
    """Percentage of churned customers."""
    return features.agg(
        (F.try_divide(F.sum("is_churned").cast("double"), F.count("*")) * 100).alias("churn_rate")
    )


def churn_risk_counts(scores: DataFrame) -> DataFrame:
    return value_counts(scores, "churn_risk", "customers")


def churn_top(scores: DataFrame, n: int = 20) -> DataFrame:
    """The n high-risk customers with the largest probability."""
    columns = ["customer_id", "churn_probability", "recency_days", "order_count", "total_spent"]
    return top_k(scores.filter(F.col("churn_risk") == "High").select(columns), n, "churn_probability", "customer_id")
