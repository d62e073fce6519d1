"""Sales forecast page: daily series, lag features, boosted trees, 30-day forecast.

The daily table has one row per calendar day, so windows over it and the few
values carried from step to step of the forecast stay small at any data size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.exact import exact_sum
from basketlens.operators.splits import best_splits
from basketlens.plans.overview import keyed
from basketlens.plans.transactions import rows_per_row
from basketlens.sources.staging import stage

# Lags in rows, model inputs.
LAGS = (1, 7, 14)
FEATURES = (
    "day_of_week",
    "day_of_month",
    "month",
    "day_num",
    "revenue_lag_1",
    "revenue_lag_7",
    "revenue_lag_14",
)


def daily_sales(tx: DataFrame) -> DataFrame:
    """Revenue and orders per calendar day with sales."""
    days = keyed(tx, "order_purchase_timestamp").withColumn("date", F.to_date("order_purchase_timestamp"))
    return days.groupBy("date").agg(
        exact_sum("order_total", rows_per_row(tx)).alias("revenue"), F.countDistinct("order_id").alias("orders")
    )


def forecast_features(daily: DataFrame) -> DataFrame:
    """Daily sales plus calendar features and revenue of 1, 7 and 14 rows before; complete rows only."""
    by_date = Window.orderBy("date")
    start = F.min("date").over(Window.partitionBy())
    return (
        daily.withColumns(
            {
                "day_of_week": F.weekday("date"),
                "day_of_month": F.dayofmonth("date"),
                "month": F.month("date"),
                "day_num": F.date_diff(F.col("date"), start),
                **{f"revenue_lag_{k}": F.lag("revenue", k).over(by_date) for k in LAGS},
            }
        )
        .dropna()
    )


def forecast_split(features: DataFrame, train_fraction: float = 0.8) -> DataFrame:
    """Add is_train: the first train_fraction of the days, rounded down."""
    place = F.row_number().over(Window.orderBy("date"))
    n = F.count("*").over(Window.partitionBy())
    return features.withColumn("is_train", place <= F.floor(n * F.lit(train_fraction)))


class SeasonalNaive:
    """The revenue of a week before: what any fitted model has to beat."""

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.col("revenue_lag_7"))

    def predict(self, x: Sequence[float]) -> float:
        return float(x[FEATURES.index("revenue_lag_7")])


@dataclass(frozen=True)
class ForecastStump:
    """One cut: the mean revenue of the training days on either side of the best one."""

    feature: str | None
    threshold: float
    left: float
    right: float

    def transform(self, df: DataFrame) -> DataFrame:
        if self.feature is None:
            return df.withColumn("prediction", F.lit(self.left))
        low = F.col(self.feature).cast("double") <= self.threshold
        return df.withColumn("prediction", F.when(low, self.left).otherwise(self.right))

    def predict(self, x: Sequence[float]) -> float:
        low = self.feature is None or x[FEATURES.index(self.feature)] <= self.threshold
        return self.left if low else self.right


def fit_forecast_stump(train: DataFrame) -> ForecastStump:
    """The cut of the daily features that leaves the smallest squared error, searched exactly."""
    # One row per input.
    cuts = best_splits(train, FEATURES, "revenue").collect()
    if not cuts:
        mean = train.agg(F.avg("revenue")).first()[0]
        return ForecastStump(None, 0.0, mean, mean)
    best = max(cuts, key=lambda r: (r.gain, -FEATURES.index(r.feature)))
    return ForecastStump(best.feature, best.threshold, best.left_mean, best.right_mean)


@dataclass(frozen=True)
class ForecastModel:
    """Fitted trees (or one of the simple models), the staged daily features with their split, and what the recursion starts from.

    Without trees there were too few days to train or to look 14 back.
    """

    trees: GBTRegressionModel | SeasonalNaive | ForecastStump | None
    split: DataFrame
    recent: tuple[float, ...]
    first_day: date | None
    first_feature_day: date | None
    last_day: date | None


def _vectors(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(df)


def fit_forecast(
    tx: DataFrame,
    train_fraction: float = 0.8,
    n_trees: int = 100,
    max_depth: int = 5,
    learning_rate: float = 0.1,
    seed: int = 42,
    seasonal: bool = False,
    stump: bool = False,
) -> ForecastModel:
    """Fit on the older days; with `seasonal` nothing is fitted and last week's revenue is the forecast, with `stump` a single cut is."""
    daily = stage(daily_sales(tx))
    split = stage(forecast_split(forecast_features(daily), train_fraction).coalesce(1))
    days = split.agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.sum(F.col("is_train").cast("int")).alias("n")
    ).first()
    # The longest lag, and no more, is read back to start the recursion.
    recent = [r["revenue"] for r in split.orderBy(F.desc("date")).limit(max(LAGS)).select("revenue").collect()]
    first_day = daily.agg(F.min("date")).first()[0]
    if not days["n"] or len(recent) < max(LAGS):
        return ForecastModel(None, split, tuple(reversed(recent)), first_day, days["first"], days["last"])
    if seasonal:
        recent.reverse()
        return ForecastModel(SeasonalNaive(), split, tuple(recent), first_day, days["first"], days["last"])
    if stump:
        recent.reverse()
        cut = fit_forecast_stump(split.filter("is_train"))
        return ForecastModel(cut, split, tuple(recent), first_day, days["first"], days["last"])
    trees = GBTRegressor(
        featuresCol="__features",
        labelCol="revenue",
        maxIter=n_trees,
        maxDepth=max_depth,
        stepSize=learning_rate,
        seed=seed,
    )
    # One partition: a few thousand rows at most, read once per tree level.
    train = _vectors(split.filter("is_train")).select("revenue", "__features").coalesce(1)
    return ForecastModel(trees.fit(train), split, tuple(reversed(recent)), first_day, days["first"], days["last"])


def forecast_metrics(model: ForecastModel) -> DataFrame:
    """rmse and r2 on the newer days; NULL without a model or without such days."""
    spark, schema = model.split.sparkSession, "rmse double, r2 double"
    if model.trees is None or model.split.filter(~F.col("is_train")).isEmpty():
        return spark.createDataFrame([(None, None)], schema)
    scored = model.trees.transform(_vectors(model.split.filter(~F.col("is_train"))))
    values = [
        float(RegressionEvaluator(labelCol="revenue", metricName=m).evaluate(scored)) for m in ("rmse", "r2")
    ]
    return spark.createDataFrame([tuple(values)], schema)


def lags_at(step: int, recent: Sequence[float], predicted: Sequence[float], compat: bool) -> tuple[float, ...]:
    """Revenue 1, 7 and 14 steps before forecast step `step` (0-based).

    compat reads the week-old value one step late in the second week, a known
    off-by-one kept for comparison with earlier results.
    """
    known = [*recent, *predicted]
    now = len(recent) + step
    values = [known[now - k] for k in LAGS]
    if compat and LAGS[1] <= step < LAGS[2]:
        values[1] = predicted[step - LAGS[1] + 1]
    return tuple(values)


def recursive_forecast(
    predict: Callable[[Sequence[float]], float],
    recent: Sequence[float],
    last_day: date,
    day_zero: date,
    horizon: int,
    compat: bool = False,
) -> list[tuple]:
    """Day by day forecast in which every prediction feeds the lags of later days."""
    predicted: list[float] = []
    rows = []
    for step in range(horizon):
        day = last_day + timedelta(days=step + 1)
        lags = lags_at(step, recent, predicted, compat)
        inputs = (day.weekday(), day.day, day.month, (day - day_zero).days, *lags)
        predicted.append(float(predict(inputs)))
        rows.append((day, *inputs, predicted[-1]))
    return rows


def sales_forecast(model: ForecastModel, horizon: int = 30, compat: bool = False) -> DataFrame:
    """Forecast of the days after the last sale: date, inputs, predicted_revenue; empty without a model.

    compat counts day_num from the first day that has all lags instead of the first sale.
    """
    spark = model.split.sparkSession
    if model.trees is None:
        return spark.createDataFrame([], FORECAST_SCHEMA)
    rows = recursive_forecast(
        lambda x: model.trees.predict(Vectors.dense([float(v) for v in x])),
        model.recent,
        model.last_day,
        model.first_feature_day if compat else model.first_day,
        horizon,
        compat,
    )
    return spark.createDataFrame(rows, FORECAST_SCHEMA)


FORECAST_SCHEMA = (
    "date date, day_of_week int, day_of_month int, month int, day_num int,"
    " revenue_lag_1 double, revenue_lag_7 double, revenue_lag_14 double, predicted_revenue double"
)


def forecast_summary(forecast: DataFrame) -> DataFrame:
    """Total, daily mean and the best day (the first of equals)."""
    return forecast.agg(
        F.sum("predicted_revenue").alias("total_forecast"),
        F.avg("predicted_revenue").alias("avg_daily"),
        F.max_by("date", F.struct("predicted_revenue", -F.unix_date("date"))).alias("peak_day"),
    )
