"""Registry of the queries the driver runs, and their DuckDB counterparts.

``queries()`` maps a name to a function (spark, folder of test tables) -> DataFrame.
``oracle_sql()`` has the same result as SQL where SQL can express it; fitted models
have none.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.plans import (
    basket,
    behavior,
    churn,
    clv,
    forecast,
    overview,
    pages,
    products,
    rfm,
    sales,
    segments,
)
from basketlens.plans.transactions import (
    build_category_rollup,
    build_order_rollup,
    build_transactions,
    sold_orders,
)
from basketlens.session import tune
from basketlens.sources.io import contract_report, load_report, read_result, write_result
from basketlens.sources import staging
from basketlens.sources.staging import stage, stage_by_month
from basketlens.sources.testdata import SCHEMAS, from_testdata, purchase_events
from oracle_queries import ORACLE

try:
    from basketlens.llm.queries import LLM_ORACLE, LLM_QUERIES
except ImportError as missing:  # the subpackage is optional, and so are the libraries that only it needs
    warnings.warn(f"queries of the training-data operators are left out: {missing}", stacklevel=2)
    LLM_QUERIES, LLM_ORACLE = {}, {}

Query = Callable[[SparkSession, str], DataFrame]

# Input tables by application, folder and files in it: what is looked up about a table is looked up once.
_TABLES: dict[tuple, dict[str, DataFrame]] = {}
# Fitted models by the same, staged tables and kind: the reports on one model share one fit.
_FITTED: dict[tuple, object] = {}
_SINGLE = ("customers", "products")


def _tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    key = (spark.sparkContext.applicationId, path, _files(spark, path))
    if key not in _TABLES:
        _TABLES[key] = from_testdata(spark, path, sold_only=True)
    _tuned(spark, path)
    return dict(_TABLES[key])


def _tx(spark: SparkSession, path: str) -> DataFrame:
    return build_transactions(_tables(spark, path), one_row_per_key=_SINGLE)


def _orders(spark: SparkSession, path: str) -> DataFrame:
    return build_order_rollup(_tables(spark, path), one_row_per_key=_SINGLE)


def _categories(spark: SparkSession, path: str) -> DataFrame:
    return build_category_rollup(_tables(spark, path), one_row_per_key=_SINGLE)


def _files(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files below a folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, out = fs.listFiles(folder, True), []
    while found.hasNext():
        status = found.next()
        out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(out))


def _tuned(spark: SparkSession, path: str) -> SparkSession:
    """The session, set up for the tables of a folder by their size."""
    names = tuple(f"{table}.parquet" for table in SCHEMAS)
    return tune(spark, sum(size for file, size, _ in _files(spark, path) if any(f"/{name}" in file for name in names)))


def _fitted(spark: SparkSession, path: str, kind: str, fit: Callable[[], object]) -> object:
    key = (spark.sparkContext.applicationId, path, _files(spark, path), staging.generation, kind)
    if key not in _FITTED:
        _FITTED[key] = fit()
    return _FITTED[key]


def _on_tx(analysis: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, path: analysis(_tx(spark, path))


def _on_orders(analysis: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, path: analysis(_orders(spark, path))


def _on_categories(analysis: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, path: analysis(_categories(spark, path))


def _on_events(analysis: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, path: analysis(purchase_events(_tuned(spark, path), path))


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round results whose last digits depend on the order of floating-point additions."""
    return df.withColumns({c: F.round(c, digits) for c in names})


def _churn(spark: SparkSession, path: str) -> tuple[DataFrame, churn.ChurnModel]:
    def fit() -> tuple[DataFrame, churn.ChurnModel]:
        split = stage(churn.churn_split(stage(churn.churn_features(_tx(spark, path)))))
        return split, churn.fit_churn(split)

    return _fitted(spark, path, "churn", fit)


def _forecast(spark: SparkSession, path: str) -> forecast.ForecastModel:
    return _fitted(spark, path, "forecast", lambda: forecast.fit_forecast(_orders(spark, path)))


def _segments(spark: SparkSession, path: str) -> DataFrame:
    def fit() -> DataFrame:
        return segments.kmeans_segments(segments.segmentation_features(_tx(spark, path)))

    return _fitted(spark, path, "segments", fit)


def _joined(c: str) -> Column:
    return F.array_join(c, ", ").alias(c)


def _itemsets(tx: DataFrame) -> DataFrame:
    return basket.frequent_itemsets(basket.baskets(tx))


def _rules(tx: DataFrame) -> DataFrame:
    return basket.association_rules(_itemsets(tx))


# Analyses of the transactions table by query name.
ANALYSES: dict[str, Callable[[DataFrame], DataFrame]] = {
    # the table itself
    "tx_items_orders": lambda tx: tx.select(
        "order_id", "product_id", "order_item_id", "seller_id", "price", "customer_id", "order_status",
        "order_purchase_timestamp",
    ),
    "tx_base": lambda tx: tx.select(
        "order_id", "product_id", "order_item_id", "price", "freight_value", "customer_id", "customer_city",
        "customer_state", "product_category_name", "product_category_name_english", "order_total",
    ),
    "tx_payments": lambda tx: tx.select("order_id", "product_id", "payment_value", "payment_type", "order_total"),
    "tx_reviews": lambda tx: tx.select("order_id", "product_id", "review_score"),
    "tx_time_features": lambda tx: tx.select(
        "order_id", "order_month", "order_year_month", "purchase_hour", "purchase_day", "purchase_month",
        "purchase_day_of_week", "is_weekend",
    ),
    "tx_shipping_features": lambda tx: tx.select(
        "order_id", "product_id", "freight_value", "has_free_shipping", "freight_ratio"
    ),
    # overview
    "overview_kpis": overview.overview_kpis,
    "monthly_revenue": overview.monthly_revenue,
    "monthly_orders": overview.monthly_orders,
    "top_categories": overview.top_categories,
    "repeat_rate": overview.repeat_rate,
    "avg_items_per_order": overview.avg_items_per_order,
    "avg_review": lambda tx: _rounded(overview.avg_review(tx), 4, "avg_review"),
    # behaviour
    "free_shipping_effect": behavior.free_shipping_effect,
    "social_proof": behavior.social_proof,
    "choice_architecture": behavior.choice_architecture,
    "status_quo_bias": behavior.status_quo_bias,
    # sales
    "payment_mix": sales.payment_mix,
    "state_revenue": sales.state_revenue,
    "category_performance": sales.category_performance,
    # products
    "category_ratings": lambda tx: _rounded(products.category_ratings(tx), 4, "avg_rating"),
    "price_stats": products.price_stats,
    "popular_products": products.popular_products,
    "rating_by_price_bin": lambda tx: _rounded(
        products.rating_by_price_bin(tx), 4, "lower", "upper", "avg_review"
    ),
    "price_review_corr": lambda tx: _rounded(products.price_review_corr(tx), 6, "price_review_corr"),
    "price_histogram": lambda tx: _rounded(products.price_histogram(tx), 4, "lower", "upper"),
    # customer lifetime value
    "clv": clv.clv,
    "clv_summary": lambda tx: _rounded(
        clv.clv_summary(clv.staged_clv(tx)), 2, "avg_clv", "median_clv", "total_clv"
    ),
    "clv_segments": lambda tx: _rounded(clv.clv_segments(clv.staged_clv(tx)), 2, "avg_clv", "avg_monetary"),
    "clv_top20": lambda tx: clv.clv_top(clv.clv(tx)),
    "clv_histogram": lambda tx: _rounded(clv.clv_histogram(clv.staged_clv(tx)), 4, "lower", "upper"),
    # RFM
    "rfm_values": rfm.rfm_values,
    "rfm_scores": rfm.rfm_scores,
    "rfm": rfm.rfm,
    "rfm_segment_counts": lambda tx: rfm.rfm_segment_counts(rfm.rfm(tx)),
    "rfm_segment_profile": lambda tx: rfm.rfm_segment_profile(rfm.rfm(tx)),
    "rfm_histograms": lambda tx: _rounded(rfm.rfm_histograms(rfm.rfm_values(tx)), 4, "lower", "upper"),
    # whole pages
    "overview_page": lambda tx: _rounded(pages.overview_page(tx), 4, "value"),
    "sales_page": lambda tx: _rounded(pages.sales_page(tx), 4, "value"),
    # segmentation
    "segmentation_features": segments.segmentation_features,
    "segmentation_scaled": lambda tx: _rounded(
        segments.segmentation_scaled(segments.segmentation_features(tx)), 6, *segments.SCALED
    ),
    "kmeans_elbow": lambda tx: segments.kmeans_elbow(segments.segmentation_features(tx)),
    # churn
    "churn_features": lambda tx: _rounded(churn.churn_features(tx), 4, "std_order_value"),
    "churn_split": lambda tx: churn.churn_split(stage(churn.churn_features(tx))).select(
        "customer_id", "is_churned", "is_test"
    ),
    "churn_rate": lambda tx: churn.churn_rate(churn.churn_features(tx)),
    # market basket; item lists leave as text
    "baskets": lambda tx: basket.baskets(tx).select("order_id", _joined("items")),
    "frequent_itemsets": lambda tx: _itemsets(tx).select(_joined("items"), "freq", "support"),
    "association_rules": lambda tx: _rounded(
        basket.rules_display(_rules(tx)), 6, "leverage", "conviction", "zhangs_metric"
    ),
    "rules_filtered": lambda tx: basket.rules_display(basket.filtered_rules(_itemsets(tx), min_lift=1.0)).select(
        "antecedents", "consequents", "antecedent_support", "consequent_support", "support", "confidence", "lift"
    ),
    "rules_top": lambda tx: basket.rules_top(basket.filtered_rules(_itemsets(tx), min_lift=1.0)),
    # forecast
    "daily_sales": forecast.daily_sales,
    "forecast_features": lambda tx: forecast.forecast_features(forecast.daily_sales(tx)),
    "forecast_split": lambda tx: forecast.forecast_split(
        forecast.forecast_features(forecast.daily_sales(tx))
    ).select("date", "revenue", "is_train"),
}

# Those that look at orders and customers only: the items of an order may be folded into one row.
BY_ORDER = {
    "overview_kpis", "monthly_revenue", "monthly_orders", "repeat_rate", "avg_items_per_order", "avg_review",
    "status_quo_bias", "payment_mix", "state_revenue", "clv", "clv_summary", "clv_segments", "clv_top20",
    "clv_histogram", "rfm_values", "rfm_scores", "rfm", "rfm_segment_counts", "rfm_segment_profile",
    "rfm_histograms", "daily_sales", "forecast_features", "forecast_split",
}

# Those that look at categories only: the items of an order and category may be folded into one row.
BY_CATEGORY = {
    "top_categories", "choice_architecture", "category_performance", "category_ratings", "baskets", "frequent_itemsets",
    "association_rules", "rules_filtered", "rules_top", "overview_page", "sales_page",
}

# Analyses of the purchase events: hours and weekends, as the orders have no time of day.
EVENT_ANALYSES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "orders_by_hour": behavior.orders_by_hour,
    "peak_hours": behavior.peak_hours,
    "weekend_vs_weekday": lambda tx: _rounded(behavior.weekend_vs_weekday(tx), 4, "avg_order_total", "revenue"),
}

# Reports on the input tables and on fitted models.
OTHER: dict[str, Query] = {
    "load_report": lambda spark, path: load_report(from_testdata(_tuned(spark, path), path)),
    "tx_status_filter": lambda spark, path: sold_orders(from_testdata(_tuned(spark, path), path)["orders"]),
    "kmeans_segments": _segments,
    "kmeans_label_counts": lambda spark, path: segments.kmeans_label_counts(_segments(spark, path)),
    "kmeans_profile": lambda spark, path: segments.kmeans_profile(_segments(spark, path)),
    "churn_scores": lambda spark, path: churn.churn_scores(*_churn(spark, path)),
    "churn_importance": lambda spark, path: churn.churn_importance(*_churn(spark, path)),
    "churn_metrics": lambda spark, path: churn.churn_metrics(*_churn(spark, path)),
    "churn_risk_counts": lambda spark, path: churn.churn_risk_counts(churn.churn_scores(*_churn(spark, path))),
    "churn_top20": lambda spark, path: churn.churn_top(churn.churn_scores(*_churn(spark, path))),
    "forecast_metrics": lambda spark, path: forecast.forecast_metrics(_forecast(spark, path)),
    "sales_forecast": lambda spark, path: forecast.sales_forecast(_forecast(spark, path)),
    "forecast_summary": lambda spark, path: forecast.forecast_summary(
        forecast.sales_forecast(_forecast(spark, path))
    ),
}


def _naive(spark: SparkSession, path: str) -> forecast.ForecastModel:
    return forecast.fit_forecast(_orders(spark, path), seasonal=True)


def _ruled(spark: SparkSession, path: str) -> tuple[DataFrame, churn.RecencyRule]:
    return stage(churn.churn_split(stage(churn.churn_features(_tx(spark, path))))), churn.RecencyRule()


def _stumped(spark: SparkSession, path: str) -> tuple[DataFrame, churn.Stump]:
    def fit() -> tuple[DataFrame, churn.Stump]:
        features = _rounded(stage(churn.churn_features(_tx(spark, path))), 4, "std_order_value")
        split = stage(churn.churn_split(stage(features)))
        return split, churn.fit_stump(split)

    return _fitted(spark, path, "stump", fit)


def _cut_days(spark: SparkSession, path: str) -> forecast.ForecastModel:
    return _fitted(spark, path, "day stump", lambda: forecast.fit_forecast(_orders(spark, path), stump=True))


def _fixed(spark: SparkSession, path: str) -> DataFrame:
    return segments.fixed_segments(segments.segmentation_features(_tx(spark, path)))


def _exported(spark: SparkSession, path: str) -> DataFrame:
    """A report as a CSV file and back."""
    out = f"{staging.scratch_dir(spark)}/export-{uuid.uuid4().hex}"
    write_result(sales.category_performance(_categories(spark, path)), out)
    return read_result(spark, out)


def _text_times(spark: SparkSession, path: str) -> DataFrame:
    """Transactions whose purchase times arrive as text, one form for each order, some no times at all."""
    tables = _tables(spark, path)
    at, form = F.col("order_purchase_timestamp"), F.col("order_id") % 4
    text = (
        F.when(form == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        .when(form == 1, F.date_format(at, "yyyy-MM-dd"))
        .when(form == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm"))
        .otherwise("no time")
    )
    orders = tables["orders"].withColumn("order_purchase_timestamp", text)
    tx = build_transactions(tables | {"orders": orders}, one_row_per_key=_SINGLE)
    return tx.select("order_id", "product_id", "order_purchase_timestamp", "order_year_month")


def _quartiles(spark: SparkSession, path: str) -> DataFrame:
    return segments.spend_quartiles(segments.segmentation_features(_tx(spark, path)))


def _shared(spark: SparkSession, path: str) -> DataFrame:
    return build_transactions(_tables(spark, path), total="item_share", one_row_per_key=_SINGLE)


# The model reports over models that SQL can state, tables staged by month, and revenue by item share.
REFERENCE: dict[str, Query] = {
    "naive_forecast_metrics": lambda spark, path: _rounded(
        _rounded(forecast.forecast_metrics(_naive(spark, path)), 2, "rmse"), 6, "r2"
    ),
    "naive_forecast": lambda spark, path: forecast.sales_forecast(_naive(spark, path)),
    "naive_forecast_summary": lambda spark, path: _rounded(
        forecast.forecast_summary(forecast.sales_forecast(_naive(spark, path))), 2, "total_forecast", "avg_daily"
    ),
    "rule_churn_metrics": lambda spark, path: _rounded(
        churn.churn_metrics(*_ruled(spark, path)), 9, "accuracy", "precision", "recall", "f1"
    ),
    "rule_churn_risk_counts": lambda spark, path: churn.churn_risk_counts(churn.churn_scores(*_ruled(spark, path))),
    "rule_churn_top20": lambda spark, path: churn.churn_top(churn.churn_scores(*_ruled(spark, path))),
    "stump_churn_importance": lambda spark, path: _rounded(churn.churn_importance(*_stumped(spark, path)), 9, "importance"),
    "stump_churn_metrics": lambda spark, path: _rounded(
        churn.churn_metrics(*_stumped(spark, path)), 9, "accuracy", "precision", "recall", "f1"
    ),
    "stump_forecast_metrics": lambda spark, path: _rounded(
        _rounded(forecast.forecast_metrics(_cut_days(spark, path)), 2, "rmse"), 6, "r2"
    ),
    "fixed_kmeans_label_counts": lambda spark, path: segments.kmeans_label_counts(_fixed(spark, path)),
    "fixed_kmeans_profile": lambda spark, path: _rounded(
        _rounded(segments.kmeans_profile(_fixed(spark, path)), 2, "avg_total_spent", "avg_order_value"),
        6, "avg_orders", "avg_recency",
    ),
    "contract_report": lambda spark, path: contract_report(from_testdata(_tuned(spark, path), path)),
    "exported_category_performance": _exported,
    "tx_text_times": _text_times,
    "quartile_label_counts": lambda spark, path: segments.kmeans_label_counts(_quartiles(spark, path)),
    "quartile_profile": lambda spark, path: _rounded(
        _rounded(segments.kmeans_profile(_quartiles(spark, path)), 2, "avg_total_spent", "avg_order_value"),
        6, "avg_orders", "avg_recency",
    ),
    "monthly_revenue_by_month": lambda spark, path: overview.monthly_revenue(stage_by_month(_tx(spark, path))),
    "monthly_orders_by_month": lambda spark, path: overview.monthly_orders(stage_by_month(_tx(spark, path))),
    "overview_kpis_item_share": lambda spark, path: _rounded(
        _rounded(overview.overview_kpis(_shared(spark, path)), 2, "total_revenue"), 4, "avg_order_value"
    ),
    "monthly_revenue_item_share": lambda spark, path: _rounded(
        overview.monthly_revenue(_shared(spark, path)), 2, "revenue"
    ),
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: profile of the RFM segments."""
    return queries()["rfm_segment_profile"](spark, "/root/testdata/sf0.001")


def _grain(name: str) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    return _on_orders if name in BY_ORDER else _on_categories if name in BY_CATEGORY else _on_tx


def queries() -> dict[str, Query]:
    return {
        **{name: _grain(name)(analysis) for name, analysis in ANALYSES.items()},
        **{name: _on_events(analysis) for name, analysis in EVENT_ANALYSES.items()},
        **OTHER,
        **REFERENCE,
        **LLM_QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    return {**ORACLE, **LLM_ORACLE}
