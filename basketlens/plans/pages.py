"""Whole pages from one scan: every group of a page in one job, in place of a plan for each figure.

The rows of an order lie together after the join on order_id. There each row is marked as the first of its order, and as the
first of its order under each key of the page. Grouping sets over the keys then sum amounts, rows and marks, so that orders
are counted without being told apart again, and the groups are folded into the figures.

A page is a table of (section, key, metric, value); key is null for a page's single figures.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.exact import money_sum, sum_of_sums, total
from basketlens.plans.overview import with_category
from basketlens.plans.transactions import rows_per_row

# What is known of a group.
_SUMS = ("orders", "own_orders", "items", "reviews", "reviewed")


def _with(tx: DataFrame, *names: str) -> DataFrame:
    """tx with the named columns, null where it lacks them."""
    missing = {c: F.lit(None).cast("string") for c in names if c not in tx.columns}
    return tx.withColumns(missing)


def groups(tx: DataFrame, keys: Sequence[str]) -> DataFrame:
    """section (a key's name), key (text) and sums of every value of every key, nulls included.

    revenue; own_orders: orders with that value; orders: orders whose first row has it, so that over all values of a key every
    order counts once; items with a product; reviews: sum of the scores over item rows; reviewed: rows with a score.
    tx may be at the grain of items, of orders, or of orders and categories.
    """
    n = F.col(rows_per_row(tx)) if rows_per_row(tx) else F.lit(1).cast("long")
    items = F.col("item_products") if rows_per_row(tx) else F.col("product_id").isNotNull().cast("long")
    score = F.col("review_score") if "review_score" in tx.columns else F.lit(None).cast("double")
    rows = tx.filter(F.col("order_id").isNotNull()).select(
        "order_id", *keys, "order_total", n.alias("n"), items.alias("items"), (score * n).alias("reviews"),
        F.when(score.isNotNull(), n).alias("reviewed"),
    )

    def first(*by: str) -> Column:
        return (F.row_number().over(Window.partitionBy("order_id", *by).orderBy(*keys)) == 1).cast("int")

    marks = {"__first": first(), **{f"__first_{k}": first(k) for k in keys}}
    by_key = rows.withColumns(marks).groupingSets([[k] for k in keys], *keys)
    sums = by_key.agg(
        F.grouping_id().alias("__set"),
        money_sum("order_total", "n").alias("revenue"),
        F.sum("__first").alias("orders"),
        *[F.sum(f"__first_{k}").alias(f"__orders_{k}") for k in keys],
        *[F.sum(c).alias(c) for c in ("items", "reviews", "reviewed")],
    )
    # In a grouping id the bit of every key that a set leaves out is 1, the first key's bit the highest.
    full = (1 << len(keys)) - 1
    which = {k: F.col("__set") == full - (1 << (len(keys) - 1 - i)) for i, k in enumerate(keys)}

    def of_set(values: dict[str, Column]) -> Column:
        out = None
        for k, here in which.items():
            out = F.when(here, values[k]) if out is None else out.when(here, values[k])
        return out

    return sums.select(
        of_set({k: F.lit(k) for k in keys}).alias("section"),
        of_set({k: F.col(k).cast("string") for k in keys}).alias("key"),
        of_set({k: F.col(f"__orders_{k}") for k in keys}).alias("own_orders"),
        "revenue", "orders", "items", "reviews", "reviewed",
    )


def _metrics(**values: Column) -> Column:
    return F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values.items()])


def _listed(found: DataFrame, names: dict[str, str], metrics: Column) -> DataFrame:
    """Rows (section, key, metric, value) of groups, sections renamed."""
    label = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return (
        found.select(F.element_at(label, F.col("section")).alias("section"), "key", F.explode(metrics).alias("m"))
        .filter(F.col("m.metric").isNotNull())
        .select("section", "key", "m.metric", "m.value")
    )


def _ranked(found: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Only the groups of largest revenue in the sections with a limit; ties go to the smaller key."""
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("amount"), F.asc("key")))
    keep = F.lit(True)
    for section, n in limits.items():
        keep = keep & ((F.col("section") != section) | (F.col("__place") <= n))
    return found.withColumn("__place", place).filter(keep).drop("__place")


def overview_page(tx: DataFrame, n: int = 10) -> DataFrame:
    """Headline figures (section "figures"), every month's revenue and orders ("month"), the top categories ("category").

    What overview_kpis, monthly_revenue, monthly_orders, top_categories, repeat_rate, avg_items_per_order, avg_review and
    status_quo_bias report, from one scan. Takes the table of build_category_rollup, or items.
    """
    tx, category = with_category(_with(tx, "order_year_month"))
    found = groups(tx, ["customer_id", "order_year_month", category])
    # All customers are one group; months and categories stay what they are.
    of_customers = F.col("section") == "customer_id"
    customer = of_customers & F.col("key").isNotNull()
    folded = (
        found.filter(of_customers | F.col("key").isNotNull())
        .withColumns({"key": F.when(~of_customers, F.col("key")), "__named": customer, "__back": customer & (F.col("own_orders") > 1)})
        .groupBy("section", "key")
        .agg(
            F.coalesce(total(sum_of_sums("revenue")), F.lit(0.0)).alias("amount"),
            F.count_if("__named").alias("customers"),
            F.count_if("__back").alias("back"),
            *[F.sum(c).alias(c) for c in _SUMS],
        )
    )
    share = F.try_divide(F.col("back").cast("double"), F.col("customers"))
    figures = _metrics(
        total_revenue=F.col("amount"),
        total_orders=F.col("orders"),
        total_customers=F.col("customers"),
        avg_order_value=F.try_divide("amount", "orders"),
        repeat_rate=share * 100,
        status_quo_bias=share,
        repeat_customers=F.col("back"),
        avg_items_per_order=F.try_divide(F.col("items").cast("double"), F.col("orders")),
        avg_review=F.try_divide("reviews", "reviewed"),
    )
    months = _metrics(revenue=F.col("amount"), orders=F.col("own_orders"))
    categories = _metrics(revenue=F.col("amount"))
    metrics = F.when(F.col("section") == "customer_id", figures).when(F.col("section") == category, categories).otherwise(months)
    names = {"customer_id": "figures", "order_year_month": "month", category: "category"}
    return _listed(_ranked(folded, {category: n}), names, metrics)


def sales_page(tx: DataFrame, n: int = 15) -> DataFrame:
    """Orders by payment type ("payment"), and the top states ("state") and categories ("category").

    What payment_mix, state_revenue and category_performance report, from one scan. Takes the table of
    build_category_rollup, or items.
    """
    tx, category = with_category(_with(tx, "payment_type", "customer_state"))
    found = groups(tx, ["payment_type", "customer_state", category]).filter(F.col("key").isNotNull())
    amount = F.coalesce(total(F.col("revenue")), F.lit(0.0))
    found = _ranked(found.withColumn("amount", amount), {"customer_state": n, category: n})
    orders, revenue = F.col("own_orders"), F.col("amount")
    metrics = (
        F.when(F.col("section") == "payment_type", _metrics(orders=orders))
        .when(F.col("section") == "customer_state", _metrics(revenue=revenue, orders=orders))
        .otherwise(_metrics(revenue=revenue, orders=orders, items_sold=F.col("items")))
    )
    return _listed(found, {"payment_type": "payment", "customer_state": "state", category: "category"}, metrics)
