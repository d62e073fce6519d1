"""A third of all rows under one order, customer, product or under null."""

import pytest
from pyspark.sql import functions as F

from basketlens.operators import skew
from basketlens.operators.keyfilter import key_words, with_partner
from basketlens.plans import basket, clv, overview
from basketlens.plans.transactions import (
    build_category_rollup,
    build_order_rollup,
    build_transactions,
    sold_items,
    sold_orders,
)
from basketlens.sources.staging import stage

N = 6000


@pytest.fixture
def hot_shop(spark, monkeypatch):
    monkeypatch.setattr(skew, "FACTOR", 2)
    i = F.col("id")

    def hot(other):
        return F.when(i % 3 == 0, F.lit(1)).otherwise(other)

    items = spark.range(0, N, 1, 8).select(
        hot(i).alias("order_id"),
        F.when(i % 3 == 1, F.lit(5)).when(i % 3 == 2, F.lit(None)).otherwise(i % 40).alias("product_id"),
        (i % 100 + 1).cast("double").alias("price"),
    )
    orders = spark.range(0, N, 1, 8).select(
        i.alias("order_id"), hot(i % 90).alias("customer_id"), F.lit("shipped").alias("order_status"),
        F.lit("2024-01-01 00:00:00").alias("order_purchase_timestamp"),
    )
    return {
        "customers": stage(spark.range(90).select(i.alias("customer_id"), (i % 7).cast("string").alias("customer_state"))),
        "orders": stage(orders),
        "order_items": stage(items),
        "order_payments": stage(spark.range(N).select(i.alias("order_id"), (i % 9).cast("double").alias("payment_value"))),
        "products": stage(
            spark.range(40).select(i.alias("product_id"), (i % 4).cast("string").alias("product_category_name"))
        ),
    }


def test_heavy_keys_are_found(hot_shop):
    found = skew.heavy_keys(hot_shop["order_items"], ["order_id", "product_id"])
    assert found["order_id"].values == (1,)
    assert set(found["product_id"].values) == {5, None}
    assert all(n >= 2 for _, n in found["order_id"].salts + found["product_id"].salts)


def test_no_key_is_left_unsplit_however_many_are_heavy(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        df = spark.range(0, 40_000, 1, 4).select(
            F.when(F.col("id") % 8 > 0, F.floor(F.col("id") / 8) % 150).otherwise(F.col("id") + 1000).alias("k"), F.col("id").alias("v")
        )
        heavy = skew.heavy_keys(df, ["k"])["k"]
        assert len(heavy.salts) == 150
        right = spark.range(45_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
        plain, split = df.join(right, "k", "left"), skew.salted_join(df, right, "k", "left", heavy)
        assert split.select("k", "v", "w").exceptAll(plain.select("k", "v", "w")).isEmpty() and split.count() == 40_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_salts_follow_the_size_of_each_key(spark):
    df = spark.range(0, 1000, 1, 2).select(F.when(F.col("id") < 800, 1).when(F.col("id") < 960, 2).otherwise(3).alias("k"))
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        assert dict(skew.heavy_keys(df, ["k"])["k"].salts) == {1: 81, 2: 17}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_split_joins_give_the_same_rows(hot_shop):
    plain = build_transactions(hot_shop, split_heavy_keys=False)
    split = build_transactions(hot_shop, split_heavy_keys=True)
    assert split.columns and sorted(split.columns) == sorted(plain.columns)
    split = split.select(*plain.columns)
    assert split.exceptAll(plain).isEmpty() and plain.exceptAll(split).isEmpty()
    assert split.count() == N


def test_analyses_agree_on_hot_keys(hot_shop):
    keys = ("customers", "products")
    plain = build_transactions(hot_shop, one_row_per_key=keys, split_heavy_keys=False)
    split = build_transactions(hot_shop, one_row_per_key=keys, split_heavy_keys=True)
    for analysis in (overview.overview_kpis, overview.top_categories, clv.clv, basket.baskets):
        assert sorted(map(repr, analysis(split).collect())) == sorted(map(repr, analysis(plain).collect()))


def test_the_hot_order_leaves_one_task(spark, hot_shop):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:

        def largest(tx):
            rows = tx.select("order_id", "payment_value").groupBy(F.spark_partition_id().alias("p")).count()
            return rows.agg(F.max("count")).first()[0]

        del hot_shop["products"]  # its join would move the rows on
        plain = build_transactions(hot_shop, split_heavy_keys=False)
        split = build_transactions(hot_shop, split_heavy_keys=True)
        assert largest(plain) >= N // 3
        assert largest(split) < N // 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_heavy_null_keys_keep_their_rows(spark):
    left = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (2, 4)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, w string")
    for values in ((None,), (1,), (1, None), (9,)):
        got = skew.salted_join(left, right, "k", "left", skew.HeavyKeys(tuple((v, 3) for v in values)))
        assert sorted((r.v, r.w) for r in got.collect()) == [(1, None), (2, None), (3, "a"), (4, "b")]


@pytest.fixture
def rare_sales(spark):
    """One order in fifty is sold."""
    n = 4000
    status = "CASE WHEN id % 50 = 0 THEN 'shipped' WHEN id % 51 = 0 THEN NULL ELSE 'canceled' END AS order_status"
    return {
        "customers": stage(spark.range(60).selectExpr("id AS customer_id", "'SP' AS customer_state")),
        "orders": stage(spark.range(n).selectExpr("id AS order_id", "id % 60 AS customer_id", status, "'2024-01-05 00:00:00' AS order_purchase_timestamp")),
        "order_items": stage(spark.range(5 * n).selectExpr("nullif(id % 4500, 77) AS order_id", "id % 9 AS product_id", "1.5D AS price")),
        "order_payments": stage(spark.range(n).selectExpr("id AS order_id", "id * 0.5D AS payment_value")),
        "products": stage(spark.range(9).selectExpr("id AS product_id", "concat('c', id % 4) AS product_category_name")),
    }


@pytest.mark.parametrize("build", [build_transactions, build_order_rollup, build_category_rollup])
def test_items_of_unsold_orders_go_before_they_move(rare_sales, build, monkeypatch):
    from basketlens.plans import transactions

    text = build(rare_sales)._jdf.queryExecution().executedPlan().toString()
    assert "__bits" in text and "BroadcastHashJoin" in text
    got = sorted(map(repr, build(rare_sales).collect()))
    kept = sold_items(rare_sales["order_items"], rare_sales["orders"])
    sold = rare_sales["order_items"].join(sold_orders(rare_sales["orders"]), "order_id").count()
    # Rows that move: those of sold orders, and about one in a hundred of the others.
    assert sold <= kept.count() < sold + 0.05 * rare_sales["order_items"].count()
    monkeypatch.setattr(transactions, "SELECTIVE", 0.0)
    assert "__bits" not in build(rare_sales)._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, build(rare_sales).collect())) == got


def test_no_key_is_lost_by_the_filter(spark):
    keys = spark.range(5000).selectExpr("id * 7 AS k")
    words, count = key_words(keys, "k", 5000)
    assert words.count() <= count == 1251
    assert with_partner(keys, "k", words, count).count() == 5000
    strangers = spark.range(50_000).selectExpr("id * 7 + 1 AS k", "'x' AS `a.b`")
    assert with_partner(strangers.select("k"), "k", words, count).count() < 2000
    assert with_partner(spark.createDataFrame([(None,)], "k long"), "k", words, count).count() == 0


def test_shops_that_sell_most_orders_have_no_filter(shop):
    assert "__bits" not in build_transactions(shop)._jdf.queryExecution().executedPlan().toString()
    assert key_words(shop["orders"].filter("order_id = 'none'"), "order_id", 0)[0].count() == 0
