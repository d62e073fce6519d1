"""Order-level analyses give the same on items and on items folded into orders."""

import pytest

import __spark_entry__ as registry
from pyspark.sql import functions as F

from basketlens.plans import basket, behavior, overview, products, sales
from basketlens.plans.transactions import ROWS, build_category_rollup, build_order_rollup, build_transactions
from basketlens.sources.staging import stage

PATH = "/root/testdata/sf0.001"


def rows(df):
    return sorted((repr(sorted(r.asDict().items())) for r in df.collect()))


@pytest.mark.parametrize("name", sorted(registry.BY_ORDER - {"rfm", "rfm_scores", "rfm_segment_counts"}))
def test_rollup_equals_items(spark, name):
    analysis = registry.ANALYSES[name]
    assert rows(analysis(registry._orders(spark, PATH))) == rows(analysis(registry._tx(spark, PATH)))


@pytest.mark.parametrize("name", ["overview_kpis", "avg_items_per_order", "avg_review", "clv", "state_revenue"])
def test_rollup_of_gaps_equals_items(shop, name):
    analysis = registry.ANALYSES[name]
    assert rows(analysis(build_order_rollup(shop))) == rows(analysis(build_transactions(shop)))


def test_without_payments_items_stay(shop):
    del shop["order_payments"]
    assert ROWS not in build_order_rollup(shop).columns


def test_items_are_counted_before_their_shuffle(spark):
    text = registry._orders(spark, PATH)._jdf.queryExecution().executedPlan().toString()
    counting = text[text.index("partial_count") :]
    assert "l_orderkey" in counting.split("FileScan")[1]


@pytest.mark.parametrize("name", ["top_categories", "choice_architecture", "category_performance", "category_ratings", "baskets"])
def test_category_rollup_equals_items(spark, name):
    analysis = registry.ANALYSES[name]
    assert rows(analysis(registry._categories(spark, PATH))) == rows(analysis(registry._tx(spark, PATH)))


CATEGORY = {
    "top_categories": overview.top_categories,
    "choice_architecture": behavior.choice_architecture,
    "category_performance": sales.category_performance,
    "category_ratings": lambda tx: products.category_ratings(tx, min_reviews=1),
    "baskets": basket.baskets,
}


@pytest.mark.parametrize("name", sorted(CATEGORY))
@pytest.mark.parametrize("case", ["plain", "null translation", "repeated product", "raw", "no payments", "item categories"])
def test_category_rollup_of_gaps_equals_items(shop, frame, name, case):
    translation = "product_category_name string, product_category_name_english string"
    if case == "null translation":
        shop["product_translation"] = frame(translation, ("livros", "books"), (None, "unknown"))
        shop["products"] = frame("product_id string, product_category_name string", ("p1", "livros"), ("p2", None))
    elif case == "repeated product":
        shop["products"] = shop["products"].union(shop["products"].filter("product_id = 'p1'"))
    elif case == "raw":
        del shop["product_translation"]
    elif case == "no payments":
        del shop["order_payments"]
    elif case == "item categories":
        del shop["products"]
        shop["order_items"] = shop["order_items"].withColumn("product_category_name", F.col("product_id"))
    analysis = CATEGORY[name]
    assert rows(analysis(build_category_rollup(shop))) == rows(analysis(build_transactions(shop)))


def item_exchanges(df):
    """First keys of the exchanges above the scan of the items, from the scan up."""
    text = df._jdf.queryExecution().executedPlan().toString()
    lines = text[: text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text
    lines = lines.splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "order_id#" in line and "product_id#" in line)
    depth, out = len(lines[at]) - len(lines[at].lstrip(" :+-")), []
    for line in reversed(lines[:at]):
        here = len(line) - len(line.lstrip(" :+-"))
        if here < depth:
            depth = here
            if "Exchange hashpartitioning" in line:
                out.append(line.split("hashpartitioning(")[1].split("#")[0])
    return out


@pytest.fixture
def wide_shop(spark):
    n = 2_000
    return {
        "customers": stage(spark.range(50).selectExpr("id AS customer_id", "'SP' AS customer_state")),
        "orders": stage(spark.range(n).selectExpr("id AS order_id", "id % 50 AS customer_id", "'shipped' AS order_status",
                                                  "'2024-01-01 00:00:00' AS order_purchase_timestamp")),
        "order_items": stage(spark.range(4 * n).selectExpr("id % 2000 AS order_id", "id % 97 AS product_id", "1.5D AS price")),
        "order_payments": stage(spark.range(n).selectExpr("id AS order_id", "id * 0.25D AS payment_value")),
        "products": stage(spark.range(97).selectExpr("id AS product_id", "concat('c', id % 7) AS product_category_name")),
    }


@pytest.mark.parametrize("name,result", [
    ("top_categories", "category"), ("category_performance", "category"), ("category_ratings", "category"),
    ("choice_architecture", "customer_id"),
])
def test_items_move_twice_for_category_reports(spark, wide_shop, name, result):
    """To the catalogue and to their order; what follows are partial results, one row per task and key."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = CATEGORY[name](build_category_rollup(wide_shop, one_row_per_key=("customers", "products")))
        assert item_exchanges(df) == ["product_id", "order_id", result]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_baskets_move_items_twice(spark, wide_shop):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tx = build_category_rollup(wide_shop, one_row_per_key=("customers", "products"))
        df = tx.groupBy("order_id").agg(F.collect_set("product_category_name"))
        assert item_exchanges(df) == ["product_id", "order_id"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_order_is_counted_before_it_moves(spark, wide_shop):
    n = 40_000
    hot = "CASE WHEN id % 3 = 0 THEN 1 ELSE id % 2000 END AS order_id"
    wide_shop["order_items"] = stage(spark.range(n).selectExpr(hot, "id % 97 AS product_id", "1.5D AS price"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        tx = build_category_rollup(wide_shop)
        text = tx._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" not in text
        assert rows(sales.category_performance(tx)) == rows(sales.category_performance(build_transactions(wide_shop)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_what_is_looked_up_about_a_table_is_looked_up_once(shop, monkeypatch):
    from basketlens.plans import transactions
    from basketlens.sources import checks

    build_category_rollup(shop, one_row_per_key=("customers", "products"))
    looks = []
    monkeypatch.setattr(transactions, "once", lambda df, name, look: looks.append(name not in checks._KNOWN.get(df, {})) or checks.once(df, name, look))
    build_category_rollup(shop, one_row_per_key=("customers", "products"))
    assert looks and not any(looks)
