"""Shape of the physical plans and behaviour under skew."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from basketlens.plans import overview
from basketlens.plans.transactions import build_transactions
from basketlens.sources.staging import clear_staged, stage, stage_by_month, staging

PATH = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text):
    return text.count("FileScan parquet")


def test_unused_joins_and_columns_are_left_out(spark):
    text = plan(registry.queries()["monthly_revenue"](spark, PATH))
    assert "customer.parquet" not in text and "part.parquet" not in text
    assert "l_returnflag" not in text and "l_extendedprice" not in text
    assert scans(text) == 3  # items, orders, payments


def test_counting_customers_needs_items_and_orders_only(spark):
    assert scans(plan(registry.queries()["repeat_rate"](spark, PATH))) == 2


@pytest.mark.parametrize("name", ["overview_kpis", "state_revenue", "category_performance", "clv", "tx_base"])
def test_no_plan_has_a_cartesian_product(spark, name):
    text = plan(registry.queries()[name](spark, PATH))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_items_are_shuffled_once_for_order_level_figures(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(registry.queries()["monthly_orders"](spark, PATH))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Items and orders by order_id; months twice only if the order-level step needed a shuffle of its own.
    assert text.count("Exchange hashpartitioning") == 3


def test_a_hot_order_is_split_over_tasks(spark):
    """A third of all items belong to one order."""
    n = 30_000
    hot = F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id"))
    items = stage(
        spark.range(0, n, 1, 8).select(
            hot.alias("order_id"), F.col("id").alias("product_id"), F.lit(1.0).alias("price"),
            F.sha2(F.col("id").cast("string"), 512).alias("note"),
        )
    )
    orders = stage(
        spark.range(n).select(
            F.col("id").alias("order_id"), (F.col("id") % 50).alias("customer_id"),
            F.lit("shipped").alias("order_status"), F.lit("2024-01-01 00:00:00").alias("order_purchase_timestamp"),
        )
    )
    customers = spark.range(50).select(F.col("id").alias("customer_id"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        tx = build_transactions({"customers": customers, "orders": orders, "order_items": items})
        kept = tx.select("order_id", "customer_id", "note")
        result = kept.groupBy("order_id").agg(F.count("note").alias("n"))
        assert result.filter("n > 1").select("n").first().n == n // 3 + 1
        result.collect()
        text = result._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert "isSkew=true" in text or "skew=true" in text


def test_results_do_not_depend_on_partitioning(spark):
    tx = registry._tx(spark, PATH)
    one = overview.overview_kpis(tx).first()
    assert overview.overview_kpis(tx.repartition(17)).first() == one


@pytest.fixture
def months(spark):
    """All transactions, staged by month, and the settings under which nothing is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    tx = registry._tx(spark, PATH)
    yield tx, stage_by_month(tx)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["monthly_revenue", "monthly_orders", "overview_kpis", "category_performance", "tx_base"])
def test_results_on_months_are_the_same(months, name):
    tx, staged = months
    analysis = registry.ANALYSES[name]
    assert sorted(map(repr, analysis(staged).collect())) == sorted(map(repr, analysis(tx).collect()))


def test_one_month_reads_one_folder(spark, months):
    _, staged = months
    month = staged.selectExpr("max(order_year_month)").first()[0]
    one = overview.monthly_revenue(staged.filter(F.col("order_year_month") == month))
    assert one.collect()[0].order_year_month == month
    leaf = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in leaf and f"= {month})" in leaf.split("PartitionFilters")[1]
    files = staged.filter(F.col("order_year_month") == month).select(F.input_file_name()).distinct().collect()
    assert files and all(f"order_year_month={month}/" in r[0] for r in files)


@pytest.mark.parametrize("name,results", [("monthly_orders", 1), ("category_performance", 1), ("repeat_rate", 2)])
def test_orders_of_groups_are_counted_where_they_lie(months, name, results):
    """Exchanges move partial results per group (and per customer), never items."""
    text = plan(registry.ANALYSES[name](months[1]))
    assert "Bucketed: true" in text
    first = text[: text.index("FileScan")].splitlines()
    below = [line for line in first if "Exchange hashpartitioning" in line]
    assert len(below) <= results and not any("order_id" in line for line in below)


def test_staged_months_join_by_order_without_moving(spark, months):
    _, staged = months
    orders = stage_by_month(staged.select("order_id", "order_year_month", "customer_id").distinct())
    joined = staged.select("order_id", "price").join(orders.select("order_id", "customer_id"), "order_id")
    assert "Exchange hashpartitioning" not in plan(joined) and joined.count() == staged.count()


def test_a_heavy_order_leaves_the_buckets_out(spark):
    df = spark.range(4000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS order_id", "cast(id % 2 AS string) AS order_year_month")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        staged = stage_by_month(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    text = plan(staged.filter("order_year_month = '1'"))
    assert "Bucketed: true" not in text and "PartitionFilters: [" in text
    assert sorted(staged.collect()) == sorted(df.collect())


def test_null_months_and_ids_stay(spark, frame):
    df = frame("order_id int, order_year_month string, x int", (1, "2024-01", 1), (None, "2024-01", 2), (2, None, 3), (2, None, 3))
    assert sorted(map(repr, stage_by_month(df).collect())) == sorted(map(repr, df.collect()))


def test_staged_months_are_dropped(spark):
    df = spark.range(5).selectExpr("id AS order_id", "'m' AS order_year_month")
    before = {t.name for t in spark.catalog.listTables()}
    with staging(spark):
        stage_by_month(df)
        assert len({t.name for t in spark.catalog.listTables()} - before) == 1
    assert {t.name for t in spark.catalog.listTables()} == before
    assert callable(clear_staged)


def test_partitioned_staging(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).cast("string").alias("month"))
    back = stage(df)
    assert back.columns == ["id", "month"] and back.filter("month = '1'").count() == 33
