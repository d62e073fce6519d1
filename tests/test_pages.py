"""Pages from one scan, ranks of several measures in one job, histograms in two scans."""

import random

import pytest
from pyspark.sql import functions as F

from basketlens.operators.binning import histogram, histograms
from basketlens.operators.ranking import exact_quantiles, global_rank, global_ranks, ranked_quantiles
from basketlens.plans import behavior, overview, pages, sales
from basketlens.plans.transactions import build_category_rollup, build_transactions
from basketlens.sources.staging import stage


@pytest.fixture
def big_shop(spark, frame):
    """A staged shop with gaps, ties, orders without customers and an order row that is there twice."""
    rng = random.Random(4)
    orders = [(i, rng.choice((None, *range(12))), "shipped", f"2024-0{rng.randint(1, 6)}-0{rng.randint(1, 9)} 10:00:00") for i in range(120)]
    orders += [(7, 3, "shipped", "2024-01-05 10:00:00"), (500, 1, "canceled", "2024-01-05 10:00:00"), (501, 2, "shipped", None)]
    items = [(rng.randrange(125), rng.choice((None, *range(20))), rng.randint(1, 999) / 100) for _ in range(600)] + [(501, 3, 1.0)]
    tables = {
        "customers": frame("customer_id int, customer_state string", *[(i, rng.choice(("SP", "RJ", None))) for i in range(12)]),
        "orders": frame("order_id int, customer_id int, order_status string, order_purchase_timestamp string", *orders),
        "order_items": frame("order_id int, product_id int, price double", *items),
        "order_payments": frame("order_id int, payment_value double, payment_type string", *[(i, rng.randint(0, 9999) / 100, rng.choice(("card", "cash", None))) for i in range(110)]),
        "products": frame("product_id int, product_category_name string", *[(i, f"c{i % 6}" if i % 5 else None) for i in range(17)]),
        "reviews": frame("order_id int, review_score double", *[(i, float(rng.randint(1, 5))) for i in range(0, 120, 2)]),
    }
    return {name: stage(df) for name, df in tables.items()}


def page(df):
    return {(r.section, r.key, r.metric): r.value for r in df.collect()}


@pytest.mark.parametrize("build", [build_category_rollup, build_transactions])
def test_overview_page_equals_its_figures(big_shop, build):
    tx = build(big_shop)
    got = page(pages.overview_page(tx, n=3))
    want = {}
    for report in (overview.overview_kpis, overview.repeat_rate, overview.avg_items_per_order, overview.avg_review, behavior.status_quo_bias):
        want |= {("figures", None, k): v for k, v in report(build_transactions(big_shop)).first().asDict().items()}
    want |= {("month", r.order_year_month, "revenue"): r.revenue for r in overview.monthly_revenue(tx).collect()}
    want |= {("month", r.order_year_month, "orders"): r.orders for r in overview.monthly_orders(tx).collect()}
    want |= {("category", r.category, "revenue"): r.revenue for r in overview.top_categories(tx, 3).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


@pytest.mark.parametrize("build", [build_category_rollup, build_transactions])
def test_sales_page_equals_its_figures(big_shop, build):
    tx = build(big_shop)
    want = {("payment", r.payment_type, "orders"): r.orders for r in sales.payment_mix(tx).collect()}
    for section, report in (("state", sales.state_revenue), ("category", sales.category_performance)):
        for r in report(build_transactions(big_shop), 4).collect():
            key, *values = r.asDict().items()
            want |= {(section, key[1], k): v for k, v in values}
    assert page(pages.sales_page(tx, n=4)) == want


@pytest.mark.parametrize("report", [pages.overview_page, pages.sales_page])
def test_a_page_scans_every_table_once(big_shop, report):
    text = report(build_category_rollup(big_shop))._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == len(big_shop) - (report is pages.sales_page)  # no reviews among the sales


def test_a_shop_without_the_optional_tables(shop):
    least = {name: shop[name] for name in ("customers", "orders", "order_items")}
    got = page(pages.overview_page(build_category_rollup(least)))
    assert got["figures", None, "total_orders"] == 3 and got["figures", None, "avg_review"] is None
    assert {s for s, *_ in page(pages.sales_page(build_category_rollup(least)))} == {"state"}
    none = build_category_rollup(shop).filter("order_id = 'none'")
    assert pages.overview_page(none).count() == pages.sales_page(none).count() == 0


def test_ranks_of_several_measures_equal_single_ones(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice((None, 0, 0, rng.randrange(50))), rng.random(), 7) for i in range(3000)]
    df = stage(spark.createDataFrame(rows, "id int, a int, b double, c int"))
    ranks = stage(global_ranks(df, "id", ["a", "b", "c"]))
    for i, m in enumerate(("a", "b", "c")):
        one = {r.id: (r["rank"], r.n) for r in global_rank(df.filter(F.col(m).isNotNull()), [m, "id"], total="n").collect()}
        assert {r.id: (r["rank"], r.total) for r in ranks.filter(F.col("measure") == i).collect()} == one
    probs = [0, 0.1, 0.25, 1 / 3, 0.5, 0.99, 1]
    got = ranked_quantiles(ranks, {0: probs, 1: probs, 2: [0.5]})
    assert got == {0: exact_quantiles(df, "a", probs), 1: exact_quantiles(df, "b", probs), 2: [7.0]}


def test_ranks_of_nothing(spark):
    df = stage(spark.createDataFrame([(1, None)], "id int, a int"))
    ranks = global_ranks(df, "id", ["a"])
    assert ranks.count() == 0 and ranked_quantiles(ranks, {0: [0.5]}) == {0: [None]}


def test_histograms_of_several_columns(spark):
    rng = random.Random(2)
    rows = [(rng.choice((None, rng.randrange(9))), rng.gauss(0, 1), 5, None) for _ in range(500)]
    df = stage(spark.createDataFrame(rows, "a int, b double, c int, d int"))
    got = histograms(df, ["a", "b", "c", "d"], 7)
    for m in "abcd":
        one = [tuple(r) for r in histogram(df, m, 7).orderBy("bin").collect()]
        assert [tuple(r)[1:] for r in got.filter(F.col("measure") == m).orderBy("bin").collect()] == one
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1  # the other scan found the bounds
