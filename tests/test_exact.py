import math

import pytest
from pyspark.sql import functions as F

from basketlens.functions.exact import exact_mean, exact_sum, money_sum, sum_of_sums, total
from basketlens.plans import overview
from basketlens.plans.transactions import build_order_rollup, build_transactions
from basketlens.sources.contracts import ContractError


def summed(spark, values, slices=3):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(slices)
    return df.agg(exact_sum("x").alias("s")).first().s


@pytest.mark.parametrize("n", [3, 6, 7, 11, 13])
def test_shares_of_an_amount_add_up_to_it(spark, n):
    assert summed(spark, [100 / n] * n) == pytest.approx(100.0, abs=1e-12)


@pytest.mark.parametrize(
    "values", [[1e-7] * 1000, [1e-17] * 10, [1e19, 1.0], [2.0**40, 0.5, -3.25], [1e-9, 1e9, 123456.789], [0.1] * 10]
)
def test_nothing_is_cut(spark, values):
    assert summed(spark, values) == pytest.approx(math.fsum(values), rel=1e-12)


def test_infinite_missing_and_no_values(spark):
    assert summed(spark, [1.0, float("inf")]) == float("inf")
    assert summed(spark, [1.0, float("nan"), None]) == 1.0
    assert summed(spark, []) == 0.0
    assert spark.createDataFrame([], "x double").agg(exact_mean("x").alias("m")).first().m is None


def test_cents_do_not_depend_on_partitions(spark):
    values = [round(0.01 * (i * 7919 % 100_003), 2) for i in range(5000)]
    want = sum(round(v * 100) for v in values) / 100
    assert {summed(spark, values, n) for n in (1, 3, 8)} == {want}


def test_sums_of_sums_and_weights(spark):
    df = spark.createDataFrame([(i % 4, 100 / 7, 7) for i in range(28)], "k int, x double, n int")
    per = df.groupBy("k").agg(money_sum("x", weight="n").alias("t"))
    assert per.agg(total(sum_of_sums("t")).alias("s")).first().s == pytest.approx(2800.0, abs=1e-9)


def test_shared_totals_are_the_payments(shop):
    shared = build_transactions(shop | {"order_payments": shop["order_payments"].withColumn("payment_value", F.lit(100.0))},
                                total="item_share").filter("order_id = 'o1'")
    assert overview.overview_kpis(shared).first().total_revenue == 300.0


@pytest.mark.parametrize("table, key", [("customers", "customer_id"), ("products", "product_id")])
def test_a_repeated_id_is_an_error_where_it_was_promised_to_be_unique(shop, table, key):
    twice = shop | {table: shop[table].union(shop[table].limit(1))}
    for build in (build_transactions, build_order_rollup):
        with pytest.raises(ContractError, match=key):
            build(twice, one_row_per_key=(table,))


def test_without_the_promise_rollup_and_items_agree_on_repeated_ids(shop):
    twice = shop | {t: shop[t].union(shop[t].limit(1)) for t in ("customers", "products")}
    for analysis in (overview.avg_items_per_order, overview.overview_kpis, overview.avg_review):
        assert analysis(build_order_rollup(twice)).collect() == analysis(build_transactions(twice)).collect()
