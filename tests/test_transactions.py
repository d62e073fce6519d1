import datetime as dt

import pytest

from basketlens.plans import behavior, overview, products, sales
from basketlens.plans.transactions import build_transactions, category_column, payments_per_order
from basketlens.sources.contracts import ContractError


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_one_row_per_item_of_a_sold_order(shop):
    tx = build_transactions(shop)
    assert rows(tx, "order_id", "product_id", "price") == [
        ("o1", "p1", 10.0), ("o1", "p1", 30.0), ("o1", "p2", 20.0), ("o2", "p2", 40.0), ("o4", "p3", 60.0),
    ]


def test_payment_total_repeats_on_items_or_is_shared(shop):
    repeated = build_transactions(shop).filter("order_id = 'o1'")
    shared = build_transactions(shop, total="item_share").filter("order_id = 'o1'")
    assert overview.overview_kpis(repeated).first().total_revenue == 270.0
    assert overview.overview_kpis(shared).first().total_revenue == 90.0
    with pytest.raises(ContractError):
        build_transactions(shop, total="other")


def test_first_payment_type_is_the_earliest_that_has_one(shop):
    paid = {r.order_id: r for r in payments_per_order(shop["order_payments"]).collect()}
    assert (paid["o1"].payment_value, paid["o1"].payment_type) == (90.0, "card")
    plain = payments_per_order(shop["order_payments"].drop("payment_sequential"))
    assert {r.order_id: r.payment_type for r in plain.collect()} == {"o1": "card", "o2": "card"}
    assert "payment_type" not in payments_per_order(shop["order_payments"].drop("payment_type")).columns


def test_sum_of_missing_payments_is_zero(frame):
    paid = payments_per_order(frame("order_id string, payment_value double", ("o", None)))
    assert paid.first().payment_value == 0.0


def test_reviews_are_averaged_per_order(shop):
    assert set(rows(build_transactions(shop), "order_id", "review_score")) == {
        ("o1", 3.5), ("o2", 1.0), ("o4", None),
    }


def test_time_features(shop):
    by_order = {r.order_id: r for r in build_transactions(shop).collect()}
    o1, o2, o4 = by_order["o1"], by_order["o2"], by_order["o4"]
    assert (o1.order_month, o1.order_year_month) == (dt.date(2024, 1, 1), "2024-01")
    assert (o1.purchase_hour, o1.purchase_day, o1.purchase_month) == (10, "Saturday", "January")
    assert (o1.purchase_day_of_week, o1.is_weekend) == (5, True)
    assert (o2.purchase_hour, o2.purchase_day_of_week, o2.is_weekend) == (23, 2, False)
    assert (o4.order_purchase_timestamp, o4.order_year_month, o4.is_weekend) == (None, None, False)


def test_shipping_features(shop):
    got = {(r.order_id, r.price): (r.has_free_shipping, r.freight_ratio) for r in build_transactions(shop).collect()}
    assert got[("o1", 10.0)] == (True, 0.0)
    assert got[("o1", 20.0)] == (False, 5.0 / 21.0)
    assert got[("o1", 30.0)] == (False, None)


def test_price_of_minus_one_gives_no_ratio(shop, frame):
    shop["order_items"] = frame(
        "order_id string, product_id string, price double, freight_value double", ("o1", "p1", -1.0, 2.0)
    )
    assert build_transactions(shop).first().freight_ratio is None


def test_minimum_tables_only(shop):
    least = {k: shop[k] for k in ("customers", "orders")}
    least["order_items"] = shop["order_items"].drop("freight_value")
    tx = build_transactions(least)
    assert category_column(tx) is None
    assert set(rows(tx, "freight_value", "has_free_shipping")) == {(0.0, True)}
    assert rows(tx.filter("order_id = 'o1'"), "order_total") == [(10.0,), (20.0,), (30.0,)]
    assert overview.top_categories(tx).count() == 0
    assert overview.avg_review(tx).first().avg_review is None
    assert sales.payment_mix(tx).count() == 0
    assert behavior.social_proof(tx).first().high_rated_rows == 0
    assert products.price_review_corr(tx).first().price_review_corr is None


def test_untranslated_categories_leave_category_reports(shop):
    tx = build_transactions(shop)
    assert category_column(tx) == "product_category_name_english"
    assert rows(overview.top_categories(tx), "category") == [("books",), ("furniture",)]
    del shop["product_translation"]
    assert overview.top_categories(build_transactions(shop)).count() == 3


def test_null_category_meets_a_null_translation(shop, frame):
    schema = "product_category_name string, product_category_name_english string"
    shop["product_translation"] = frame(schema, (None, "none"))
    shop["products"] = frame("product_id string, product_category_name string", ("p1", None))
    got = set(rows(build_transactions(shop), "product_id", "product_category_name_english"))
    assert ("p1", "none") in got and ("p2", "none") in got  # p2 is in no product row, so its category is null too


def test_repeated_dimension_keys_multiply_rows_unless_declared_single(shop, frame):
    shop["customers"] = frame("customer_id string, customer_state string", ("c1", "SP"), ("c1", "SP"))
    assert build_transactions(shop).count() == 3 * 2 + 2
    with pytest.raises(ContractError, match="customer_id"):
        build_transactions(shop, one_row_per_key=("customers",))


def test_colliding_columns_are_prefixed(shop):
    shop["products"] = shop["products"].withColumnRenamed("product_category_name", "price")
    tx = build_transactions(shop)
    assert "products_price" in tx.columns and dict(tx.dtypes)["price"] == "double"


def test_null_group_keys_are_not_reported(shop, frame):
    shop["customers"] = frame("customer_id string, customer_state string", ("c1", None), ("c2", "RJ"))
    assert rows(sales.state_revenue(build_transactions(shop)), "customer_state") == [("RJ",)]


def test_behaviour_sides_that_are_absent_are_zero(shop):
    tx = build_transactions(shop).filter("order_id = 'o2'")
    got = behavior.free_shipping_effect(tx).first().asDict()
    assert got == {
        "free_shipping_orders": 0, "paid_shipping_orders": 1, "avg_order_free": 0.0, "avg_order_paid": 45.5,
    }


def test_social_proof_counts_rows_and_orders(shop):
    got = behavior.social_proof(build_transactions(shop)).first()
    assert (got.high_rated_rows, got.low_rated_rows, got.low_rated_orders) == (0, 1, 1)
    assert (got.avg_high_rated_price, got.avg_low_rated_price) == (0.0, 40.0)


def test_peak_hours_order_and_ties(frame):
    tx = frame("order_id int, purchase_hour int", (1, 9), (2, 9), (3, 7), (4, 5), (4, 5), (5, 3), (6, None))
    got = behavior.peak_hours(tx).first()
    assert (got.peak_hours, got.peak_hour_orders) == ("9, 3, 5", 2)


def test_empty_shop_reports_zero_customers(shop):
    tx = build_transactions(shop).filter("order_id = 'none'")
    got = behavior.status_quo_bias(tx).first()
    assert (got.status_quo_bias, got.total_customers, got.repeat_customers) == (0.0, 0, 0)


def test_an_order_of_two_customers_counts_once(frame):
    tx = frame(
        "order_id int, customer_id int, order_total double", (1, 1, 5.0), (1, 2, 5.0), (1, 1, 2.5), (2, None, 1.0), (3, 2, None)
    )
    got = overview.overview_kpis(tx).first()
    assert (got.total_revenue, got.total_orders, got.total_customers) == (13.5, 3, 2)
    assert overview.overview_kpis(tx.filter("order_id > 9")).first().total_orders == 0
