from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from basketlens.session import local_session  # noqa: E402
from basketlens.sources.staging import clear_staged  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", app="tests", memory="6g")
    yield session
    clear_staged(session)
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """frame("a int, b string", (1, "x"), ...) -> DataFrame"""
    return lambda schema, *rows: spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


@pytest.fixture
def shop(frame):
    """A small shop with all seven tables; the tests state what they add to it."""
    return {
        "customers": frame("customer_id string, customer_state string", ("c1", "SP"), ("c2", "RJ")),
        "orders": frame(
            "order_id string, customer_id string, order_status string, order_purchase_timestamp string",
            ("o1", "c1", "delivered", "2024-01-06 10:30:00"),
            ("o2", "c2", "shipped", "2024-02-07 23:59:59"),
            ("o3", "c1", "canceled", "2024-02-08 00:00:00"),
            ("o4", "c2", "delivered", "not a time"),
        ),
        "order_items": frame(
            "order_id string, product_id string, price double, freight_value double",
            ("o1", "p1", 10.0, 0.0),
            ("o1", "p2", 20.0, 5.0),
            ("o1", "p1", 30.0, None),
            ("o2", "p2", 40.0, 1.0),
            ("o3", "p1", 50.0, 1.0),
            ("o4", "p3", 60.0, 0.0),
            ("o9", "p1", 70.0, 0.0),
        ),
        "order_payments": frame(
            "order_id string, payment_value double, payment_type string, payment_sequential int",
            ("o1", 50.0, None, 1),
            ("o1", 40.0, "voucher", 3),
            ("o1", 0.0, "card", 2),
            ("o2", 45.5, "card", 1),
        ),
        "products": frame(
            "product_id string, product_category_name string", ("p1", "livros"), ("p2", "moveis"), ("p3", "outro")
        ),
        "product_translation": frame(
            "product_category_name string, product_category_name_english string",
            ("livros", "books"),
            ("moveis", "furniture"),
        ),
        "reviews": frame("order_id string, review_score double", ("o1", 5.0), ("o1", 2.0), ("o2", 1.0), ("o2", None)),
    }
