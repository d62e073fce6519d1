"""Column contracts of the seven input tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


class ContractError(ValueError):
    """A table or a column the analyses need is missing."""


@dataclass(frozen=True)
class Contract:
    """Column names and types of one table; required columns are not nullable."""

    schema: StructType

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema if not f.nullable]

    @property
    def optional(self) -> list[str]:
        return [f.name for f in self.schema if f.nullable]


# Table names, column names and which of them are required.
_TABLES = {
    "customers": (
        "customer_id string",
        "customer_unique_id string, customer_zip_code_prefix string, customer_city string, customer_state string",
    ),
    "orders": (
        "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz",
        "order_approved_at timestamp_ntz, order_delivered_customer_date timestamp_ntz,"
        " order_estimated_delivery_date timestamp_ntz",
    ),
    "order_items": (
        "order_id string, product_id string, price double",
        "order_item_id int, seller_id string, shipping_limit_date timestamp_ntz, freight_value double",
    ),
    "order_payments": (
        "order_id string, payment_value double",
        "payment_sequential int, payment_type string, payment_installments int",
    ),
    "products": (
        "product_id string",
        "product_category_name string, product_name_length int, product_description_length int,"
        " product_photos_qty int, product_weight_g double, product_length_cm double,"
        " product_height_cm double, product_width_cm double",
    ),
    "product_translation": (
        "product_category_name string",
        "product_category_name_english string",
    ),
    "reviews": (
        "order_id string",
        "review_id string, review_score double, review_comment_title string, review_comment_message string,"
        " review_creation_date timestamp_ntz, review_answer_timestamp timestamp_ntz",
    ),
}
MINIMUM_TABLES = ("customers", "orders", "order_items")


_TYPES = {
    "string": StringType(),
    "int": IntegerType(),
    "double": DoubleType(),
    "timestamp_ntz": TimestampNTZType(),
}


def _schema(required: str, optional: str) -> StructType:
    out = StructType()
    for part, nullable in ((required, False), (optional, True)):
        for column in part.split(","):
            name, kind = column.split()
            out.add(StructField(name, _TYPES[kind], nullable))
    return out


CONTRACTS = {name: Contract(_schema(required, optional)) for name, (required, optional) in _TABLES.items()}


def contract(name: str) -> Contract:
    if name not in CONTRACTS:
        raise ContractError(f"unknown table {name!r}; expected one of {', '.join(CONTRACTS)}")
    return CONTRACTS[name]


def missing_columns(df: DataFrame, name: str) -> list[str]:
    """Required columns that df lacks. Reads names only, never data."""
    return [c for c in contract(name).required if c not in df.columns]


def validate(df: DataFrame, name: str) -> DataFrame:
    """Return df, or raise naming the required columns it lacks."""
    missing = missing_columns(df, name)
    if missing:
        raise ContractError(f"{name}: missing required columns: {', '.join(missing)}")
    return df


def require_minimum(datasets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Return datasets, or raise naming the tables without which nothing can be built."""
    missing = [name for name in MINIMUM_TABLES if name not in datasets]
    if missing:
        raise ContractError(f"missing required tables: {', '.join(missing)}")
    return datasets
