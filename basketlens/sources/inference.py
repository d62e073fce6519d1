"""Types of text columns, from all their values in one aggregate.

Every value has a smallest type: boolean, integer, double, timestamp or text. A column takes the smallest type that
holds all its values: integer < double < text; boolean and timestamp mix with nothing but text. As each kind of value is one
bit, the fold is a bitwise or, combined in every task. Columns without values stay text.

A value is a number only if the number gives its digits back as they were meant: "007", "1_000" and "1d" are text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOOLEAN, INTEGER, DOUBLE, TIMESTAMP, TEXT = 1, 2, 4, 8, 16
# The forms of the types, and the type of each set of kinds.
_BOOLEAN = r"^(true|True|TRUE|false|False|FALSE)$"
_INTEGER = r"^[+-]?(0|[1-9][0-9]{0,18})$"
_DOUBLE = r"^[+-]?((0|[1-9][0-9]*)?\.[0-9]+|(0|[1-9][0-9]*)\.?)([eE][+-]?[0-9]+)?$|^[+-]?(inf|Inf|INF|Infinity)$"
_TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?$"
_TYPES = {BOOLEAN: "boolean", INTEGER: "bigint", DOUBLE: "double", INTEGER | DOUBLE: "double", TIMESTAMP: "timestamp_ntz"}


def kind(c: Column) -> Column:
    """The bit of a value's smallest type; NULL for NULL."""
    return (
        F.when(c.isNull(), F.lit(None).cast("int"))
        .when(c.rlike(_INTEGER) & c.try_cast("bigint").isNotNull(), INTEGER)
        .when(c.rlike(_DOUBLE) & c.try_cast("double").isNotNull(), DOUBLE)
        .when(c.rlike(_BOOLEAN), BOOLEAN)
        .when(c.rlike(_TIMESTAMP) & c.try_cast("timestamp_ntz").isNotNull(), TIMESTAMP)
        .otherwise(TEXT)
    )


def infer_types(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The type of each text column, from one pass over them."""
    if not columns:
        return {}
    quoted = [F.col(f"`{c.replace('`', '``')}`") for c in columns]
    found = df.agg(*[F.bit_or(kind(c)).alias(f"c{i}") for i, c in enumerate(quoted)]).first()
    return {c: _TYPES.get(found[i] or TEXT, "string") for i, c in enumerate(columns)}


def typed_column(name: str, type_name: str) -> Column:
    """A text column as the type that was inferred for it."""
    return F.col(f"`{name.replace('`', '``')}`").try_cast(type_name).alias(name)
