"""Calendar features on TIMESTAMP_NTZ columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole 24-hour days from start to end (not the number of midnights passed)."""
    return F.timestamp_diff("DAY", start, end)


def time_features(ts: str) -> dict[str, Column]:
    """Features of the purchase time. Text forms go through the date, which has no zone."""
    day = F.to_date(ts)
    return {
        "order_month": F.trunc(day, "month"),
        "order_year_month": F.date_format(day, "yyyy-MM"),
        "purchase_hour": F.hour(ts),
        "purchase_day": F.date_format(day, "EEEE"),
        "purchase_month": F.date_format(day, "MMMM"),
        "purchase_day_of_week": F.weekday(day),
        "is_weekend": F.coalesce(F.weekday(day) >= 5, F.lit(False)),
    }
