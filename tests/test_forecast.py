from datetime import date

import pytest
from pyspark.sql import functions as F

from basketlens.plans import forecast

RECENT = [float(i) for i in range(1, 15)]
DONE = [100.0 + i for i in range(30)]


def test_lags_come_from_history_then_from_predictions():
    assert forecast.lags_at(0, RECENT, [], False) == (14.0, 8.0, 1.0)
    assert forecast.lags_at(3, RECENT, DONE[:3], False) == (102.0, 11.0, 4.0)
    assert forecast.lags_at(7, RECENT, DONE[:7], False) == (106.0, 100.0, 8.0)
    assert forecast.lags_at(20, RECENT, DONE[:20], False) == (119.0, 113.0, 106.0)


def test_compat_reads_the_second_week_one_step_late():
    assert forecast.lags_at(7, RECENT, DONE[:7], True) == (106.0, 101.0, 8.0)
    assert forecast.lags_at(13, RECENT, DONE[:13], True)[1] == 107.0
    for step in (0, 6, 14, 20):
        assert forecast.lags_at(step, RECENT, DONE[:step], True) == forecast.lags_at(step, RECENT, DONE[:step], False)


def test_recursion_feeds_predictions_back():
    rows = forecast.recursive_forecast(lambda x: x[4] + 1, RECENT, date(2024, 2, 28), date(2024, 1, 1), 3)
    assert [r[0] for r in rows] == [date(2024, 2, 29), date(2024, 3, 1), date(2024, 3, 2)]
    assert rows[0][1:5] == (3, 29, 2, 59)
    assert [r[-1] for r in rows] == [15.0, 16.0, 17.0]


@pytest.fixture
def daily_tx(spark):
    """Sales on n days, every third day missing."""

    def build(n):
        return spark.range(n).select(
            F.expr("timestamp_ntz'2024-01-01 12:00:00' + make_dt_interval(cast(id + id div 2 as int))").alias(
                "order_purchase_timestamp"
            ),
            F.col("id").alias("order_id"),
            (F.col("id") % 7 + 1).cast("double").alias("order_total"),
        )

    return build


def test_features_look_back_rows_not_days(daily_tx):
    rows = forecast.forecast_features(forecast.daily_sales(daily_tx(20))).orderBy("date").collect()
    assert len(rows) == 6  # the first 14 rows have no 14-row lag
    first = rows[0]
    assert (first.day_num, first.revenue, first.revenue_lag_7, first.revenue_lag_14) == (21, 1.0, 1.0, 1.0)
    assert (first.day_of_week, first.day_of_month, first.month) == (0, 22, 1)


def test_split_rounds_the_training_part_down(daily_tx):
    split = forecast.forecast_split(forecast.forecast_features(forecast.daily_sales(daily_tx(20))))
    assert [r.is_train for r in split.orderBy("date").collect()] == [True] * 4 + [False] * 2


def test_short_history_gives_an_empty_forecast(daily_tx):
    model = forecast.fit_forecast(daily_tx(20))
    assert forecast.sales_forecast(model).count() == 0
    assert forecast.forecast_metrics(model).first().rmse is None


def test_fit_and_forecast(daily_tx):
    model = forecast.fit_forecast(daily_tx(60), n_trees=3)
    out = forecast.sales_forecast(model, horizon=10).orderBy("date").collect()
    assert len(out) == 10 and out[0].date > model.last_day
    assert (out[0].date - model.first_day).days == out[0].day_num
    assert all(1.0 <= r.predicted_revenue <= 7.0 for r in out)
    old = forecast.sales_forecast(model, horizon=10, compat=True).orderBy("date").first()
    assert (old.date - model.first_feature_day).days == old.day_num
    assert forecast.forecast_metrics(model).first().rmse >= 0


def test_summary_takes_the_first_of_equal_days(spark):
    rows = [(date(2024, 1, d), v) for d, v in ((1, 1.0), (2, 5.0), (3, 5.0))]
    got = forecast.forecast_summary(spark.createDataFrame(rows, "date date, predicted_revenue double")).first()
    assert (got.total_forecast, got.avg_daily, got.peak_day) == (11.0, 11 / 3, date(2024, 1, 2))
