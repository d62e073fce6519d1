import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketlens.operators import binning
from basketlens.operators.ranking import exact_quantiles, global_rank

few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
numbers = st.lists(st.integers(-40, 40), min_size=2, max_size=60)


def values(spark, data, slices=3):
    rows = [(i, None if x is None else float(x)) for i, x in enumerate(data)]
    return spark.createDataFrame(rows, "id int, x double").repartition(slices)


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


@few
@given(st.lists(st.floats(-1e6, 1e6), min_size=2, max_size=40))
def test_both_ways_to_quantiles_equal_numpy_to_the_last_digit(spark, data):
    probs = [0, 0.1, 0.25, 0.5, 0.75, 1]
    df = spark.createDataFrame([(float(x),) for x in data], "x double").repartition(3)
    want = [float(v) for v in np.quantile(np.array(data, float), probs)]
    assert exact_quantiles(df, "x", probs, distinct_limit=0) == want
    assert exact_quantiles(df, "x", probs, distinct_limit=100_000) == want


@pytest.mark.parametrize("limit", [0, 100_000])
def test_quantiles_of_counted_rows_and_of_nothing(spark, limit):
    counted = spark.createDataFrame([(1.0, 7), (5.0, 1), (None, 3)], "x double, n bigint")
    assert exact_quantiles(counted, "x", [0.5, 1], weight="n", distinct_limit=limit) == [1.0, 5.0]
    assert exact_quantiles(counted.filter("n = 0"), "x", [0.5], distinct_limit=limit) == [None]


@few
@given(numbers)
def test_global_rank_equals_pandas_rank_first(spark, data):
    got = column(global_rank(values(spark, data, 5), ["x", "id"], total="n"), "rank")
    assert got == list(pd.Series(data).rank(method="first").astype(int))


def test_global_rank_spreads_a_heavy_value(spark):
    df = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("x"))
    parts = df.repartitionByRange("x", "id").groupBy(F.spark_partition_id()).count().collect()
    ranked = global_rank(df, ["x", "id"]).orderBy("x", "id").select("rank").collect()
    assert [r[0] for r in ranked] == list(range(1, 4001))
    assert len(parts) >= 1


@few
@given(numbers)
def test_qcut_is_the_place_among_the_edges(spark, data):
    x = np.array(data, float)
    edges = np.quantile(x, [0, 0.25, 0.5, 0.75, 1])
    if len(set(edges.tolist())) < 5:
        # Tied edges: four bins of equal width, around a single value if there is no other.
        low, high = (x.min(), x.max()) if x.min() < x.max() else (x[0] - 0.001 * (abs(x[0]) or 1), x[0] + 0.001 * (abs(x[0]) or 1))
        edges = np.linspace(low, high, 5)
    want = np.clip(np.searchsorted(edges, x, side="left"), 1, 4)
    assert column(binning.qcut(values(spark, data), "x", 4, "b"), "b") == want.tolist()


def test_qcut_labels_and_tied_edges(spark):
    data = [1, 1, 1, 1, 2, 3]
    assert column(binning.qcut(values(spark, data), "x", 4, "b", [4, 3, 2, 1]), "b") == [4, 4, 4, 4, 3, 1]
    with_null = binning.qcut(values(spark, [1, 2, None, 3, 4]), "x", 4, "b")
    assert column(with_null, "b") == [1, 2, None, 3, 4]


@pytest.mark.parametrize(
    ("n", "expect"),
    [(1, [2]), (6, [1, 1, 2, 3, 4, 4]), (7, [1, 1, 2, 2, 3, 4, 4]), (10, [1, 1, 1, 2, 2, 3, 3, 4, 4, 4])],
)
def test_rank_qcut_small(spark, n, expect):
    assert column(binning.rank_qcut(values(spark, [5] * n), "x", "id", 4, "b"), "b") == expect


@few
@given(numbers)
def test_rank_qcut_equals_pandas(spark, data):
    expect = pd.qcut(pd.Series(data).rank(method="first"), q=4, labels=[1, 2, 3, 4]).astype(int)
    assert column(binning.rank_qcut(values(spark, data), "x", "id", 4, "b"), "b") == list(expect)


@few
@given(numbers, st.sampled_from([3, 4, 10]))
def test_cut_equals_pandas(spark, data, bins):
    expect = pd.cut(pd.Series(data, dtype=float), bins=bins, labels=False) + 1
    assert column(binning.cut(values(spark, data), "x", bins, "b"), "b") == list(expect)


def test_cut_on_many_floats_equals_pandas(spark):
    data = np.random.default_rng(7).normal(100, 37, 3000).round(2)
    expect = pd.cut(pd.Series(data), bins=50, labels=False) + 1
    assert column(binning.cut(values(spark, data), "x", 50, "b"), "b") == list(expect)


def test_cut_is_right_closed(spark):
    assert column(binning.cut(values(spark, [0, 5, 10]), "x", 10, "b"), "b") == [1, 5, 10]


def test_histogram_keeps_empty_bins_and_weights(spark):
    got = binning.histogram(values(spark, [0, 10, 10, None]), "x", 4).orderBy("bin").collect()
    assert [tuple(r) for r in got] == [(1, 0.0, 2.5, 1), (2, 2.5, 5.0, 0), (3, 5.0, 7.5, 0), (4, 7.5, 10.0, 2)]
    weighted = spark.createDataFrame([(0.0, 3), (4.0, 2)], "x double, n bigint")
    assert [r["count"] for r in binning.histogram(weighted, "x", 2, weight="n").orderBy("bin").collect()] == [3, 2]


def test_risk_edges(spark):
    df = values(spark, [0, 0.3, 0.30001, 0.7, 1])
    banded = df.withColumn("b", binning.cut_edges("x", [0.0, 0.3, 0.7, 1.0], ["Low", "Medium", "High"]))
    assert column(banded, "b") == [None, "Low", "Medium", "Medium", "High"]


def test_top_k_breaks_ties_by_key_and_puts_nulls_last(spark):
    df = values(spark, [1, None, 3, 3, 2])
    assert [r.id for r in binning.top_k(df, 3, "x", "id").collect()] == [2, 3, 4]
    assert [r.id for r in binning.top_k(df, 5, "x", "id").collect()] == [2, 3, 4, 0, 1]


def test_value_counts(spark):
    got = binning.value_counts(values(spark, [2, 1, 2, None, 1, 3]), "x").collect()
    assert [tuple(r) for r in got] == [(1.0, 2), (2.0, 2), (3.0, 1)]
