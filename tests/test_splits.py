"""Exact split search, stumps, and k-means with shared passes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.operators import kmeans
from basketlens.operators.kmeans import lloyd, nearest, seeded
from basketlens.operators.splits import best_splits
from basketlens.plans import churn, forecast
from basketlens.sources.staging import stage


def plain_splits(rows, features, y):
    """Every cut of every feature, its gain from the definition: the drop in squares around the means."""
    out = {}
    for f in features:
        pairs = sorted((r[f], r[y]) for r in rows if r[f] is not None and r[y] is not None)
        values = sorted({v for v, _ in pairs})

        def squares(part):
            mean = sum(part) / len(part)
            return sum((x - mean) ** 2 for x in part)

        best = None
        for a, b in zip(values, values[1:]):
            left, right = [x for v, x in pairs if v <= a], [x for v, x in pairs if v > a]
            gain = squares([x for _, x in pairs]) - squares(left) - squares(right)
            if best is None or gain > best[0] + 1e-9:
                best = gain, (a + b) / 2, len(left), sum(left) / len(left), sum(right) / len(right)
        if best:
            out[f] = best
    return out


@pytest.mark.parametrize("seed,kind", [(1, "class"), (2, "class"), (3, "number"), (4, "number")])
def test_splits_equal_trying_every_cut(spark, seed, kind):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        a, b = rng.choice((None, *range(15))), rng.gauss(0, 1)
        c = 7 if rng.random() < 0.9 else rng.randrange(100)
        y = None if rng.random() < 0.02 else (int(b + rng.gauss(0, 1) > 0.3) if kind == "class" else round(3 * b + (a or 0) + rng.random(), 2))
        rows.append({"a": a, "b": b, "c": c, "d": 1, "y": y})
    schema = "a int, b double, c int, d int, y double"
    df = spark.createDataFrame([(r["a"], r["b"], r["c"], r["d"], None if r["y"] is None else float(r["y"])) for r in rows], schema)
    want = plain_splits(rows, "abcd", "y")
    got = {r.feature: r for r in best_splits(df, ["a", "b", "c", "d"], "y").collect()}
    assert set(got) == set(want) == {"a", "b", "c"}  # d has one value, so no cut
    for f, (gain, threshold, n, left, right) in want.items():
        r = got[f]
        assert r.gain == pytest.approx(gain, abs=1e-6) and (r.threshold, r.left_rows) == (pytest.approx(threshold), n)
        assert (r.left_mean, r.right_mean) == (pytest.approx(left), pytest.approx(right))


def test_gain_is_half_the_drop_in_gini(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, 0)], "x int, y int")
    r = best_splits(df, ["x"], "y").first()

    def gini(*classes):
        n = sum(classes)
        return n * (1 - sum((c / n) ** 2 for c in classes))

    assert r.threshold == 2.5 and 2 * r.gain == pytest.approx(gini(3, 2) - gini(2, 0) - gini(1, 2))


def test_splits_of_nothing(spark):
    assert best_splits(spark.createDataFrame([], "x int, y int"), ["x"], "y").count() == 0


def test_stump_of_churn(spark):
    rows = [(i, i % 10, float(i), int(i % 10 > 6), i % 4 == 0) for i in range(200)]
    split = stage(spark.createDataFrame(rows, "customer_id int, a int, b double, is_churned int, is_test boolean"))
    stump = churn.fit_stump(split, ("a", "b"))
    assert (stump.feature, stump.threshold, stump.left, stump.right) == ("a", 6.5, 0.0, 1.0)
    assert churn.churn_metrics(split, stump).first().accuracy == 1.0
    first = churn.churn_importance(split, stump).first()
    assert first.feature == "a" and 0.9 < first.importance < 1
    one = churn.fit_stump(stage(split.withColumns({"a": F.lit(1), "b": F.lit(1.0)})), ("a", "b"))
    assert one.feature is None and one.left == pytest.approx(split.filter("not is_test").agg(F.avg("is_churned")).first()[0])
    assert churn.churn_scores(split, one).count() == 200


def test_stump_of_days(frame):
    days = frame("date string, revenue double", *[(f"2024-01-{d:02}" if d < 32 else f"2024-02-{d - 31:02}", 100.0 if d % 7 == 0 else 10.0) for d in range(1, 60)])
    tx = days.selectExpr("cast(date as timestamp_ntz) order_purchase_timestamp", "revenue order_total", "date order_id")
    model = forecast.fit_forecast(tx, stump=True)
    assert model.trees.feature == "day_of_week" or model.trees.feature == "revenue_lag_7"
    assert forecast.forecast_metrics(model).first().r2 > 0.5
    assert forecast.sales_forecast(model).count() == 30


def plain_lloyd(x, centres, rounds):
    for _ in range(rounds):
        near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[near == j].mean(0) if (near == j).any() else c for j, c in enumerate(centres)])
    return centres, ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum()


@pytest.mark.parametrize("partials", [0, 64])
def test_fits_that_share_passes_equal_fits_alone(spark, monkeypatch, partials):
    monkeypatch.setattr(kmeans, "PARTIALS", partials)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 1, (150, 3)) for m in (0, 4, 9)])
    df = stage(spark.createDataFrame(x.tolist(), "a double, b double, c double").repartition(5))
    starts = [x[rng.choice(len(x), k, replace=False)] for k in (1, 2, 3, 3, 6)] + [np.array([[0.0, 0, 0], [99, 99, 99]])]
    fits, costs = lloyd(df, ["a", "b", "c"], starts, 7)
    for start, fit, cost in zip(starts, fits, costs):
        centres, want = plain_lloyd(x, start, 7)
        assert np.allclose(fit, centres) and cost == pytest.approx(want)
    settled, _ = lloyd(df, ["a", "b", "c"], starts, 200, 1e-9)
    for start, fit in zip(starts, settled):
        assert np.allclose(fit, plain_lloyd(x, start, 100)[0])
    near = df.withColumn("near", nearest(["a", "b", "c"], fits[2])).collect()
    assert all(r.near == ((fits[2] - np.array(r[:3])) ** 2).sum(1).argmin() for r in near)


def test_starting_centres_are_nested_and_spread():
    x = np.array([[0.0], [0.1], [100.0], [200.0]])
    drawn = seeded(x, 4, 1)
    assert (seeded(x, 2, 1) == drawn[:2]).all() and len({round(float(v), -1) for v in drawn[:3, 0]}) == 3
    assert len(seeded(np.zeros((3, 2)), 5, 1)) == 5


def test_fits_of_nothing(spark):
    fits, costs = lloyd(spark.createDataFrame([], "a double"), ["a"], [np.array([[1.0], [2.0]])], 3)
    assert (fits[0] == [[1.0], [2.0]]).all() and costs[0] == 0
