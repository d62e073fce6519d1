import pytest
from pyspark.sql import functions as F

from basketlens.plans import churn, clv, rfm, segments
from basketlens.sources.staging import stage

TX = "customer_id string, order_id string, order_total double, order_purchase_timestamp timestamp_ntz, price double, freight_value double"


@pytest.fixture
def tx(spark):
    def build(*rows):
        data = [(*r, 10.0, 1.0) for r in rows]
        text = TX.replace("timestamp_ntz", "string")
        df = spark.createDataFrame(data, text)
        return df.withColumn("order_purchase_timestamp", F.col("order_purchase_timestamp").try_cast("timestamp_ntz"))

    return build


def test_clv_of_one_day_and_of_elapsed_days(tx):
    got = {
        r.customer_id: r
        for r in clv.clv(
            tx(
                ("a", "o1", 100.0, "2024-01-01 12:00:00"),
                ("b", "o2", 10.0, "2024-01-01 12:00:00"),
                ("b", "o3", 30.0, "2024-01-03 11:00:00"),
                ("b", "o3", 30.0, "2024-01-03 11:00:00"),
                (None, "o4", 5.0, "2024-01-03 11:00:00"),
            )
        ).collect()
    }
    assert set(got) == {"a", "b"}
    assert (got["a"].lifespan_days, got["a"].clv) == (1, 36500.0)
    b = got["b"]
    assert (b.frequency, b.monetary, b.lifespan_days) == (2, 70.0, 2)
    assert b.clv == 35.0 * 1.0 * 365


def test_clv_segments_keep_all_names(tx):
    customers = stage(clv.clv(tx(*[(f"c{i}", f"o{i}", 10.0, "2024-01-01 00:00:00") for i in range(4)])))
    got = {r.clv_segment: r.customer_count for r in clv.clv_segments(customers).collect()}
    # One value: equal-width bins around it put everyone in the second.
    assert got == {"Low": 0, "Medium": 4, "High": 0, "Very High": 0}


def test_rfm_single_customer_uses_the_fallback(tx):
    row = rfm.rfm(tx(("a", "o1", 5.0, "2024-01-01 10:00:00"))).first()
    assert (row.recency, row.R_score, row.F_score, row.M_score, row.RFM_score) == (1, 3, 2, 2, "322")
    assert row.segment == "Loyal Customers"


def test_rfm_without_a_purchase_time_needs_attention(tx):
    rows = [(f"c{i}", f"o{i}", float(i), f"2024-01-0{i + 1} 10:00:00") for i in range(5)]
    got = {r.customer_id: r for r in rfm.rfm(tx(*rows, ("z", "oz", 99.0, "never"))).collect()}
    assert got["z"].R_score is None and got["z"].segment == "Need Attention"


@pytest.mark.parametrize(
    ("scores", "name"),
    [
        ((3, 3, 3), "Champions"),
        ((4, 2, 4), "Loyal Customers"),
        ((4, 3, 2), "Loyal Customers"),
        ((3, 1, 4), "Potential Loyalists"),
        ((2, 3, 3), "At Risk"),
        ((1, 4, 2), "Hibernating"),
        ((None, 4, 4), "Need Attention"),
    ],
)
def test_segment_rules(spark, scores, name):
    df = spark.createDataFrame([scores], "r int, f int, m int")
    assert df.select(rfm.segment(F.col("r"), F.col("f"), F.col("m"))).first()[0] == name


def test_rfm_invariants_hold_under_repartitioning(spark):
    import __spark_entry__ as registry

    base = registry._tx(spark, "/root/testdata/sf0.001")
    one, other = rfm.rfm(base), rfm.rfm(base.repartition(13))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    counts = rfm.rfm_segment_counts(one).collect()
    assert sum(r.customers for r in counts) == one.count()


def test_churn_features(tx):
    got = {
        r.customer_id: r
        for r in churn.churn_features(
            tx(
                ("a", "o1", 10.0, "2024-01-01 00:00:00"),
                ("b", "o2", 10.0, "2024-03-31 00:00:00"),
                ("b", "o3", 30.0, "2024-04-01 00:00:00"),
                ("c", "o4", 1.0, "2024-01-02 00:00:00"),
                ("d", "o5", 1.0, "never"),
            )
        ).collect()
    }
    assert (got["a"].std_order_value, got["a"].recency_days, got["a"].is_churned) == (0.0, 91, 1)
    assert (got["c"].recency_days, got["c"].is_churned) == (90, 0)
    assert (got["b"].customer_age_days, got["b"].avg_days_between_orders) == (2, 1.0)
    assert got["b"].std_order_value == pytest.approx(200**0.5)
    assert (got["d"].recency_days, got["d"].is_churned) == (None, 0)


def test_churn_split_is_stratified_and_stable(spark):
    features = spark.range(103).select(
        F.col("id").alias("customer_id"), (F.col("id") % 4 == 0).cast("int").alias("is_churned")
    )
    one = {r.customer_id: r.is_test for r in churn.churn_split(features).collect()}
    assert one == {r.customer_id: r.is_test for r in churn.churn_split(features.repartition(7)).collect()}
    assert sum(one.values()) == 31  # 30 % of 103, rounded up
    churned_train = sum(1 for i, test in one.items() if i % 4 == 0 and not test)
    assert churned_train in (18, 19)  # 26 * 72 / 103 = 18.2
    assert one != {r.customer_id: r.is_test for r in churn.churn_split(features, seed=1).collect()}


def test_classification_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (0, 1), (0, 0)], "is_churned int, predicted int")
    m = churn.classification_metrics(df).first()
    assert (m.accuracy, m.precision, m.recall, m.f1) == (0.6, 2 / 3, 2 / 3, 2 / 3)
    none = churn.classification_metrics(df.filter("is_churned = 0 and predicted = 0")).first()
    assert (none.accuracy, none.precision, none.recall, none.f1) == (1.0, 0.0, 0.0, 0.0)


def test_single_class_gives_its_constant_probability(tx):
    rows = [(f"c{i}", f"o{i}", float(i), f"2024-01-0{i + 1} 10:00:00") for i in range(8)]
    split = stage(churn.churn_split(stage(churn.churn_features(tx(*rows)))))
    model = churn.fit_churn(split)
    assert model.forest is None
    scores = churn.churn_scores(split, model).collect()
    assert {(r.churn_probability, r.churn_risk) for r in scores} == {(0.0, None)}
    assert churn.churn_metrics(split, model).first().accuracy == 1.0


def test_churn_model_on_test_tables(spark):
    import __spark_entry__ as registry

    split, model = registry._churn(spark, "/root/testdata/sf0.001")
    scores = churn.churn_scores(split, model)
    low, high, n = scores.agg(F.min("churn_probability"), F.max("churn_probability"), F.count("*")).first()
    assert 0 <= low <= high <= 1 and n == split.count()
    importance = churn.churn_importance(split, model).collect()
    assert sum(r.importance for r in importance) == pytest.approx(1)
    assert importance[0].feature == "recency_days"  # the label is made of it
    assert churn.churn_metrics(split, model).first().accuracy > 0.9


def test_cluster_labels(spark):
    data = [(0, 100.0, 10, 5), (1, 1.0, 1, 50), (2, 1.0, 1, 2), (3, 50.0, 5, 3)]
    df = spark.createDataFrame(data, "cluster int, total_spent double, order_count int, recency_days int")
    got = {r.cluster: r.cluster_label for r in segments.label_clusters(df).collect()}
    assert got == {0: "High Value", 1: "Inactive", 2: "New/Low Frequency", 3: "High Value"}
    medium = spark.createDataFrame(
        [(0, 10.0, 5, 1), (1, 20.0, 1, 1), (2, 30.0, 1, 1)], df.schema
    )
    assert {r.cluster: r.cluster_label for r in segments.label_clusters(medium).collect()}[0] == "Medium Value"


def test_scaling_uses_population_deviation_and_survives_constants(spark):
    df = spark.createDataFrame(
        [(1, 2.0, 7.0, 0), (3, 4.0, 7.0, 10)], "order_count int, total_spent double, avg_order_value double, recency_days int"
    )
    got = sorted(tuple(r) for r in segments.segmentation_scaled(df).collect())
    assert got == [(-1.0, -1.0, 0.0, -1.0), (1.0, 1.0, 0.0, 1.0)]


def test_kmeans_on_test_tables(spark):
    import __spark_entry__ as registry

    features = segments.segmentation_features(registry._tx(spark, "/root/testdata/sf0.001"))
    found = segments.kmeans_segments(features, n_init=2)
    assert found.count() == features.count()
    assert found.select("cluster").distinct().count() == 4
    elbow = [r.inertia for r in segments.kmeans_elbow(features, max_k=4, n_init=2).orderBy("k").collect()]
    assert len(elbow) == 3 and elbow == sorted(elbow, reverse=True)
    assert sum(r.customers for r in segments.kmeans_label_counts(found).collect()) == features.count()
