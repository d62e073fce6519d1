from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.llm import toxicity as toxic
from basketlens.llm.toxicity import ALPHA, BETA, L1, L2, POSITIVE_WEIGHT, State, fit, keep_civil, toxicity, training_ids


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = i % 6 == 0
        if bad:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(("ugly", "mean", "vile")))
        rows.append((i, " ".join(text)))
        if i % 10:
            labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), {i: i % 6 == 0 for i in range(900)}


def test_held_out_rows_are_told_apart(marked):
    docs, labels, truth = marked
    got = toxicity(docs, labels).collect()
    assert [r.doc_id for r in got if r.held_out != (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)] == []
    out = [r for r in got if r.held_out]
    bad, good = [r.score for r in out if truth[r.doc_id]], [r.score for r in out if not truth[r.doc_id]]
    assert np.mean([b > g for b in bad for g in good]) > 0.95
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_change_nothing(marked, spark):
    docs, labels, _ = marked
    turned = [(r.doc_id, 1 - r.toxic if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.toxic) for r in labels.collect()]
    a = sorted(toxicity(docs, labels).collect())
    b = sorted(toxicity(docs, spark.createDataFrame(turned, "doc_id long, toxic int")).collect())
    assert a == b


def test_weights_are_sparse_and_the_sample_is_bounded(marked):
    docs, labels, _ = marked
    marks = labels.withColumnsRenamed({"doc_id": "label_id", "toxic": "label"})
    assert 0 < np.count_nonzero(fit(docs, marks)) < 3000
    assert 0 < training_ids(marks, 100).count() < 200 < training_ids(marks, 10_000).count()


def test_odd_rows(odd, none, labels, spark):
    got = toxicity(odd, labels).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (r.doc_id for r in odd.collect())))
    assert all(r.held_out is False for r in got if r.doc_id is None)
    empty = {r.score for r in got if r.doc_id in (1, 2, 3)}
    assert len(empty) == 1
    assert toxicity(none, labels).collect() == []
    nothing = spark.createDataFrame([(6, None), (None, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity(odd, nothing).collect()} == {0.5}


def test_keep_civil_leaves_rows_as_they_are(marked):
    docs, labels, truth = marked
    scores = {r.doc_id: r.score for r in toxicity(docs, labels).collect()}
    kept = keep_civil(docs, labels)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, s in scores.items() if s < 0.5)


@pytest.mark.parametrize("size, recall, false", [("sf0.1", 0.7, 0.02), ("sf0.01", 0.5, 0.05), ("sf0.001", 0.0, 0.2)])
def test_held_out_labels_of_the_tables(spark, size, recall, false):
    documents, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity(documents, labels).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    bad, good = ([r.predicted for r in rows if r.toxic == k] for k in (1, 0))
    assert sum(bad) >= recall * len(bad) and sum(good) <= false * len(good)


def test_learning_equals_plain_ftrl():
    rng = random.Random(1)
    rows = [(sorted(rng.sample(range(40), rng.randint(1, 12))), rng.randint(0, 1)) for _ in range(300)]
    state = State.empty()
    z, n = [0.0] * 40, [0.0] * 40

    def weight(i):
        if abs(z[i]) <= L1:
            return 0.0
        return -(z[i] - (L1 if z[i] > 0 else -L1)) / ((BETA + n[i] ** 0.5) / ALPHA + L2)

    for at, label in rows * 4:
        state.learn(np.array(at), label)
        w = {i: weight(i) for i in at}
        g = (1 / (1 + np.exp(-sum(w.values()))) - label) * (POSITIVE_WEIGHT if label else 1)
        for i in at:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / ALPHA * w[i]
            n[i] += g * g
    assert np.allclose(state.z[:40], z) and np.allclose(state.n[:40], n)
    assert np.allclose(state.weights(np.arange(40)), [weight(i) for i in range(40)])


def test_the_driver_gets_one_state_however_many_tasks_read_the_rows(marked, spark):
    docs, labels, _ = marked
    rows = docs.join(labels, "doc_id").selectExpr("text", "toxic AS label", "doc_id % 40 AS shard")
    whole, sent = type(rows).toArrow, []

    def counted(df):
        sent.append(whole(df))
        return sent[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(rows), "toArrow", counted)
        usual = toxic.usual_coordinates(rows.repartition(40, "shard"))
        many = toxic.next_state(rows.repartition(40, "shard").sortWithinPartitions("shard", "text"), State.empty(), usual)
        few = toxic.next_state(rows.repartition(3, "shard").sortWithinPartitions("shard", "text"), State.empty(), usual)
    coordinates = len(many.z)
    assert [t.num_rows for t in sent] == [16, sent[1].num_rows, sent[1].num_rows] and sent[1].num_rows <= 17
    assert sent[0].nbytes < coordinates and max(t.nbytes for t in sent) < 17.5 * coordinates
    # What a shard adds does not depend on the tasks it shares.
    assert np.allclose(many.z, few.z, atol=1e-5) and np.allclose(many.n, few.n, atol=1e-5) and np.count_nonzero(many.n) > 100


def test_every_shard_is_one_task(spark):
    seats = spark.createDataFrame([(s,) for s in toxic.SEATS], "shard long").repartition(toxic.SHARDS, "shard")
    assert seats.groupBy(F.spark_partition_id()).count().count() == toxic.SHARDS == len(toxic.SEATS)
