from __future__ import annotations

import random
import re

import pytest

from basketlens.llm import quality as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    n = len(words)
    return (
        n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), lines, len(inside),
        n < 50 or 100 * len(inside) > 50 * n,
    )


def base(df, labels):
    return [tuple(r)[:7] for r in q.quality(df, labels).collect()]


def test_base_columns_equal_the_plain_version(documents, labels):
    short = documents.where("n_chars < 6000")
    want = sorted((r.doc_id, *plain(r.text)) for r in short.collect())
    assert sorted(base(short, labels)) == want


def test_repeated_windows_and_lines(spark, labels):
    rng = random.Random(2)
    rows = [(0, "a a a a"), (1, "a b c a b c"), (2, "x\nx\n\n \nx"), (3, "a b c d a b c e a b c")]
    for i in range(4, 80):
        words = [rng.choice("abcdefghij"[: rng.randint(2, 10)]) for _ in range(rng.randint(0, 120))]
        rows.append((i, "".join(w + rng.choice((" ", "\n", "  ", "\t")) for w in words)))
    got = base(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert sorted(got) == sorted((i, *plain(t)) for i, t in rows)


def test_score_is_the_mean_log_ratio(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in q.quality(docs, marks).collect()}
    # Trusted: a, b and their pair; raw: these and c. One is added to every bucket.
    from math import log

    ratio = lambda t, r: log((t + 1) / (q.BUCKETS + 3)) - log((r + 1) / (q.BUCKETS + 4))
    assert got[1] == pytest.approx(ratio(1, 1)) and got[2] == pytest.approx(ratio(0, 1)) and got[3] == 0


def test_junk_scores_lower_than_trusted_text(documents, labels):
    rows = q.quality(documents, labels).join(labels, "doc_id").where("n_words >= 50").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert good and bad and sum(good) / len(good) > sum(bad) / len(bad)
    assert sum(r.kept for r in rows if r.quality == 1 and not r.base_failed) >= 0.95 * sum(
        not r.base_failed for r in rows if r.quality == 1
    )


def test_odd_rows(odd, none, labels):
    got = {r.doc_id: r for r in q.quality(odd, labels).collect()}
    assert q.quality(odd, labels).count() == odd.count()
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and not got[1].kept and got[1].base_failed
    assert got[4].n_words == 40_000 and got[8].n_words == 1 and got[9].n_words == 6
    assert q.quality(none, labels).collect() == []
    assert q.quality(odd, labels.where("false")).count() == odd.count()


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_junk_is_rejected_and_unseen_good_text_kept_at_any_size(spark, size):
    documents, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    # Of the good ones a part is judged without its labels.
    unseen = labels.where("quality = 1 and doc_id % 7 = 0")
    rows = q.quality(documents, labels.join(unseen, "doc_id", "left_anti")).where("not base_failed")
    junk = [r.kept for r in rows.join(labels.where("quality = 0"), "doc_id").collect()]
    good = [r.kept for r in rows.join(unseen, "doc_id").collect()]
    assert len(junk) > 20 and sum(junk) <= 0.2 * len(junk)
    assert len(good) > 20 and sum(good) >= 0.9 * len(good)


def test_every_trusted_label_counts(spark):
    n = 65_000
    docs = spark.range(2 * n).selectExpr("id AS doc_id", f"IF(id < {n}, 'a b', 'c') AS text")
    marks = spark.range(n).selectExpr("id AS doc_id", "1 AS quality")
    got = {r.text: r.score for r in q.quality(docs, marks).join(docs, "doc_id").groupBy("text").agg({"score": "max"}).toDF("text", "score").collect()}
    from math import log

    ratio = lambda t, r: log((t + 1) / (q.BUCKETS + 3 * n)) - log((r + 1) / (q.BUCKETS + 4 * n))
    assert got["a b"] == pytest.approx(ratio(n, n), abs=1e-12) and got["c"] == pytest.approx(ratio(0, n), abs=1e-12)


def test_the_threshold_is_the_quantile_of_all_held_out_scores(spark, documents, labels):
    import numpy as np

    docs = documents.select(q.F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = q.marked(docs, labels.selectExpr("doc_id AS id", "quality AS label"))
    good = labels.where("quality = 1").select("doc_id").distinct()
    trusted = sorted(r.doc_id for r in known.where("trusted").collect())
    assert trusted == sorted(r.doc_id for r in docs.join(good, "doc_id").collect()) and known.count() == docs.count()
    ratios = q.log_ratios(q.gram_counts(known))[1]
    held = known.where(q.F.col("trusted") & q.held_out("doc_id")).select("doc_id", "text")
    scores = [r.score for r in q.judged(held, ratios).where("not base_failed").collect()]
    assert q.held_out_threshold(held, ratios) == np.quantile(scores, q.QUANTILE)
    assert q.held_out_threshold(held.where("false"), ratios) == q.THRESHOLD


@pytest.mark.parametrize("most", [0, 10**6])
def test_ids_are_marked_exactly(spark, monkeypatch, most):
    monkeypatch.setattr(q, "MOST_WRONG", most)
    docs = spark.range(40_000).selectExpr("IF(id % 1000 = 7, NULL, id DIV 2) AS doc_id", "'x' AS text")
    marks = spark.range(20_000).selectExpr("id", "IF(id % 3 = 0, 1, 0) AS label").union(spark.sql("SELECT CAST(NULL AS BIGINT), 1"))
    got = q.marked(docs, marks).groupBy("trusted").count().collect()
    want = sum(i % 1000 != 7 and i // 2 % 3 == 0 for i in range(40_000))
    assert {r.trusted: r["count"] for r in got} == {True: want, False: 40_000 - want}
