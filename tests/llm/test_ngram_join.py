from __future__ import annotations

import random
import re

import numpy as np
import pytest

from basketlens.llm import ngram_join
from basketlens.llm.components import components, merged
from basketlens.llm.ngram_join import Layouts, band_of, band_top, distance_limit, jaccard_components, keep_one, parity


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets)


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_equals_all_pairs(documents, size, percent):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = jaccard_components(documents, shingle=size, percent=percent).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, size, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_chains_of_edits_equal_all_pairs(spark, percent):
    rng = random.Random(percent)
    rows = []
    for group in range(12):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice((4, 9, 14, 25, 60, 150, 400)))]
        for _ in range(15):
            rows.append((len(rows), " ".join(words)))
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = f"w{rng.randint(0, 400)}"
            if rng.random() < 0.3:
                words.append(f"w{rng.randint(0, 400)}")
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 3, percent)


def test_many_copies_and_a_shared_passage(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, "same text of some words again and again") for i in range(600)]
    rows += [(1000 + i, f"{passage} own{i} a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} i{i} j{i}") for i in range(400)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    classes = {r.doc_id: r.component_id for r in got}
    assert {classes[i] for i in range(600)} == {0}
    assert all(classes[1000 + i] == 1000 + i for i in range(400))


@pytest.mark.parametrize("percent, shared", [(80, 60), (80, 110), (90, 150)])
def test_a_passage_in_thousands_of_texts_ties_none_of_them(spark, percent, shared):
    """5,000 texts that share a passage, just below the threshold with the longest ones, and a few near copies among them."""
    rng = random.Random(shared)
    passage = [f"p{i}" for i in range(shared)]
    rows = []
    for i in range(5000):
        own = [f"x{rng.randrange(10**9)}" for _ in range(30)]
        rows.append((i, " ".join(passage + own)))
    near = [(10_000 + i, rows[i * 7][1] + f" more{i}") for i in range(40)]
    df = spark.createDataFrame(rows + near, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in jaccard_components(df, percent=percent).collect()}
    assert {i: c for i, c in got.items() if i < 10_000} == {i: i for i in range(5000)}
    assert all(got[10_000 + i] == i * 7 for i in range(40))


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(3000):
        words = list(base)
        words[rng.randrange(120)] = f"y{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}
    assert set(got.values()) == {0}


def test_odd_rows(odd, none):
    got = sorted((tuple(r) for r in jaccard_components(odd).collect()), key=repr)
    n = 40_000 - 2
    long_sets = {r[0]: r for r in got if r[1] > 30_000}
    assert set(long_sets) == {4, 5} and {r[2] for r in long_sets.values()} == {4} and long_sets[4][1] <= n
    rest = [r for r in got if r[1] <= 30_000]
    assert rest == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 0, 3), (6, 10, 6), (6, 10, 6), (6, 11, 6), (7, 10, 6), (None, 10, 6), (None, 0, None),
         (8, 1, 8), (9, 4, 9)], key=repr,
    )
    assert jaccard_components(none).collect() == []


def test_keep_one_keeps_the_columns_and_the_smallest_id(odd):
    kept = keep_one(odd, shingle=3, percent=90)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 2, 3, 4, 6, 6, 6, 8, 9]


def test_sketch_distance_is_a_lower_bound_and_chunks_meet():
    rng = np.random.default_rng(1)
    layouts = Layouts(90)
    for n in (9, 20, 57, 180, 900):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        most = distance_limit(2 * len(a), 90)
        b = np.unique(np.r_[a[most // 2 :], rng.integers(0, 2**64, most // 2, dtype=np.uint64)])
        difference = len(np.setxor1d(a, b))
        assert np.bitwise_count(parity(a, 16) ^ parity(b, 16)).sum() <= difference
        assert 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))
        shared = set(layouts.bands(len(a))) & set(layouts.bands(len(b)))
        assert any(set(layouts.keys(a, k)) & set(layouts.keys(b, k)) for k in shared)
    assert all(band_of(band_top(b)) <= b < band_of(band_top(b) + 1) for b in range(3, 25))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (400, 450)], "a long, b long")
    found = components(edges)
    got = {r.node: r.component for r in found.collect()}
    assert all(got[i] == 0 for i in range(101)) and got[500] == got[450] == got[400] == 400
    more = spark.createDataFrame([(450, 7), (700, 800), (30, 40), (900, 500)], "a long, b long")
    got = {r.node: r.component for r in merged(found, more).collect()}
    assert all(got[i] == 0 for i in (*range(101), 400, 450, 500, 900)) and got[700] == got[800] == 700


@pytest.fixture
def without_broadcasts(spark):
    """Tables as large as that none is broadcast by its size."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.unset(key)


def test_texts_that_stay_do_not_move(spark, monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i]) for i in range(10)] + [(None, texts[0]), (None, None)]
    docs = spark.createDataFrame(rows, "id long, `a.text` string")
    join, compared = type(docs).join, []

    def counted(self, other, on=None, how=None):
        if how == "left_anti" and "string" in dict(self.dtypes).values():
            compared.append(self.count())
        return join(self, other, on, how)

    monkeypatch.setattr(type(docs), "join", counted)
    kept = keep_one(docs, id_col="id", text_col="a.text")
    assert kept.columns == ["id", "a.text"]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([*rows[:400], *rows[410:]], key=repr)
    assert len(compared) == 1 and compared[0] < 50


def test_sets_move_once_their_places_are_known(without_broadcasts, monkeypatch):
    spark = without_broadcasts
    names = range(40)
    sets = {i: np.arange(i, i + 200, dtype=np.uint64) for i in names}
    mixed = spark.createDataFrame([(7, i, i, i if i % 2 else 0, 0, 20) for i in names], "key long, slot long, node long, label long, main long, others long")
    held = spark.createDataFrame([(i, s.tobytes()) for i, s in sets.items()], "node long, held binary")
    monkeypatch.setattr(ngram_join, "written", lambda df, _: df)
    links = ngram_join.rest_links(mixed, held, 90)
    plan = links._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moves = [step for step in plan.split("\n\n") if re.match(r"\(\d+\) Exchange\n", step) and "held" in step.split("\n")[1]]
    assert len(moves) == 2
    classes = {i: i if i % 2 else 0 for i in names}

    def root(x):
        while classes[x] != x:
            x = classes[x]
        return x

    for a, b in links.collect():
        assert ngram_join.linked(sets[a], sets[b], 90)
        classes[root(b)] = root(a)
    assert len({root(i) for i in names}) == 1
