from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from basketlens.llm import lexical_search as s
from compare_oracle import connect, difference

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top=10):
    """(item_id, rank, doc_id, score) of lists of (id, text), every document scored for every item."""
    held = [(i, Counter(t), len(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    count, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        asked = Counter(terms(text))
        weight = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) for t in asked}
        found = []
        for doc_id, c, n in held:
            m = 100 - 75 + 75 * n * count // length
            score = sum(q * weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:top], 1)]
    return out


def run(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string") if isinstance(docs, list) else docs
    items = spark.createDataFrame(items, "item_id long, text string") if isinstance(items, list) else items
    return [tuple(r) for r in s.ranked(docs, items).collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def made(seed, docs, items, vocabulary):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]

    def text(most):
        return " ".join(names[int(rng.paretovariate(0.6)) % vocabulary].title() for _ in range(rng.randint(0, most)))

    return [(i, text(200)) for i in range(docs)], [(100 + i, text(15)) for i in range(items)]


@pytest.mark.parametrize("seed,vocabulary", [(1, 40), (2, 3000)])
def test_equals_scoring_everything(spark, seed, vocabulary):
    docs, items = made(seed, 700, 30, vocabulary)
    # Copies tie; they go by ascending doc_id.
    docs += [(1000 + i, docs[i % 5][1]) for i in range(60)]
    assert order(run(spark, docs, items)) == order(plain(docs, items))


def test_shards_do_not_change_results(spark, monkeypatch):
    docs, items = made(3, 300, 25, 200)
    monkeypatch.setattr(s, "SHARD_ITEMS", 6)
    assert order(run(spark, docs, items)) == order(plain(docs, items))


def test_narrow_sketches_and_small_chunks_do_not_change_results(spark, monkeypatch):
    docs, items = made(4, 300, 10, 500)
    index = s.build_index(spark.createDataFrame(docs, "doc_id long, text string")).toArrow().combine_chunks().to_batches()[0]
    queries = s.Queries.of([i for i, _ in items], [t for _, t in items])
    found = np.array([sum(w in {h for h in s._of(index.column(3), np.uint64)[0][a:b]} for a, b in _rows(index)) for w in queries.vocabulary])
    n = index.column(1).to_numpy()
    queries.weigh(found, int((n > 0).sum()), int(n.sum()))
    batch = s.Batch(index, queries, {})
    doc, item = np.divmod(np.arange(len(docs) * len(items)), len(items))
    exact = batch.scores(doc, item).reshape(len(docs), len(items))
    bounds = batch.bounds()
    assert (bounds >= exact).all() and bounds.sum() < 3 * exact.sum()
    monkeypatch.setattr(s, "FIRST_CANDIDATES", 1)
    best = s.Best(len(items))
    batch.search(best)
    assert (best.score == -np.sort(-exact, 0)[: s.TOP].T).all()


def _rows(index):
    at = s._of(index.column(3), np.uint64)[1]
    return list(zip(at, at[1:]))


def test_few_documents_are_rescored(spark):
    docs, items = made(5, 2000, 5, 5000)
    calls = []
    queries = s.Queries.of([i for i, _ in items], [t for _, t in items])
    index = s.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    s.count_documents(index, queries)
    best, matrices = s.Best(len(items)), {}
    for batch in index.where("n > 0").toArrow().combine_chunks().to_batches(max_chunksize=500):
        rows = s.Batch(batch, queries, matrices)
        exact = rows.scores
        rows.scores = lambda d, i, exact=exact: calls.append(len(d)) or exact(d, i)
        rows.search(best)
    assert sum(calls) < 0.5 * len(docs) * len(items)


def test_odd_rows(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, None), (2, ""), (3, "!!"), (4, "alpha7 one TWO two"), (4, "x"), (None, "words END \U0001f600"), (6, "unheard")]
    frame = spark.createDataFrame([(i, t, 0.0, 1, "z") for i, t in items], "item_id long, text string, score double, rank int, `a.b` string")
    key = lambda r: (r[0] is None, r[0] or 0, -r[3], r[2] is None, r[2] or 0, r[1])
    assert sorted(run(spark, odd, frame), key=key) == sorted(plain(docs, items), key=key)
    assert run(spark, none, frame) == [] and run(spark, odd, frame.limit(0)) == []


def test_many_occurrences_and_wide_texts(spark):
    rng = random.Random(6)
    wide = " ".join(f"t{rng.randrange(30_000)}" for _ in range(40_000))
    docs = [(i, "again " * (100 * i)) for i in range(8)] + [(20, wide), (21, wide + " again"), (22, "t5 again")]
    items = [(1, "again"), (2, "t5 t6 t7 again again"), (3, wide[:500])]
    assert order(run(spark, docs, items)) == order(plain(docs, items))


def test_terms_of_the_index(spark):
    texts = ["Ab-cd é_É 12a", None, "", "\x00\x7f", "ÀB ab AB"]
    index = s.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = {r.doc_id: r for r in index.collect()}
    for i, text in enumerate(texts):
        want = Counter(terms(text))
        assert rows[i].n == sum(want.values()) and len(rows[i].terms) == 8 * len(want)
        tf = np.frombuffer(rows[i].occurrences, np.uint32)
        assert sorted(tf) == sorted(want.values())
        assert len(rows[i].sketch) == s.NARROWEST and sum(1 for b in rows[i].sketch if b) <= len(want)


def test_query_equals_sql(spark):
    from basketlens.llm.queries import LLM_ORACLE, LLM_QUERIES

    path = "/root/testdata/sf0.001"
    name = "op12_lexical_search"
    assert difference(LLM_QUERIES[name](spark, path), connect(path), LLM_ORACLE[name]) == ""
