from __future__ import annotations

import random

import pytest

from basketlens.llm import decontamination as d


def normal(text):
    return " " + b" ".join((text or "").encode().lower().split()).decode(errors="replace") + " "


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


def test_every_item_held_verbatim_is_found_and_scores_one(documents, benchmark):
    items = {r.item_id: normal(r.text) for r in benchmark.collect()}
    want = {(r.doc_id, i) for r in documents.collect() for i, t in items.items() if t in normal(r.text)}
    got = {(r.doc_id, r.item_id): r for r in d.contaminated(documents, benchmark).collect()}
    assert want and want <= set(got)
    assert all(got[k].score == pytest.approx(1) for k in want)
    assert all(r.question_overlap >= d.OVERLAP and r.answer_overlap >= d.OVERLAP for r in got.values())


def brute(rows, items):
    """Every window of every text against every item, without index, bounds or blocks."""
    index = d.Index(items)
    out = {}
    for doc_id, text in rows:
        h = d.word_hashes(text)
        for cell in range(-1, len(h) // index.longest + 1):
            a, b = max(0, cell * index.longest), (cell + 2) * index.longest
            for item, *rest in index.matches(h[a:b]):
                out[doc_id, item] = max(out.get((doc_id, item), (0,)), tuple(rest))
    return out


def test_bounds_lose_nothing(spark):
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(6000)]
    take = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, f"{take(rng.randint(4, 25))}. {take(rng.randint(2, 12))}.") for i in range(60)]
    rows = []
    for i in range(150):
        item = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 3)):
            item[rng.randrange(len(item))] = rng.choice(words)
        rows.append((i, f"{take(rng.randint(0, 90))} {' '.join(item)} {take(rng.randint(0, 90))}"))
    got = d.contaminated(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    got = {(r.doc_id, r.item_id): tuple(r)[2:] for r in got.collect()}
    want = brute(rows, items)
    assert len(want) > 40 and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_shards_of_the_benchmark_find_the_same_items(documents, benchmark, monkeypatch):
    whole = {(r.doc_id, r.item_id) for r in d.contaminated(documents, benchmark).collect()}
    monkeypatch.setattr(d, "SHARD_ITEMS", 15)
    parts = {(r.doc_id, r.item_id) for r in d.contaminated(documents, benchmark).collect()}
    assert whole <= parts or len(whole - parts) == 0
    kept = {r.doc_id for r in d.keep_clean(documents, benchmark).collect()}
    assert kept == {r.doc_id for r in documents.collect()} - {k for k, _ in parts}


def test_odd_rows(odd, none, spark):
    items = spark.createDataFrame(
        [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, None), (3, ""), (None, "x"),
         (4, "x"), (4, "x")],
        "item_id long, text string",
    )
    got = sorted(((r.doc_id, r.item_id) for r in d.contaminated(odd, items).collect()), key=repr)
    assert got == sorted([(6, 1), (7, 1), (None, 1), (8, 4)], key=repr)
    assert d.contaminated(none, items).collect() == []
    assert d.contaminated(odd, items.where("false")).collect() == []
    kept = d.keep_clean(odd, items)
    assert kept.columns == odd.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, [1, 2, 3, 4, 5, 9, None]))
    assert d.keep_clean(odd, items.where("false")).count() == odd.count()


def test_question_and_answer():
    assert d.question_and_answer("What is it? A thing. Yes.") == ("What is it? A thing.", "Yes.")
    assert d.question_and_answer("a b c d e f") == ("a b c d", "e f")
    assert d.question_and_answer("") == ("", "")


def test_items_found_by_substring_search_are_found(spark):
    """Items that stand in a text with signs or letters stuck to their ends."""
    items = [
        (1, "Ce passage parle des rivières du nord et de leurs longs hivers. Très réère."),
        (2, "Which of the old towers stands nearest to the harbour of the town? Yes."),
        (3, "Qui? La grande maison blanche au bord de la mer appartient au vieux capitaine."),
        (4, "short item."),
    ]
    ends = [("", "&&&"), ("%%%", ""), ("(\u00ab", "\u00bb)."), ("\u201c", "\u201d"), ("", "$$$next"), ("before", "")]
    around = "some other words without any meaning stand here"
    rows = [(k, f"{around} {a}{t}{b} {around}") for k, (a, b) in enumerate(ends) for _, t in items[:3]]
    rows += [(k, f"{around} {a}{items[3][1]}{b} {around}") for k, (a, b) in enumerate(ends[:4])]
    rows += [(99, around)]
    want = {(k, i) for k, text in rows for i, t in items if t in text}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.contaminated(docs, benchmark).collect()}
    assert len(want) == 22 and want == got
    assert [r.doc_id for r in d.keep_clean(docs, benchmark).collect()] == [99]


def test_items_of_common_terms_only_are_found(spark):
    """Copies under several ids, and templates whose every word stands in more than a tenth of the items."""
    rng = random.Random(5)
    copy = "the same passage of a dozen plain words stands under many ids. Every time."
    words = [f"t{i}" for i in range(30)]
    items = [(i, copy) for i in range(4)]
    items += [(10 + i, " ".join(rng.sample(words, 20)) + ".") for i in range(20)]
    rows = [(1, f"before it {copy} after it"), *((i, f"some text {t} more text") for i, t in items[4:]), (99, "some text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {(k, i) for k, text in rows for i, t in items if t in text}
    got = {(r.doc_id, r.item_id): r.score for r in d.contaminated(docs, benchmark).collect()}
    assert len(want) == 24 and want <= set(got) and all(got[k] == pytest.approx(1) for k in want)
    assert [r.doc_id for r in d.keep_clean(docs, benchmark).collect()] == [99]


def test_shards_give_the_same_scores(documents, benchmark, monkeypatch):
    whole = sorted(tuple(r) for r in d.contaminated(documents, benchmark).collect())
    monkeypatch.setattr(d, "SHARD_ITEMS", 15)
    parts = sorted(tuple(r) for r in d.contaminated(documents, benchmark).collect())
    assert whole and [r[:2] for r in whole] == [r[:2] for r in parts]
    assert all(a == pytest.approx(b) for a, b in zip(whole, parts))
    longest = [i.longest for i in d.indexes(benchmark, "item_id", "text")]
    assert len(longest) > 1 and len(set(longest)) == 1
