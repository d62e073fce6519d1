from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from basketlens.llm import filter_audit as a
from compare_oracle import connect, difference

WORD = re.compile("[^\x20\x09-\x0d]+")


def failed(rows):
    """Sets of failed filters of rows (doc_id, text, lang)."""
    smallest = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            fails.add("C")
        if re.search("[#$%&*|]", text):
            fails.add("D")
        if doc_id is not None and doc_id > smallest[text]:
            fails.add("E")
        out.append(fails)
    return out


def plain(rows, labels):
    """The report, every order applied document by document."""
    good = {d for d, quality, _ in labels if quality == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = failed(rows)
    out = []
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        removed = dict.fromkeys("ABCDE", 0)
        report = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                removed[letter] += len(gone)
                all_fails = sum(letter in f for _, f in own)
                report.append(
                    (part, "".join(order), step, len(left), len(gone), all_fails - len(gone), sum(f == {letter} for _, f in own),
                     sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone))
                )
        out += [(*r, removed[r[1][r[2] - 1]]) for r in report]
    return sorted(out)


def run(docs, labels):
    return sorted(tuple(r) for r in a.audit(docs, labels).collect())


def frames(spark, rows, labels):
    return (
        spark.createDataFrame(rows, "doc_id long, text string, lang string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_equals_the_plain_version(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        n = rng.choice((3, 150, 210, 260))
        words = [rng.choice("abcdefghij") + str(rng.randrange(rng.choice((5, 400)))) for _ in range(n)]
        text = " ".join(w.upper() if rng.random() < 0.03 * (i % 3) else w for w in words) + rng.choice(("", "", " %"))
        rows.append((i, text, rng.choice(("en", "de", None, ""))))
    rows += [(1000 - i, rows[i % 40][1], rng.choice(("en", "fr"))) for i in range(200)]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 1000, 2)]
    assert run(*frames(spark, rows, labels)) == plain(rows, labels)


def test_limits_of_the_filters(spark):
    cases = [
        " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(199)), " ".join(f"w{i % 100}" for i in range(200)),
        " ".join(f"w{i % 99}" for i in range(200)), "A" * 3 + "é" * 97, "A" * 3 + "é" * 96, "a|b", "a<b", "", " \x0b", "\x1c\x85 a",
    ]
    rows = [(i, t, "en") for i, t in enumerate(cases)]
    got = {r.doc_id: r.mask for r in a.failures(frames(spark, rows, [])[0]).collect()}
    want = {i: sum(1 << "ABCDE".index(c) for c in f - {"E"}) for i, f in enumerate(failed(rows))}
    assert got == want


def test_gray_walk_equals_counting():
    rng = np.random.default_rng(1)
    for filters in (1, 2, 5, 7):
        counts = rng.integers(0, 50, (1 << filters, 3))
        states = a.gray_states(counts, filters)
        for active in range(1 << filters):
            assert (states[active] == counts[[m for m in range(1 << filters) if not m & active]].sum(0)).all()


def test_too_many_filters_are_refused():
    with pytest.raises(ValueError):
        a.report("ABCDEFGHI")


def test_odd_rows(spark, odd, none, labels):
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    marks = [(6, 1, None), (6, 0, 1), (7, None, None), (None, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(*m, 1, "x") for m in marks], "doc_id long, quality int, toxic int, docs int, `part.x` string")
    assert run(odd, frame) == plain(rows, marks)
    assert run(none, frame) == [] and run(odd, frame.limit(0)) == plain(rows, [])


def test_query_equals_sql(spark):
    from basketlens.llm.queries import LLM_ORACLE, LLM_QUERIES

    path = "/root/testdata/sf0.001"
    name = "op13_filter_audit"
    assert difference(LLM_QUERIES[name](spark, path), connect(path), LLM_ORACLE[name]) == ""
