from __future__ import annotations

from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from basketlens.llm import mixing
from basketlens.llm.tables import written


def brute_slots(blocks, weights):
    """Slots of every source's blocks: earliest deadline first, slot by slot, phase by phase."""
    out = {}
    for phase in mixing.phases_of(blocks, weights):
        frame, share = phase["frame"], phase["share"]
        done, slot = Counter(), 0
        need = {u: -(-n // share[u]) * share[u] for u, n in phase["taken"].items()}
        frames = max(need[u] // share[u] for u in need)
        while slot < frames * frame:
            ready = [
                (-(-(done[u] + 1) * frame // share[u]), u) for u in share if done[u] * frame // share[u] <= slot
            ]
            if ready:
                _, u = min(ready)
                if done[u] < phase["taken"][u]:
                    out[u, phase["first"][u] + done[u]] = phase["slot"] + slot
                done[u] += 1
            slot += 1
    return out


@pytest.fixture
def sources(spark):
    rows = [(k, s) for s, n in (("a", 700), ("b", 300), ("c", 40), (None, 90)) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string")


def test_slots_are_those_of_plain_edf(sources, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    monkeypatch.setattr(mixing, "FRAME", 50)
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, None: 0.05}
    got = mixing.schedule(sources, weights).collect()
    assert Counter(r.source for r in got) == {"a": 700, "b": 300, "c": 40, None: 90}
    number = {None: 0, "a": 1, "b": 2, "c": 3}
    want = brute_slots({0: 23, 1: 175, 2: 75, 3: 10}, {number[s]: w for s, w in weights.items()})
    assert {(number[r.source], r.block): r.slot for r in got} == want
    assert all(r.release <= r.slot < r.deadline and r.rank == r.doc_id and r.block == r.rank // 4 for r in got)


def test_deviation_is_less_than_a_block_while_all_last(sources, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 2)
    weights = {"a": 4, "b": 2, "c": 1, None: 1}
    got = mixing.schedule(sources, weights).where("phase = 0").select("source", "block", "slot").distinct().collect()
    by_slot = {r.slot: r.source for r in got}
    end = min(max(r.slot for r in got if r.source == s) for s in weights)
    had = defaultdict(int)
    for slot in range(end + 1):
        had[by_slot[slot]] += 1
        for source, weight in weights.items():
            assert abs(had[source] - Fraction(weight, 8) * (slot + 1)) < 1


def test_sources_without_weight_follow(sources):
    got = mixing.schedule(sources, {"c": 1, "missing": 5}).collect()
    assert len(got) == 1130
    assert max(r.slot for r in got if r.source == "c") < min(r.slot for r in got if r.source != "c")


def test_odd_rows(odd, none):
    got = mixing.schedule(odd).collect()
    assert len(got) == odd.select("source", "doc_id").distinct().count()
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert mixing.schedule(none).collect() == []
    kept = mixing.mixed(odd)
    assert kept.columns == odd.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, odd.collect()))
    assert mixing.mixed(none).collect() == []


def test_files_hold_the_rows_in_mixed_order(sources, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)
    want = [(r.source, r.doc_id) for r in mixing.schedule(sources).orderBy("slot", "rank").collect()]
    out = written(mixing.mixed(sources), "mixed")
    at = out.metadataColumn("_metadata")
    got = out.select("source", "doc_id", at["file_name"].alias("f"), at["row_index"].alias("i")).collect()
    assert [(r.source, r.doc_id) for r in sorted(got, key=lambda r: (r.f, r.i))] == want


def test_shares_fill_the_frame():
    assert mixing.shares({0: 1.0, 1: 1.0, 2: 1.0}, 100) == {0: 34, 1: 33, 2: 33}
    assert sum(mixing.shares({k: 10.0**-k for k in range(9)}, 100).values()) == 100
    assert min(mixing.shares({k: 10.0**-k for k in range(9)}, 100).values()) == 1


def test_too_many_sources_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    df = spark.createDataFrame([(i, str(i)) for i in range(5)], "doc_id long, source string")
    with pytest.raises(ValueError, match="sources"):
        mixing.schedule(df)


def test_any_number_of_sources_is_scheduled(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 2)
    rows = [(k, f"s{i:03d}") for i in range(300) for k in range(1 + i % 37)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.schedule(df).collect()
    assert sorted((r.doc_id, r.source) for r in got) == sorted(rows)
    assert all(r.release <= r.slot < r.deadline and r.block == r.doc_id // 2 for r in got)
    sizes = Counter(s for _, s in rows)
    number = {s: i for i, s in enumerate(sorted(sizes))}
    want = brute_slots({number[s]: -(-n // 2) for s, n in sizes.items()}, {number[s]: n**0.5 for s, n in sizes.items()})
    assert {(number[r.source], r.block): r.slot for r in got} == want
    assert len(mixing.mixed(df).collect()) == len(rows)
