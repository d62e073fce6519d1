from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from basketlens.llm import words as w


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbZé \t\n\x0b\x0c\r\x1c ,", max_size=30)), max_size=12))
@settings(max_examples=150, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    found = [[] for _ in texts]
    for part in w.words(pa.array(texts, pa.string())):
        raw = part.data.tobytes()
        for s, e, t, h in zip(part.start, part.end, part.text, part.hash):
            found[part.first + t].append((raw[s:e].lower(), int(h)))
    for text, got in zip(texts, found):
        assert [g[0] for g in got] == (text or "").encode().lower().split()
        for word, h in got:
            assert h == int(w.word_hashes(word.decode())[0])


def test_slices_and_offsets_do_not_change_hashes():
    texts = ["the quick brown fox " * 4000] * 40
    column = pa.array(["skipped", *texts])[1:]
    hashes = [h for part in w.words(column) for h in part.hash]
    assert len(hashes) == 40 * 16000 and len(set(hashes)) == 4


def test_different_words_have_different_hashes():
    some = [f"{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in range(200)]
    assert len(set(w.word_hashes(" ".join(some)).tolist())) == len(some)
    assert len(set(w.joined(np.arange(9, dtype=np.uint64), 3).tolist())) == 7


def test_memory_of_words_does_not_follow_the_batch():
    column = pa.array([f"word{i} and other{i} words " * 40 for i in range(4000)])
    list(w.words(column[:10], bare=True))
    tracemalloc.start()
    for _ in w.words(column, bare=True):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert column.nbytes > 4 << 20 and peak < 10 << 20
