from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import Unigram
from tokenizers.pre_tokenizers import Metaspace

from basketlens.llm import token_counts as t


def library(vocabulary):
    out = Tokenizer(Unigram(vocabulary, unk_id=0, byte_fallback=True))
    out.pre_tokenizer = Metaspace(replacement=t.BAR, prepend_scheme="always", split=True)
    return out


@pytest.fixture(scope="module")
def tokenizer():
    return library(t.read_vocabulary(t.vocabulary_path()))


def test_documents_equal_the_library(documents, tokenizer):
    want = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in documents.collect()}
    assert {r.doc_id: r.n_tokens for r in t.token_counts(documents).collect()} == want


@given(st.text(alphabet="theanior  ▁\n\té€日\U0001f600<unk>s0xA", max_size=50))
@settings(max_examples=400, deadline=None)
def test_any_text_equals_the_library(tokenizer, text):
    assert t.Counter.of(t.vocabulary_path()).text(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)


BYTES = [(f"<0x{b:02X}>", -50.0) for b in range(256)]


@given(st.lists(st.text("abc▁", min_size=1, max_size=4), min_size=1, max_size=12, unique=True), st.text("abcd ", max_size=20), st.data())
@settings(max_examples=200, deadline=None)
def test_ties_equal_the_library(pieces, text, data):
    # Few different scores, so that many paths tie.
    scores = data.draw(st.lists(st.sampled_from([-1.0, -2.0, -3.0]), min_size=len(pieces), max_size=len(pieces)))
    vocabulary = [("<unk>", 0.0), *BYTES, *zip(pieces, scores)]
    want = len(library(vocabulary).encode(text, add_special_tokens=False).ids)
    assert t.Counter(vocabulary).text(text) == want


def test_a_full_cache_changes_nothing(monkeypatch):
    text = " ".join(f"word{i}" for i in range(300)) * 3
    whole = t.Counter(t.read_vocabulary(t.vocabulary_path())).text(text)
    monkeypatch.setattr(t, "CACHED_WORDS", 10)
    assert t.Counter(t.read_vocabulary(t.vocabulary_path())).text(text) == whole


def test_odd_rows(odd, none, tokenizer):
    want = sorted(((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect()), key=repr)
    assert sorted((tuple(r) for r in t.token_counts(odd).collect()), key=repr) == want
    assert t.token_counts(none).collect() == []
