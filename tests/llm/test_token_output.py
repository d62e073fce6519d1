from __future__ import annotations

import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from basketlens.llm import token_output as t
from basketlens.llm.tables import written
from basketlens.llm.wavelet import CHUNK_BITS, WaveletMatrix


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(t.tokenizer_path())


def plain(tokenizer, rows):
    """Digests of (doc_id, text) in the order given."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def digests(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_equals_the_tokenizer(documents, tokenizer):
    rows = [(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()]
    assert digests(t.token_output(documents.repartition(5))) == plain(tokenizer, rows)


def test_odd_rows(odd, none, tokenizer):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert digests(t.token_output(odd)) == plain(tokenizer, rows)
    assert t.token_output(none).collect() == []


@given(st.text(alphabet="aAé́'s !?\t\n\x0b\x0c\r\x1c \u0085 ﬀ<|endoftext|>ΣσΑ12", max_size=60))
@settings(max_examples=300, deadline=None)
def test_word_by_word_is_the_whole(text):
    encoder = t.Encoder.of(t.tokenizer_path())
    got = np.frombuffer(encoder.encode(text.encode()), encoder.kind).tolist()
    assert got == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_full_cache_and_small_pieces_change_nothing(monkeypatch):
    text = " ".join(f"word{i % 700}x{i % 13}" for i in range(5000))
    whole = t.Encoder(t.tokenizer_path()).encode(text.encode())
    monkeypatch.setattr(t, "CACHED_WORDS", 100)
    monkeypatch.setattr(t, "PIECE_BYTES", 333)
    assert t.Encoder(t.tokenizer_path()).encode(text.encode()) == whole


def test_more_new_words_than_fit_leave_the_first_of_them_known(monkeypatch):
    monkeypatch.setattr(t, "CACHED_WORDS", 100)
    encoder = t.Encoder(t.tokenizer_path())
    text = " ".join(f"word{i}" for i in range(1000))
    whole = encoder.encode(text.encode())
    assert len(encoder.known) == 100 and "word0" in encoder.known
    assert encoder.encode(text.encode()) == whole and len(encoder.known) == 100
    assert np.frombuffer(whole, encoder.kind).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (1, 70000), (1000, 3), (CHUNK_BITS + 77, 49408), (5000, 1 << 20)])
def test_wavelet_matrix_round_trip_access_count_and_occurrence(n, top):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % top).astype(np.uint32)
    data = WaveletMatrix.build(ids).to_bytes()
    matrix = WaveletMatrix.from_bytes(data)
    assert matrix.tokens().tolist() == ids.tolist()
    for i in rng.integers(0, n, 30) if n else []:
        assert matrix.access(int(i)) == ids[i]
        token = int(ids[i])
        places = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(places)
        assert matrix.count(token, int(i)) == (places < i).sum()
        k = int(rng.integers(0, len(places)))
        assert matrix.occurrence(token, k) == places[k]
    assert matrix.count(top + 5) == 0
    with pytest.raises(IndexError):
        matrix.access(n)
    with pytest.raises(IndexError):
        matrix.occurrence(0, n)


def test_file_order_is_the_order_of_the_rows_written(spark, tokenizer):
    rows = [((i * 37) % 101, f"text number {i}") for i in range(101)]
    df = written(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "order")
    assert digests(t.token_output_in_file_order(df)) == plain(tokenizer, rows)


def test_words_leave_arrow_without_a_scalar_each():
    words = pa.array([f"w{i}é" for i in range(300_000)], pa.large_string())
    for some in (words, words.slice(5, 7), words[:0]):
        assert t.listed(some) == some.to_pylist()
    began = time.process_time()
    t.listed(words)
    direct = time.process_time() - began
    began = time.process_time()
    words.to_pylist()
    assert 2 * direct < time.process_time() - began
