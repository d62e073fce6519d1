"""run() against plain Python versions of its stages, and each stage's decisions."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as c
from basketlens.llm import decontamination, mixing, toxicity
from basketlens.llm.tables import written
from basketlens.llm.token_output import tokenizer_path
from tests.llm.test_decontamination import brute as brute_leaks
from tests.llm.test_mixing import brute_slots
from tests.llm.test_ngram_join import brute as brute_classes

PATH = "/root/testdata/sf0.001"


def plain_toxic(spark):
    """Ids whose score, by the weights of the fit and features counted one by one, is 0.5 or more."""
    docs, labels = spark.read.parquet(f"{PATH}/documents.parquet"), spark.read.parquet(f"{PATH}/labels.parquet")
    weights = toxicity.learnt_weights(docs, labels, "doc_id", "text", "toxic")
    out = set()
    for r in docs.collect():
        at = set()
        for part in toxicity.words(__import__("pyarrow").array([r.text or ""])):
            at |= set(toxicity.features(part)[0].tolist())
        if weights[sorted(at)].sum() + weights[-1] >= 0:
            out.add(r.doc_id)
    return out


@pytest.fixture(scope="module")
def expected(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()}
    docs = {i: r for i, r in docs.items() if i not in plain_toxic(spark)}
    docs = {i: docs[i] for i, _, first in brute_classes([(i, r.text) for i, r in docs.items()], 5, 80) if i == first}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect()]
    leaks = {i for i, _ in brute_leaks([(i, r.text) for i, r in docs.items()], items)}
    docs = {i: r for i, r in docs.items() if i not in leaks}
    by_source: dict[str, list[int]] = {}
    for i in sorted(docs):
        by_source.setdefault(docs[i].source, []).append(i)
    names = sorted(by_source)
    blocks = {k: -(-len(by_source[s]) // mixing.BLOCK_ROWS) for k, s in enumerate(names)}
    slots = brute_slots(blocks, {k: len(by_source[s]) ** 0.5 for k, s in enumerate(names)})
    order = sorted(
        (slots[k, rank // mixing.BLOCK_ROWS], rank, i) for k, s in enumerate(names) for rank, i in enumerate(by_source[s])
    )
    tokenizer = Tokenizer.from_file(tokenizer_path())
    out, start = [], 0
    for _, _, i in order:
        ids = np.array([*tokenizer.encode(docs[i].text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_run_equals_the_plain_stages(spark, expected):
    got = c.run(spark, PATH).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert 0 < len(expected) < 200
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == expected


def test_stages_but_the_last_keep_the_columns(spark, odd, none):
    for docs in (odd, none):
        docs = written(docs, "docs")
        for name, stage in c.STAGES[:-1]:
            out = written(stage(spark, docs, PATH), name)
            assert out.columns == docs.columns, name
            docs = out
        assert c.STAGES[-1][1](spark, docs, PATH).count() == docs.count()


def test_order_of_the_stages():
    assert [name for name, _ in c.STAGES] == [
        "toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing_sources", "token_output",
    ]
    assert decontamination.OVERLAP == 0.8
