"""Benchmark decontamination: BM25 index of the test items, searched with every passage.

Passages are windows of two cells of L words, one cell apart, L being the words of the
longest item: whatever an item leaves in a text lies whole in some window. Impacts (BM25
weight of a term in an item) are divided by the item's own score, so a passage that holds an
item scores 1 and one threshold serves all items.

The search is block-max WAND, worked out for many windows at once. Terms that occur in
many items are the non-essential ones, as long as no item reaches the threshold by them alone: a window
can gain at most an item's whole sum over them. For the others each block of items keeps the largest impact of each term; a window goes
on to a block only if the maxima of its terms plus the largest non-essential sum reach
the threshold. Windows that survive are scored exactly, and all items at or over the
threshold are verified: the question and the answer of the item must both reappear in the
window as word shingles. Words are compared without punctuation at their ends, and a part of few words together
with the words next to it, so that one changed word at its end is not the whole part.

The index is broadcast. It is built from at most SHARD_CHARS characters of items; a larger
benchmark is cut into as many shards as it needs, each searched in turn with the statistics of the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.tables import keep_where, narrow, prepared
from basketlens.llm import words as plain
from basketlens.llm.words import joined

K1, B = 1.2, 0.75
BLOCK_ITEMS = 8
THRESHOLD = 0.7
OVERLAP = 0.8
SHINGLE = 5
# A part has at least so many words (if the item has): one lost at its end costs less than 1 - OVERLAP of its shingles.
PART_WORDS = 10
COMMON_SHARE = 0.1
SHARD_CHARS = 16 << 20
SHARD_ITEMS = 4096


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer, what is before it the question.

    An item of one sentence is cut after two thirds of its words.
    """
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]
    if len(sentences) >= 2:
        return " ".join(sentences[:-1]), sentences[-1]
    found = text.split()
    cut = max(1, len(found) * 2 // 3)
    return " ".join(found[:cut]), " ".join(found[cut:])


def word_hashes(text: str) -> np.ndarray:
    return plain.word_hashes(text, bare=True)


def parts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the question and of the answer, each drawn out into the other to PART_WORDS."""
    question, answer = (word_hashes(p) for p in question_and_answer(text))
    every = np.concatenate([question, answer])
    first = min(len(every), max(len(question), PART_WORDS if len(question) else 0))
    last = min(len(every), max(len(answer), PART_WORDS if len(answer) else 0))
    return every[:first], every[len(every) - last :]


def _shingles(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """Length of the shingles and the distinct ones; a short part is one shingle."""
    size = min(SHINGLE, len(hashes))
    return size, np.unique(joined(hashes, size)) if size else np.zeros(0, np.uint64)


class Statistics(NamedTuple):
    """Of distinct texts with words: their number, all words, words of the longest, terms and their document frequencies."""

    n: int
    words: int
    longest: int
    terms: np.ndarray
    df: np.ndarray


def statistics(hashed: list[np.ndarray]) -> Statistics:
    hashed = [h for h in hashed if len(h)]
    sizes = [len(h) for h in hashed]
    terms, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, hashed)]), return_counts=True)
    return Statistics(len(sizes), sum(sizes), max(sizes, default=1), terms, df)


def merged(parts: list[Statistics]) -> Statistics:
    """Of the texts of all parts; no text may be in two."""
    terms, at = np.unique(np.concatenate([p.terms for p in parts]), return_inverse=True)
    df = np.zeros(len(terms), np.int64)
    np.add.at(df, at, np.concatenate([p.df for p in parts]))
    return Statistics(sum(p.n for p in parts), sum(p.words for p in parts), max(p.longest for p in parts), terms, df)


class Index:
    """Postings of the items with impacts, block maxima of the essential terms."""

    def __init__(self, items: list[tuple[int, str]], overall: Statistics | None = None):
        """`overall` are the statistics of all shards' items; without them, of these."""
        # Equal texts are one entry with several ids, so that copies do not make their terms common.
        ids_of: dict[str, list[int]] = {}
        for i, t in items:
            ids_of.setdefault(t, []).append(i)
        hashed = [(sorted(ids), word_hashes(t), t) for t, ids in ids_of.items()]
        hashed = sorted(((i, h, t) for i, h, t in hashed if len(h)), key=lambda x: x[0])
        self.ids = [i for i, _, _ in hashed]
        self.parts = []
        for _, _, text in hashed:
            question, answer = parts_of(text)
            self.parts.append((_shingles(question), _shingles(answer)))
        n = len(hashed)
        own = statistics([h for _, h, _ in hashed])
        overall = overall or own
        self.longest, self.terms = overall.longest, own.terms
        mean = overall.words / max(1, overall.n)
        df = overall.df[np.searchsorted(overall.terms, self.terms)]
        idf = np.log(1 + (overall.n - df + 0.5) / (df + 0.5))
        rows, cols, impacts = [], [], []
        for k, (_, h, _) in enumerate(hashed):
            term, tf = np.unique(h, return_counts=True)
            at = np.searchsorted(self.terms, term)
            weight = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / mean))
            rows.append(at)
            cols.append(np.full(len(at), k))
            impacts.append(weight / weight.sum())
        row, col = np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(cols or [np.zeros(0, int)])
        impact = np.concatenate(impacts or [np.zeros(0)])
        order = np.argsort(row, kind="stable")
        self.col, self.impact = col[order], impact[order]
        self.first = np.searchsorted(row[order], np.arange(len(self.terms) + 1))
        essential = df <= max(2, COMMON_SHARE * overall.n)
        # An item must not reach the threshold by non-essential terms alone: its rarest ones become essential.
        for at, weight in zip(rows, impacts):
            common = weight[~essential[at]].sum()
            if common > THRESHOLD - 0.01:
                for t in np.argsort(df[at], kind="stable"):
                    if common > THRESHOLD / 2 and not essential[at[t]]:
                        essential[at[t]] = True
                        common -= weight[t]
        self.essential = essential
        blocks = -(-n // BLOCK_ITEMS)
        self.maxima = np.zeros((int(essential.sum()), blocks), np.float32)
        self.row_of = np.cumsum(essential) - 1
        keep = essential[row]
        np.maximum.at(self.maxima, (self.row_of[row[keep]], col[keep] // BLOCK_ITEMS), impact[keep])
        common = np.zeros(n)
        np.add.at(common, col[~keep], impact[~keep])
        self.needed = np.full(blocks, np.inf)
        np.minimum.at(self.needed, np.arange(n) // BLOCK_ITEMS, THRESHOLD - common - 1e-6)

    def term_of(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers; -1 for words that no item has."""
        at = np.searchsorted(self.terms, hashes)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == hashes, at, -1) if len(self.terms) else np.full(len(hashes), -1)

    def windows(self, cell: np.ndarray, term: np.ndarray) -> np.ndarray:
        """First cells of the windows that some block's maxima do not rule out."""
        keep = self.essential[term]
        pairs = np.unique(cell[keep] * len(self.terms) + term[keep])
        if not len(pairs):
            return pairs
        at, row = pairs // len(self.terms), self.row_of[pairs % len(self.terms)]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        bound = np.add.reduceat(self.maxima[row], first, axis=0)
        cells = at[first]
        together = bound.copy()
        follows = np.flatnonzero(cells[1:] == cells[:-1] + 1)
        together[follows] += bound[follows + 1]
        # A window may also begin one cell before the first cell that has a term.
        before = np.setdiff1d(np.arange(len(cells)), follows + 1)
        out = [cells[(together >= self.needed).any(axis=1)]]
        out.append(cells[before][(bound[before] >= self.needed).any(axis=1)] - 1)
        return np.unique(np.concatenate(out))

    def matches(self, hashes: np.ndarray) -> list[tuple[int, float, float, float]]:
        """(item, score, question overlap, answer overlap) of a window's verified items."""
        term = np.unique(self.term_of(hashes))
        term = term[term >= 0]
        score = np.zeros(len(self.ids))
        for t in term:
            span = slice(self.first[t], self.first[t + 1])
            score[self.col[span]] += self.impact[span]
        out = []
        runs: dict[int, np.ndarray] = {}
        for k in np.flatnonzero(score >= THRESHOLD):
            overlaps = []
            for size, wanted in self.parts[k]:
                if size not in runs:
                    runs[size] = np.unique(joined(hashes, size)) if size else np.zeros(0, np.uint64)
                shared = len(np.intersect1d(runs[size], wanted, assume_unique=True))
                overlaps.append(shared / len(wanted) if len(wanted) else 1.0)
            if min(overlaps) >= OVERLAP:
                out.extend((i, float(score[k]), *overlaps) for i in self.ids[k])
        return out


def found_in(index: Index, texts: pa.Array) -> Iterator[tuple[int, tuple[int, float, float, float]]]:
    """(position of the text, match) for every verified item, each item once for each text."""
    length = index.longest
    for part in plain.words(texts, bare=True):
        at = part.bounds()
        term = index.term_of(part.hash)
        known = np.flatnonzero(term >= 0)
        # Cells are numbered through the slice, with two unused ones between texts.
        base = np.cumsum(np.r_[2, -(-np.diff(at) // length) + 2])
        text = part.text[known]
        cell = base[text] + (known - at[text]) // length
        best: dict[tuple[int, int], tuple] = {}
        for w in index.windows(cell, term[known]).tolist():
            t = min(int(np.searchsorted(base, w + 1, "right")) - 1, part.texts - 1)
            a = max(at[t], at[t] + (w - base[t]) * length)
            b = min(at[t + 1], at[t] + (w - base[t] + 2) * length)
            for found in index.matches(part.hash[a:b]):
                key = (part.first + t, found[0])
                best[key] = max(best.get(key, found), found)
        yield from ((t, match) for (t, _), match in best.items())


def _searched(shared):
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = [(ids[t], *match) for t, match in found_in(shared.value, batch.column("text"))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def indexes(benchmark: DataFrame, item_id_col: str, item_col: str) -> Iterator[Index]:
    """One index for each shard of the benchmark; at least one."""
    items = narrow(benchmark, item_id=item_id_col, item=item_col).withColumn("item_id", F.col("item_id").cast("long"))
    items = items.where("item_id is not null and item is not null")
    items = items.groupBy("item").agg(F.collect_set("item_id").alias("ids"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("item")), F.lit(0)).alias("chars")).first()
    shards = max(1, -(-size.chars // SHARD_CHARS), -(-size.n // SHARD_ITEMS))

    def own(shard: int) -> list:
        return items.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard).collect()

    # Scores must not depend on the shard: all share the statistics of the whole benchmark.
    overall = merged([statistics([word_hashes(r["item"]) for r in own(k)]) for k in range(shards)]) if shards > 1 else None
    for shard in range(shards):
        yield Index([(i, r["item"]) for r in own(shard) for i in r["ids"]], overall)


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): items found in documents.

    One row for each pair; of several windows the best counts. Rows that repeat an id are
    searched one by one and give one row for each item together (the best). Null and empty
    texts and items, and items without id, match nothing; a null doc_id can be reported like any
    other. Either table may be empty.
    """
    spark = prepared(documents.sparkSession)
    texts = narrow(documents, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = [
        texts.mapInArrow(_searched(spark.sparkContext.broadcast(index)), SCHEMA)
        for index in indexes(benchmark, item_id_col, item_col)
    ]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return (
        out.groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best"))
        .select("doc_id", "item_id", "best.*")
    )


def keep_clean(
    documents: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_col: str = "text",
) -> DataFrame:
    """The rows of documents in which no item was found, as they are; nothing is shuffled."""
    spark = prepared(documents.sparkSession)

    def clean(shared):
        def keep(texts: pa.Array) -> np.ndarray:
            out = np.ones(len(texts), bool)
            out[[t for t, _ in found_in(shared.value, texts)]] = False
            return out

        return keep

    for index in indexes(benchmark, item_id_col, item_col):
        documents = keep_where(documents, text_col, clean(spark.sparkContext.broadcast(index)))
    return documents
