"""Ranked lexical search: hashed max-sketches bound every document's score, exact rescoring from the highest bound down.

The index has a row for every document: its number of terms, its different terms (64-bit hashes, ascending) with
their occurrences, and a sketch. A sketch has a power of two of bytes, by the number of different terms; each holds the most
occurrences (up to 255, which stands for that or more) of a term whose hash ends in the byte's number. As the impact of a term
within a document only grows with its occurrences, the sketch is the coordinatewise maximum of the impacts, whatever
the corpus statistics turn out to be: an index serves any number of query sets.

A search reads the index twice: first it counts the documents of every query term, then it bounds and rescores. A batch of
sketches times the matrix of query weights gives an upper bound for every document and item at once. Candidates are rescored exactly, highest
bound first, as long as their bound reaches the item's tenth best score so far in the task; the best of every task are merged.

Items are searched in shards of bounded terms, the only data sent to all tasks. Statistics always cover all documents.

Null and empty texts have no terms: they count in nothing and are never found; neither are items without terms. Equal scores go by ascending
doc_id, null ones last. Repeated rows are documents, or queries, of their own. Very long texts get more sketch bytes up to
WIDEST; then bounds are looser, results the same. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.llm.tables import narrow, prepared, written
from basketlens.llm.words import NO_TERM, words

TOP = 10
NARROWEST, WIDEST = 64, 4096
MANY = 255
# Bounds of what a search sends to every task: items, and characters of their texts.
SHARD_ITEMS = 1000
SHARD_CHARS = 1 << 20
# Candidates of an item that are rescored before its threshold is looked at again; doubles each time.
FIRST_CANDIDATES = 16
# Rows of a task's results that come together in one group of the first merge.
MERGE_GROUPS = 64
_INDEX = "doc_id long, n long, sketch binary, terms binary, occurrences binary"


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte strings data[0:ends[0]], data[ends[0]:ends[1]], ... as an Arrow column."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def different(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, occurrences) of the different terms of every text, ascending."""
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return text[at], hashes[at], np.diff(np.append(at, len(text)))


def widths(terms: np.ndarray) -> np.ndarray:
    """Bytes of a sketch for these numbers of different terms: the next power of two from twice as many on."""
    wanted = np.clip(2 * terms, NARROWEST, WIDEST)
    return 1 << np.ceil(np.log2(wanted)).astype(np.int64)


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in words(batch.column(1), breaks=NO_TERM):
            text, term, tf = different(w.text, w.hash)
            size = np.bincount(text, minlength=w.texts)
            width = widths(size)
            stops = np.cumsum(width)
            place = (stops - width)[text] + (term & (width[text] - 1).astype(np.uint64)).astype(np.int64)
            sketch = np.zeros(int(stops[-1]), np.uint8)
            np.maximum.at(sketch, place, np.minimum(tf, MANY).astype(np.uint8))
            ends = np.cumsum(size)
            columns = [
                batch.column(0).slice(w.first, w.texts),
                pa.array(np.bincount(w.text, minlength=w.texts).astype(np.int64)),
                _binary(sketch, stops),
                _binary(term.view(np.uint8), 8 * ends),
                _binary(tf.astype(np.uint32).view(np.uint8), 4 * ends),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _INDEX.split(", ")])


def build_index(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id, text): a row for every document, written to the shared folder."""
    prepared(docs.sparkSession)
    return written(narrow(docs, doc_id="doc_id", text="text").mapInArrow(_index_rows, _INDEX), "lexical-index")


@dataclass
class Queries:
    """The items of a shard: row r asks for the terms term[first[r]:first[r + 1]], numbers in `vocabulary`, `times` each."""

    item_id: list[int | None]
    vocabulary: np.ndarray
    first: np.ndarray
    term: np.ndarray
    times: np.ndarray
    # Weight of every entry of `vocabulary`, and documents and terms of the corpus; known after the first pass.
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    docs: int = 0
    length: int = 0

    @staticmethod
    def of(item_id: list[int | None], texts: list[str | None]) -> Queries:
        rows, hashes = [], []
        for w in words(pa.array(texts, pa.large_string()), breaks=NO_TERM):
            rows.append(w.text + w.first)
            hashes.append(w.hash)
        nothing = np.zeros(0, np.int64)
        row, term, times = different(np.concatenate([nothing, *rows]), np.concatenate([nothing.view(np.uint64), *hashes]))
        vocabulary, number = np.unique(term, return_inverse=True)
        return Queries(item_id, vocabulary, np.searchsorted(row, np.arange(len(texts) + 1)), number, times)

    def weigh(self, found: np.ndarray, docs: int, length: int) -> None:
        """`found`: documents that hold each term of the vocabulary."""
        self.docs, self.length = docs, length
        self.weight = np.array(
            [math.floor(1000 * math.log((2 * docs + 2) / (2 * int(df) + 1))) for df in found], np.int64
        )

    def damping(self, n: np.ndarray) -> np.ndarray:
        """m of documents with n terms each."""
        return 25 + 75 * n * self.docs // max(self.length, 1)

    def matrix(self, width: int) -> np.ndarray:
        """(width, items): the weights an item looks up at each byte of a sketch."""
        out = np.zeros((width, len(self.item_id)))
        item = np.repeat(np.arange(len(self.item_id)), np.diff(self.first))
        place = (self.vocabulary[self.term] & np.uint64(width - 1)).astype(np.int64)
        np.add.at(out, (place, item), (self.weight[self.term] * self.times).astype(float))
        return out


def _of(values: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of byte strings, and where each row begins."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    numbers = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), kind)
    return numbers, (offsets - offsets[0]) // np.dtype(kind).itemsize


def count_documents(index: DataFrame, queries: Queries) -> None:
    """Set the corpus statistics: documents, all terms, and documents of each query term (as many rows as terms come back)."""
    vocabulary = queries.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(vocabulary) + 2, np.int64)
        for batch in batches:
            n = batch.column(0).to_numpy()
            found[-2] += np.count_nonzero(n)
            found[-1] += n.sum()
            terms, _ = _of(batch.column(1), np.uint64)
            if len(vocabulary):
                at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
                found[:-2] += np.bincount(at[vocabulary[at] == terms], minlength=len(vocabulary))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found[some])], ["term", "docs"])

    rows = index.select("n", "terms").mapInArrow(run, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
    found = np.zeros(len(vocabulary) + 2, np.int64)
    for row in rows.collect():
        found[row.term] = row.docs
    queries.weigh(found[:-2], int(found[-2]), int(found[-1]))


class Best:
    """The TOP documents of every item so far: score, then smallest doc_id."""

    def __init__(self, items: int):
        self.score = np.zeros((items, TOP), np.int64)
        self.doc = np.full((items, TOP), np.iinfo(np.int64).max)

    def threshold(self) -> np.ndarray:
        """A document whose score is below an item's threshold is not among its best; nor is one with score 0."""
        return np.maximum(self.score[:, -1], 1)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        seen = np.unique(item)
        number = np.searchsorted(seen, item)
        rows = np.concatenate([np.repeat(np.arange(len(seen)), TOP), number])
        scores = np.concatenate([self.score[seen].ravel(), score])
        docs = np.concatenate([self.doc[seen].ravel(), doc])
        order = np.lexsort((docs, -scores, rows))
        first = np.searchsorted(rows[order], np.arange(len(seen)))
        keep = order[(first[:, None] + np.arange(TOP)).ravel()]
        self.score[seen] = scores[keep].reshape(-1, TOP)
        self.doc[seen] = docs[keep].reshape(-1, TOP)


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Batch:
    """Rows of the index: bounds from the sketches, exact scores from the terms."""

    def __init__(self, batch: pa.RecordBatch, queries: Queries, matrices: dict[int, np.ndarray]):
        doc_id, n, sketch, terms, occurrences = batch.columns
        self.queries, self.matrices = queries, matrices
        self.doc = doc_id.fill_null(np.iinfo(np.int64).max).to_numpy()
        self.m = queries.damping(n.to_numpy())
        self.sketch, self.sketch_at = _of(sketch, np.uint8)
        self.terms, self.terms_at = _of(terms, np.uint64)
        self.occurrences, _ = _of(occurrences, np.uint32)

    def bounds(self) -> np.ndarray:
        """(documents, items): no score is higher."""
        out = np.zeros((len(self.doc), len(self.queries.item_id)))
        width = np.diff(self.sketch_at)
        for size in np.unique(width):
            size = int(size)
            if size not in self.matrices:
                self.matrices[size] = self.queries.matrix(size)
            rows = np.flatnonzero(width == size)
            block = max(1, (1 << 20) // size)
            for part in (rows[i : i + block] for i in range(0, len(rows), block)):
                tf = self.sketch[self.sketch_at[part][:, None] + np.arange(size)].astype(float)
                most = np.where(tf == MANY, 1e6, 1e9 * tf / (1000 * tf + 8.0 * self.m[part][:, None]))
                out[part] = most @ self.matrices[size]
        return out * (1 + 1e-9)

    def scores(self, doc: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Exact scores of pairs of a row of this batch and an item."""
        queries = self.queries
        used, place = np.unique(doc, return_inverse=True)
        size = np.diff(self.terms_at)[used]
        row = np.repeat(np.arange(len(used)), size)
        entry = np.arange(size.sum()) + np.repeat(self.terms_at[used] - (np.cumsum(size) - size), size)
        at = np.minimum(np.searchsorted(queries.vocabulary, self.terms[entry]), len(queries.vocabulary) - 1)
        known = queries.vocabulary[at] == self.terms[entry]
        # Numbers in the vocabulary ascend as the hashes do, so these keys are sorted.
        keys = row[known] * len(queries.vocabulary) + at[known]
        tf = self.occurrences[entry[known]].astype(np.int64)
        asked = np.diff(queries.first)[item]
        pair = np.repeat(np.arange(len(item)), asked)
        wanted = np.arange(asked.sum()) + np.repeat(queries.first[item] - (np.cumsum(asked) - asked), asked)
        key = place[pair] * len(queries.vocabulary) + queries.term[wanted]
        hit = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        out = np.zeros(len(item), np.int64)
        if len(keys):
            holds = np.flatnonzero(keys[hit] == key)
            number = queries.term[wanted[holds]]
            worth = queries.weight[number] * queries.times[wanted[holds]]
            np.add.at(out, pair[holds], worth * _impact(tf[hit[holds]], self.m[doc[pair[holds]]]))
        return out

    def search(self, best: Best) -> None:
        bounds = self.bounds()
        doc, item = np.nonzero(bounds >= best.threshold())
        order = np.lexsort((-bounds[doc, item], item))
        doc, item = doc[order], item[order]
        bound = bounds[doc, item]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        size, done = FIRST_CANDIDATES, 0
        while len(item):
            now = rank < done + size
            if now.any():
                score = self.scores(doc[now], item[now])
                some = score > 0
                best.add(item[now][some], score[some], self.doc[doc[now][some]])
            done += size
            size *= 2
            left = ~now & (bound >= best.threshold()[item])
            doc, item, bound, rank = doc[left], item[left], bound[left], rank[left]


def search(index: DataFrame, queries: Queries) -> DataFrame:
    """item (row of queries), item_id, rank, doc_id, score of the TOP documents of every item; queries has its weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.item_id))
        matrices: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                Batch(batch, queries, matrices).search(best)
        item, place = np.nonzero(best.score)
        doc = best.doc[item, place]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(item, pa.int64()),
                pa.array([queries.item_id[i] for i in item], pa.int64()),
                pa.array(doc, pa.int64(), mask=doc == np.iinfo(np.int64).max),
                pa.array(best.score[item, place]),
            ],
            ["item", "item_id", "doc_id", "score"],
        )

    found = index.where("n > 0").mapInArrow(run, "item long, item_id long, doc_id long, score long")
    found = found.withColumn("merge", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    # Twice, so that no task gets an item's rows from all tasks of a large job.
    for keys in (("item", "merge"), ("item",)):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        found = found.where(F.col("rank") <= TOP)
    return found.select("item", "item_id", "rank", "doc_id", "score")


def shards(items: DataFrame) -> Iterator[Queries]:
    """The items in shards of about SHARD_ITEMS rows and SHARD_CHARS characters, one held at a time."""
    own = narrow(items, item_id="item_id", text="text")
    size = own.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    count = max(1, math.ceil(size["items"] / SHARD_ITEMS), math.ceil(size.chars / SHARD_CHARS))
    spread = written(own.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(count))), "items")
    for number in range(count):
        rows = spread.where(F.col("shard") == number).select("item_id", "text").collect()
        yield Queries.of([r.item_id for r in rows], [r.text for r in rows])


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP documents of docs (doc_id, text) for every row of items (item_id, text)."""
    index = build_index(docs)
    out: DataFrame | None = None
    for queries in shards(items):
        count_documents(index, queries)
        found = written(search(index, queries).select("item_id", "rank", "doc_id", "score"), "found")
        out = found if out is None else out.union(found)
    return out


def lexical_search(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    prepared(spark)
    return ranked(docs, items)
