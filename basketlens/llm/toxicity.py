"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word left out (binary); words are taken without punctuation at
their ends. Only features of at least MET training rows take part: what one or two rows hold says who they are, not
what they are. Words are
hashed to the lower half of 2^DIMENSION_BITS coordinates, pairs to the upper half. FTRL keeps two
numbers per coordinate; the L1 term leaves most weights at exactly zero. Training rows are dealt
into SHARDS files by a hash; in each round every shard continues from the common state over its own
rows, and a coordinate moves by the mean of what the shards that met it have added. What shards add is put together
on the executors, by blocks of coordinates, so the driver gets one state a round however many tasks read the files. The state is
bounded by the number of coordinates, so it can be broadcast; the weights that score are the
non-zero ones. Toxic rows, the rarer class, count POSITIVE_WEIGHT times.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.tables import forget, frugal, keep_where, narrow, prepared, written
from basketlens.llm.words import Words, mix
from basketlens.llm.words import words as all_words

DIMENSION_BITS = 20
SHARDS = 4
# A number for each shard; Spark's hash deals these to different ones of as many partitions.
SEATS = (2, 0, 14, 3)
ROUNDS = 3
# Coordinates of a state that travel in one row.
BLOCK = 1 << 16
# Training rows that must hold a feature.
MET = 5
INTERCEPT = 1 << DIMENSION_BITS
# At most about this many labels are fitted; a hash of the id chooses them.
TRAINING_ROWS = 60_000
# These come from a cross-validation within the rows that are learnt from, at three sizes.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 6.0, 0.1
POSITIVE_WEIGHT, INTERCEPT_WEIGHT = 4.0, 2.0


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def words(texts: pa.Array) -> Iterator[Words]:
    return all_words(texts, bare=True)


def features(part: Words) -> list[np.ndarray]:
    """Distinct coordinates of each text: words, pairs, pairs over a gap."""
    shift, upper = np.uint64(65 - DIMENSION_BITS), 1 << (DIMENSION_BITS - 1)
    h = part.hash
    one = (mix(h + np.uint64(1)) >> shift).astype(np.int64)
    pair = (mix(h[:-1] * np.uint64(3) + mix(h[1:] + np.uint64(2))) >> shift).astype(np.int64) + upper
    skip = (mix(h[:-2] * np.uint64(5) + mix(h[2:] + np.uint64(3))) >> shift).astype(np.int64) + upper
    at = part.bounds()
    out = []
    for t in range(part.texts):
        a, b = at[t], at[t + 1]
        out.append(np.unique(np.concatenate([one[a:b], pair[a : max(a, b - 1)], skip[a : max(a, b - 2)]])))
    return out


@dataclass
class State:
    """FTRL state by coordinate; the last one is the intercept's."""

    z: np.ndarray
    n: np.ndarray

    @staticmethod
    def empty() -> State:
        size = (1 << DIMENSION_BITS) + 1
        return State(np.zeros(size), np.zeros(size))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        # The intercept is not held at zero: with few rows it alone keeps documents from being taken for the rarer class.
        l1 = np.where(np.arange(len(self.z))[at] == INTERCEPT, 0.0, L1) if isinstance(at, slice) else np.where(at == INTERCEPT, 0.0, L1)
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        g = g * np.where(at == INTERCEPT, INTERCEPT_WEIGHT, POSITIVE_WEIGHT) if label else np.full(len(at), g)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _with_intercept(at: np.ndarray) -> np.ndarray:
    return np.append(at, 1 << DIMENSION_BITS)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task that hold each coordinate, up to MET, by block."""
    rows = np.zeros(1 << DIMENSION_BITS, np.int64)
    for batch in batches:
        for part in words(batch.column("text")):
            for at in features(part):
                rows[at] += 1
    if rows.any():
        capped = np.minimum(rows, MET).astype(np.uint8).reshape(-1, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(capped))), pa.array([r.tobytes() for r in capped], pa.binary())], ["block", "rows"])


def _met_by_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _met sorted by block -> whether MET rows of all tasks hold each coordinate of the block, packed as bits."""

    def packed(block: int, rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.packbits(rows >= MET).tobytes()], pa.binary())], ["block", "usual"])

    now, rows = None, np.zeros(BLOCK, np.int64)
    for batch in batches:
        for block, more in zip(batch.column("block").to_pylist(), batch.column("rows")):
            if block != now:
                if now is not None:
                    yield packed(now, rows)
                now, rows = block, np.zeros(BLOCK, np.int64)
            rows += np.frombuffer(more.as_buffer(), np.uint8)
    if now is not None:
        yield packed(now, rows)


def usual_coordinates(shards: DataFrame) -> np.ndarray:
    """The coordinates that MET rows hold; one bit each reaches the driver."""
    rows = shards.select("text").mapInArrow(frugal(_met), "block long, rows binary")
    found = rows.repartition("block").sortWithinPartitions("block").mapInArrow(frugal(_met_by_all), "block long, usual binary").toArrow()
    out = np.zeros(1 << DIMENSION_BITS, bool)
    for block, bits in zip(found.column("block").to_pylist(), found.column("usual")):
        out[block * BLOCK : (block + 1) * BLOCK] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8)).astype(bool)
    return out


def _trained(state):
    """One round over the shards of a task: what each adds to the state, as 32-bit numbers, by block and only where it adds any.

    `state` also marks the coordinates that count.
    """

    def added(shard: int, own: State) -> Iterator[pa.RecordBatch]:
        z, n = ((x - y).astype(np.float32) for x, y in zip((own.z, own.n), state.value[:2]))
        at = np.flatnonzero((z != 0) | (n != 0))
        ends = np.searchsorted(at, np.arange(0, len(z) + BLOCK, BLOCK))
        for block, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            if a < b:
                here = at[a:b]
                columns = ((here - block * BLOCK).astype(np.int32), z[here], n[here])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([shard], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)],
                    ["block", "shard", "at", "z", "n"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: State | None = None
        now = None
        for batch in batches:
            usual = state.value[2]
            shards = batch.column("shard").to_numpy()
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            for part in words(batch.column("text")):
                for t, at in enumerate(features(part)):
                    if shards[part.first + t] != now:
                        if own is not None:
                            yield from added(now, own)
                        now = shards[part.first + t]
                        own = State(*(x.astype(np.float64) for x in state.value[:2]))
                    own.learn(_with_intercept(at[usual[at]]), int(labels[part.first + t]))
        if own is not None:
            yield from added(now, own)

    return run


def _mean_of_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _trained sorted by block -> the mean, at each coordinate of the block, of what the rows that met it add."""

    def mean(block: int, z: np.ndarray, n: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
        seen = np.maximum(seen, 1)
        columns = [pa.array([(x / seen).tobytes()], pa.binary()) for x in (z, n)]
        return pa.RecordBatch.from_arrays([pa.array([block]), *columns], ["block", "z", "n"])

    now, z, n, seen = None, *np.zeros((3, BLOCK))
    for batch in batches:
        for block, *row in zip(batch.column("block").to_pylist(), *(batch.column(c) for c in ("at", "z", "n"))):
            if block != now:
                if now is not None:
                    yield mean(now, z, n, seen)
                now, (z, n, seen) = block, np.zeros((3, BLOCK))
            at, more_z, more_n = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, (np.int32, np.float32, np.float32)))
            z[at] += more_z
            n[at] += more_n
            seen[at] += more_n > 0
    if now is not None:
        yield mean(now, z, n, seen)


def next_state(shards: DataFrame, state: State, usual: np.ndarray) -> State:
    """The state after one round over all shards; what reaches the driver is of its size."""
    shared = shards.sparkSession.sparkContext.broadcast((state.z.astype(np.float32), state.n.astype(np.float32), usual))
    added = shards.mapInArrow(frugal(_trained(shared)), "block long, shard long, at binary, z binary, n binary")
    # Added in the order of the shards, so that the sum is always the same.
    in_order = added.repartition("block").sortWithinPartitions("block", "shard", F.xxhash64("z"))
    means = in_order.mapInArrow(frugal(_mean_of_shards), "block long, z binary, n binary").toArrow()
    z, n = state.z.copy(), state.n.copy()
    for block, *row in zip(means.column("block").to_pylist(), means.column("z"), means.column("n")):
        here = slice(block * BLOCK, min(len(z), (block + 1) * BLOCK))
        for whole, more in zip((z, n), row):
            whole[here] += np.frombuffer(more.as_buffer(), np.float64)[: here.stop - here.start]
    shared.destroy()
    return State(z, n)


def training_ids(labels: DataFrame, rows: int) -> DataFrame:
    """labels (label_id, label) -> those to learn from: not held out, and about `rows` at most, chosen by a hash."""
    known = labels.where("label in (0, 1) and label_id is not null").where(~held_out(F.col("label_id")))
    share = min(1.0, rows / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("label_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))


def fit(texts: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> np.ndarray:
    """texts (doc_id, text), labels (label_id, label) -> weights by coordinate; all zero without any row."""
    spark = texts.sparkSession
    # About `rows` numbers: bounded, so they are sent to the texts.
    chosen = texts.join(F.broadcast(training_ids(labels, rows)), F.col("doc_id") == F.col("label_id"))
    order = F.xxhash64("doc_id")
    shard = F.element_at(F.array(*map(F.lit, SEATS)), F.pmod(F.hash(order), F.lit(SHARDS)) + 1)
    shards = written(
        chosen.select("doc_id", "text", F.col("label").cast("int").alias("label"), shard.cast("long").alias("shard"))
        .repartition(SHARDS, "shard")
        .sortWithinPartitions("shard", order, "text", "label"),
        "toxic",
    )
    state = State.empty()
    usual = usual_coordinates(shards)
    for _ in range(ROUNDS):
        state = next_state(shards, state, usual)
    forget(shards)
    return state.weights(slice(None))


def _scores(shared, texts: pa.Array) -> Iterator[np.ndarray]:
    """Scores of successive runs of texts."""
    at, weight = shared.value
    dense = np.zeros((1 << DIMENSION_BITS) + 1)
    dense[at] = weight
    for part in words(texts):
        total = np.array([dense[f].sum() for f in features(part)]) + dense[-1]
        yield 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def shared_weights(spark, weights: np.ndarray):
    """The non-zero weights on every executor; at most 2^DIMENSION_BITS of them."""
    at = np.flatnonzero(weights)
    return spark.sparkContext.broadcast((at, weights[at]))


def score(df: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, text) -> (doc_id, score); a null text is an empty one."""
    shared = shared_weights(df.sparkSession, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([np.zeros(0), *_scores(shared, batch.column("text"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    return df.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, score double")


def learnt_weights(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> np.ndarray:
    """Fitted on rows of documents that have a label and are not held out."""
    prepared(documents.sparkSession)
    texts = narrow(documents, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    marks = narrow(labels, label_id=id_col, label=label_col).withColumn("label_id", F.col("label_id").cast("long"))
    return fit(texts, marks)


def keep_civil(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """The rows of documents that score below 0.5, as they are; rows with null or empty text by the intercept."""
    shared = shared_weights(documents.sparkSession, learnt_weights(documents, labels, id_col, text_col, label_col))

    def keep(texts: pa.Array) -> np.ndarray:
        return np.concatenate([np.zeros(0), *_scores(shared, texts)]) < 0.5

    return keep_where(documents, text_col, keep)


def toxicity(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of documents.

    Learns from rows of documents that have a label and are not held out. Null texts are
    empty: their score is that of the intercept. Rows that repeat an id are scored one by
    one, and take part in training with each of the id's labels. A null id is never held out
    and has no label. Null labels are ignored; without any label every score is 0.5. Empty
    tables give empty results. Other columns of either table are not looked at.
    """
    weights = learnt_weights(documents, labels, id_col, text_col, label_col)
    texts = narrow(documents, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return score(texts, weights).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
