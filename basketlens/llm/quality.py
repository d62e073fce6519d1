"""Quality rules: base rules and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed to BUCKETS. Counts over the trusted documents (all that are labelled so) and over all
documents give two multinomials (one added to every bucket); a document's verdict is the mean over
its n-grams of log(trusted / raw). Its level depends on the buckets and on the corpus, so the threshold is a
low quantile of held-out trusted documents: one in HELD_OUT by a hash of the id, scored without their own counts as trusted.

Texts never leave their scan: a task counts into arrays as long as BUCKETS, whatever it reads, and these are added up block by
block; the log ratios are bounded and sent to all tasks, and so is a filter of the trusted ids, with the few ids that
it lets pass wrongly. Counting and judging are Arrow batches in numpy. With DataFrame functions alone the same counts and sums took more CPU time than the operator may (see README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.tables import forget, frugal, narrow, prepared, written
from basketlens.llm.words import Words, joined, mix, repeated_lines, words
from basketlens.operators.keyfilter import key_words, may_have_partner
from basketlens.operators.ranking import exact_quantiles

BUCKETS = 1 << 20
# Buckets of a block of counts on their way.
BLOCK = 1 << 14
# Kinds of counted rows: trusted documents, held out or not, and all others.
OTHER, HELD, FITTED = range(3)
# Ids wrongly let pass up to which they are sent to all tasks.
MOST_WRONG = 1_000_000
# Verdict: the mean log ratio must reach this quantile of the held-out trusted scores.
QUANTILE = 0.01
HELD_OUT = 5
# Verdict where no trusted document is held out.
THRESHOLD = -0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Signs that n_symbols counts, as bytes.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_JUDGED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, score double"
)


def grams(part: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the words and of the pairs of successive words of each text."""
    h, pairs = part.hash, part.text[1:] == part.text[:-1]
    one = mix(h + np.uint64(1)) % np.uint64(BUCKETS)
    two = (mix(h[:-1] * np.uint64(3) + mix(h[1:] + np.uint64(2))) % np.uint64(BUCKETS))[pairs]
    return np.concatenate([part.text, part.text[1:][pairs]]), np.concatenate([one, two]).astype(np.int64)


def repeated_words(part: Words) -> np.ndarray:
    """Of each text the words in 3-word windows found twice or more in it; windows by a 64-bit hash."""
    runs = joined(part.hash, 3)
    of = part.text[: len(runs)]
    whole = np.flatnonzero(of == part.text[2:]) if len(runs) else np.zeros(0, np.int64)
    order = whole[np.lexsort((runs[whole], of[whole]))]
    same = (runs[order][1:] == runs[order][:-1]) & (of[order][1:] == of[order][:-1])
    again = np.zeros(len(part.text), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = again.copy()
    inside[1:] |= again[:-1]
    inside[2:] |= again[:-2]
    return np.bincount(part.text[inside], minlength=part.texts)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, text) -> blocks of counts of a task: (kind, block, counts)."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        for part in words(batch.column("text"), fold=False):
            text, bucket = grams(part)
            of = kinds[part.first : part.first + part.texts]
            for kind in np.unique(of).tolist():
                if kind not in counts:
                    counts[kind] = np.zeros(BUCKETS, np.int64)
                # In place: a slice has far fewer n-grams than there are buckets.
                np.add.at(counts[kind], bucket if (of == kind).all() else bucket[of[text] == kind], 1)
    for kind, found in counts.items():
        blocks = found.reshape(-1, BLOCK)
        least = [b.astype(np.uint32) if b.max() < 2**32 else b for b in blocks]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(blocks), kind, np.int32)),
                pa.array(np.arange(len(blocks), dtype=np.int32)),
                pa.array([b.tobytes() for b in least], pa.binary()),
            ],
            ["kind", "block", "counts"],
        )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block come together: their sum, one array for each block of the task."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for kind, block, data in zip(*(batch.column(c) for c in ("kind", "block", "counts"))):
            raw = data.as_buffer()
            counts = np.frombuffer(raw, np.uint32 if raw.size == 4 * BLOCK else np.int64)
            key = kind.as_py(), block.as_py()
            sums[key] = sums[key] + counts if key in sums else counts.astype(np.int64)
    for (kind, block), counts in sums.items():
        columns = [pa.array([kind], pa.int32()), pa.array([block], pa.int32()), pa.array([counts.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "block", "counts"])


def gram_counts(docs: DataFrame) -> np.ndarray:
    """(3, BUCKETS): n-grams of all documents (doc_id, text, trusted), of the trusted and of the fitted ones, by bucket."""
    schema = "kind int, block int, counts binary"
    kind = F.when(~F.col("trusted"), OTHER).when(held_out("doc_id"), HELD).otherwise(FITTED)
    parts = docs.select(kind.alias("kind"), "text").mapInArrow(frugal(_counted), schema)
    out = np.zeros((3, BUCKETS), np.int64)
    # 3 * BUCKETS numbers reach the driver, whatever the corpus.
    for row in parts.repartition("kind", "block").mapInArrow(_added, schema).toLocalIterator():
        out[row.kind, row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.counts, np.int64)
    return np.stack([out.sum(axis=0), out[HELD] + out[FITTED], out[FITTED]])


def log_ratios(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By bucket log(trusted / raw), and the same without the held-out trusted documents as trusted."""
    raw, trusted, fitted = (np.log((c + 1) / (c.sum() + BUCKETS)) for c in counts)
    return trusted - raw, fitted - raw


def judged(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """docs (doc_id, text) -> the base counts with base_failed and score."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            for part in words(batch.column("text"), fold=False):
                n = np.bincount(part.text, minlength=part.texts)
                points = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
                signs = np.concatenate([[0], np.cumsum(SYMBOLS[part.data])])
                text, bucket = grams(part)
                total = np.bincount(text, shared.value[bucket], part.texts)
                length, symbols = (np.zeros(part.texts, np.int64) for _ in range(2))
                np.add.at(length, part.text, points[part.end] - points[part.start])
                np.add.at(symbols, part.text, signs[part.end] - signs[part.start])
                score = np.divide(total, 2 * n - 1, out=np.zeros(part.texts), where=n > 0)
                found.append((n, length, symbols, repeated_words(part), score))
            n, length, symbols, repeated, score = (np.concatenate(c) for c in zip(*found))
            failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
            columns = [batch.column("doc_id"), n, length, symbols, repeated_lines(batch.column("text")), repeated, failed, score]
            names = [c.split()[0] for c in _JUDGED.replace(",", "").split(" ") if c not in ("long", "boolean", "double")]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    return docs.mapInArrow(run, _JUDGED)


def held_out(id_col: str) -> Column:
    """Trusted documents that the threshold is taken from."""
    return F.pmod(F.xxhash64(id_col), F.lit(HELD_OUT)) == 0


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text) and whether their id has a label of 1 in labels (id, label), as column `trusted`.

    Only ids move: those that pass a filter of the trusted ids (see keyfilter) and are none of them, about one in a
    hundred of the others, are found by a join of ids, and texts meet both by broadcast.
    """
    good = labels.where("label = 1 and id is not null").select(F.col("id").cast("long").alias("doc_id")).distinct()
    words, count = key_words(good, "doc_id", good.count())
    passed = may_have_partner(docs.select("doc_id"), "doc_id", words, count, "trusted").where("trusted").select("doc_id")
    wrong = written(passed.distinct().join(good, "doc_id", "left_anti"), "wrongly-passed")
    few = wrong.count() <= MOST_WRONG
    wrong = wrong.withColumn("wrong", F.lit(True))
    found = may_have_partner(docs, "doc_id", words, count, "trusted").join(F.broadcast(wrong) if few else wrong, "doc_id", "left")
    return found.select("doc_id", "text", (F.col("trusted") & F.col("wrong").isNull()).alias("trusted"))


def held_out_threshold(held: DataFrame, ratios: np.ndarray) -> float:
    """QUANTILE, exact, of the scores of held-out trusted documents that pass the base rules; THRESHOLD without any."""
    scores = written(judged(held, ratios).where("not base_failed").select("score"), "held-out-scores")
    [threshold] = exact_quantiles(scores, "score", [QUANTILE])
    forget(scores)
    return THRESHOLD if threshold is None else threshold


def quality(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float | None = None,
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score).

    One row for every row of documents. Trusted are documents with a label of 1; with none,
    or without labels, all ratios are those of an empty trusted corpus. Without `threshold` it is taken
    from held-out trusted documents. A null or empty text has no words: base_failed, not kept, score 0.
    Rows that repeat an id count and are judged one by one. Null ids are kept as they are and never
    trusted. A very long text is judged as a whole, in memory a small multiple of its size. Other columns are not looked at.
    """
    prepared(documents.sparkSession)
    docs = narrow(documents, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    known = marked(docs, narrow(labels, id=id_col, label=label_col))
    ratios, held_ratios = log_ratios(gram_counts(known))
    if threshold is None:
        threshold = held_out_threshold(known.where(F.col("trusted") & held_out("doc_id")).select("doc_id", "text"), held_ratios)
    return judged(docs, ratios).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), "score",
    )
