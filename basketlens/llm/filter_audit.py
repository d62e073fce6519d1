"""Filter interaction audit: what each filter removes in every order, from one count per set of failed filters.

Every document gets a mask of the filters it fails. Documents are counted by part and mask; all else follows from these cells,
at most 2^filters for each part: a Gray-code walk switches one filter at a time on or off, keeps for every cell the number
of active filters it fails, and with it the running survivors, which are stored for each of the 2^filters sets. A step of an order is the
difference of two stored states.

Texts never leave their scan: a text is known by its SHA-256 afterwards. Rows are counted before each shuffle, so a group of
copies, however large, is a few rows.

Null texts count as empty ones, and are identical to each other and to empty ones. A null part is the part ''. Of rows with the same text those
with a larger doc_id than the smallest are copies; rows that repeat the smallest doc_id are not, and neither are rows without a doc_id. Every row counts.
Several labels of a document count as quality or toxic if any of them does. Very long texts are held as their list of words. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.tables import narrow, prepared

MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 3
SIGNS = "[#$%&*|]"
# Letters of the filters, by bit of the mask.
FILTERS = "ABCDE"
COPIES = FILTERS.index("E")
# Orders of more filters than this are too many rows to be of use.
MOST_FILTERS = 8
_CELLS = "array<struct<mask:int,docs:long,good:long,toxic:long>>"
_REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, text (SHA-256) and mask (all filters but the copies) of every document."""
    own = narrow(docs, doc_id="doc_id", part="lang", text="text")
    own = own.select("doc_id", F.coalesce("part", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    counted = own.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("text"), words.alias("words"),
        F.length("text").alias("points"), F.regexp_count("text", F.lit("[A-Z]")).alias("capitals"),
        F.col("text").rlike(SIGNS).alias("signs"),
    )
    counted = counted.select(
        "doc_id", "part", "text", "points", "capitals", "signs", F.size("words").alias("n"),
        F.size(F.array_distinct("words")).alias("distinct"),
    )
    fails = (
        F.col("n") < MIN_WORDS,
        100 * F.col("distinct").cast("long") < MIN_DISTINCT_PERCENT * F.col("n").cast("long"),
        100 * F.col("capitals").cast("long") > MAX_CAPITAL_PERCENT * F.col("points").cast("long"),
        F.col("signs"),
    )
    mask = sum((f.cast("int") * (1 << bit) for bit, f in enumerate(fails)), F.lit(0))
    return counted.select("doc_id", "part", "text", mask.alias("mask"))


def cells(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, docs, good, toxic: documents by part and failed filters, copies included."""
    rows = facts.groupBy("doc_id", "part", "text", "mask").agg(F.count("*").alias("docs"))
    marks = narrow(labels, doc_id="doc_id", quality="quality", toxic="toxic").groupBy("doc_id")
    marks = marks.agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    none = F.lit(0)
    rows = rows.join(marks, "doc_id", "left").withColumns(
        {"good": F.coalesce("good", none), "toxic": F.coalesce("toxic", none)}
    )
    # The rows of a text become one for each part and label: all of them, and those with the smallest id among them.
    kinds = rows.groupBy("text", "part", "mask", "good", "toxic").agg(
        F.sum("docs").alias("docs"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("docs"))).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "docs"))).alias("first"),
    )
    smallest = F.min("first.doc_id").over(Window.partitionBy("text"))
    single = F.when(F.col("first.doc_id") == smallest, F.col("first.docs")).otherwise(F.lit(0))
    single = F.coalesce(single, F.lit(0)) + F.coalesce("nameless", F.lit(0))
    split = kinds.select("part", "mask", "good", "toxic", "docs", single.alias("single"))
    either = F.explode(
        F.array(
            F.struct(F.col("mask").alias("mask"), F.col("single").alias("n")),
            F.struct((F.col("mask") + (1 << COPIES)).alias("mask"), (F.col("docs") - F.col("single")).alias("n")),
        )
    )
    flat = split.select("part", "good", "toxic", either.alias("cell")).where("cell.n > 0")
    n = F.col("cell.n")
    return flat.groupBy("part", F.col("cell.mask").alias("mask")).agg(
        F.sum(n).alias("docs"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic")
    )


def gray_states(counts: np.ndarray, filters: int) -> np.ndarray:
    """Survivors of every set of active filters; counts and result are (2^filters, measures), by mask and by set."""
    masks = np.arange(1 << filters)
    active_failures = np.zeros(1 << filters, np.int64)
    survivors = counts.sum(0)
    states = np.empty_like(counts)
    states[0] = survivors
    active = 0
    for i in range(1, 1 << filters):
        bit = (i & -i).bit_length() - 1
        active ^= 1 << bit
        holds = (masks >> bit & 1).astype(bool)
        if active >> bit & 1:
            survivors = survivors - counts[holds & (active_failures == 0)].sum(0)
            active_failures[holds] += 1
        else:
            active_failures[holds] -= 1
            survivors = survivors + counts[holds & (active_failures == 0)].sum(0)
        states[active] = survivors
    return states


def steps(states: np.ndarray, letters: str) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders of the filters."""
    filters = len(letters)
    full = (1 << filters) - 1
    docs = states[:, 0]
    fails = [docs[0] - docs[1 << b] for b in range(filters)]
    unique = [docs[full ^ 1 << b] - docs[full] for b in range(filters)]
    shapley = [0] * filters
    for b in range(filters):
        for before in range(1 << filters):
            if not before >> b & 1:
                first = before.bit_count()
                orders = math.factorial(first) * math.factorial(filters - 1 - first)
                shapley[b] += orders * int(docs[before] - docs[before | 1 << b])
    out = []
    for order in itertools.permutations(range(filters)):
        before = 0
        for step, b in enumerate(order, 1):
            after = before | 1 << b
            lost = states[before] - states[after]
            out.append(
                ("".join(letters[x] for x in order), step, docs[after], lost[0], fails[b] - lost[0], unique[b], *lost[1:], shapley[b])
            )
            before = after
    return out


def report(letters: str = FILTERS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (part, cells): the rows of _REPORT, part by part."""
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"{len(letters)} filters have too many orders; audit at most {MOST_FILTERS} at a time")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _REPORT.split(", ")]
        types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.zeros((1 << len(letters), 3), np.int64)
                for cell in found:
                    counts[cell["mask"]] = cell["docs"], cell["good"], cell["toxic"]
                rows = steps(gray_states(counts, len(letters)), letters)
                columns = [[part] * len(rows), *map(list, zip(*rows))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for every part, order of the filters and step; see the module for nulls, ties and copies."""
    prepared(docs.sparkSession)
    cell = F.struct("mask", "docs", "good", "toxic")
    parts = cells(failures(docs), labels).groupBy("part").agg(F.collect_list(cell).cast(_CELLS).alias("cells"))
    return parts.mapInArrow(report(), _REPORT)
