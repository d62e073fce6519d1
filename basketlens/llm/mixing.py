"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in id order, form blocks of BLOCK_ROWS. Time is a row of slots for
one block each. With weight w the j-th block (from 0) of a source is released at slot
floor(j / w) and due before slot ceil((j + 1) / w); earliest-deadline-first over the released
blocks meets every deadline, so after any number t of slots a source has had between t*w - 1
and t*w + 1 blocks. Weights are whole shares of a frame, so the schedule repeats every frame
and one frame is worked out per phase, with heaps on the driver.

Nothing is repeated or dropped. When a source runs out, its phase ends with the frame, and
the next phase shares the slots among the rest in proportion to their weights.

Rows are only touched by DataFrame and SQL functions. Per-source counts, phases and frames pass through the driver and
come back as tables, whose rows grow with the number of sources times the phases, not with the documents; ranks come from range
partitions and their offsets, so that one huge source is spread out.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketlens.llm.tables import column, narrow, prepared, written

BLOCK_ROWS = 64
FRAME = 1000
# A number here makes more sources an error, for callers who take them for a mistake.
MAX_SOURCES: int | None = None


def shares(weights: Mapping[int, float], frame: int) -> dict[int, int]:
    """Whole shares of the frame, at least one each, by largest remainder; ties to the smaller key."""
    total = sum(weights.values())
    exact = {k: w * frame / total for k, w in weights.items()}
    out = {k: max(1, int(x)) for k, x in exact.items()}
    by_rest = sorted(weights, key=lambda k: (int(exact[k]) - exact[k], k))
    spare = frame - sum(out.values())
    while spare > 0:
        for k in by_rest[: min(spare, len(by_rest))]:
            out[k] += 1
        spare = frame - sum(out.values())
    largest = [(-n, k) for k, n in out.items()] if spare < 0 else []
    heapq.heapify(largest)
    while spare < 0:
        n, k = largest[0]
        out[k] -= 1
        heapq.heapreplace(largest, (n + 1, k))
        spare += 1
    return out


def phases_of(blocks: Mapping[int, int], weights: Mapping[int, float]) -> list[dict]:
    """Phases until every source has run out: shares, frames, first slot, and blocks by source."""
    left = {k: n for k, n in blocks.items() if n > 0}
    used = dict.fromkeys(left, 0)
    frame = max(FRAME, 8 * len(left))
    out, slot = [], 0
    while left:
        share = shares({k: weights[k] for k in left}, frame)
        frames = min(-(-n // share[k]) for k, n in left.items())
        taken = {k: min(n, frames * share[k]) for k, n in left.items()}
        out.append({"slot": slot, "frame": frame, "share": share, "first": dict(used), "taken": taken})
        slot += frames * frame
        used = {k: used[k] + taken[k] for k in left}
        left = {k: n - taken[k] for k, n in left.items() if n > taken[k]}
    return out


def _frame_order(share: Mapping[int, int], frame: int) -> list[tuple[int, int, int]]:
    """(unit, turn, slot) of the blocks of a frame: EDF over released blocks, ties to the smaller unit."""
    waiting = [(0, unit, 0) for unit in share]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(frame):
        while waiting and waiting[0][0] <= slot:
            _, unit, turn = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(turn + 1) * frame // share[unit]), unit, turn))
        if ready:
            _, unit, turn = heapq.heappop(ready)
            out.append((unit, turn, slot))
            if turn + 1 < share[unit]:
                heapq.heappush(waiting, ((turn + 1) * frame // share[unit], unit, turn + 1))
    return out


def _table(spark, columns: Mapping[str, tuple[pa.DataType, list]]) -> DataFrame:
    return spark.createDataFrame(pa.table({name: pa.array(values, kind) for name, (kind, values) in columns.items()}))


def frame_slots(spark, phases: list[dict]) -> DataFrame:
    """(phase, unit, turn, at): the slot within a frame that a unit's turn-th block takes."""
    found: dict[str, list[int]] = {"phase": [], "unit": [], "turn": [], "at": []}
    for p, phase in enumerate(phases):
        # Turns that no block of the phase reaches are left out.
        for unit, turn, slot in _frame_order(phase["share"], phase["frame"]):
            if turn < phase["taken"][unit]:
                for name, value in zip(found, (p, unit, turn, slot)):
                    found[name].append(value)
    return _table(spark, {name: (pa.int32(), values) for name, values in found.items()})


def ranked(keys: DataFrame) -> DataFrame:
    """keys (unit, doc_id, copies) -> with `rank`: the number of rows of the unit before this id's."""
    parts = keys.repartitionByRange("unit", "doc_id").withColumn("part", F.spark_partition_id())
    parts = written(parts, "ranks")
    per_part = parts.groupBy("unit", "part").agg(F.sum("copies").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_part.select(F.col("unit").alias("u"), F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.sum("copies").over(
        Window.partitionBy("unit", "part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        parts.withColumn("within", F.coalesce(within, F.lit(0)))
        .join(offsets, (F.col("unit") == F.col("u")) & (F.col("part") == F.col("p")))
        .select("unit", "doc_id", (F.col("within") + F.col("offset")).alias("rank"))
    )


def schedule(
    df: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """(source, doc_id, rank, block, phase, slot, release, deadline), one row for each source and id.

    `weights` gives the target weight of each source; by default it is the square root of the
    source's share of the rows. Sources without a positive weight follow at the end, mixed by
    their sizes. A null source is a source, a null id the first of its source; rows
    that repeat source and id share one place. Texts and other columns are not looked at. An
    empty table gives an empty result. Any number of sources is scheduled, unless MAX_SOURCES is set.
    """
    spark = prepared(df.sparkSession)
    rows = narrow(df, source=source_col, doc_id=id_col).withColumns(
        {"source": F.col("source").cast("string"), "doc_id": F.col("doc_id").cast("long")}
    )
    keys = written(rows.groupBy("source", "doc_id").agg(F.count("*").alias("copies")), "keys")
    counts = keys.groupBy("source").agg(F.sum("copies").alias("rows"))
    counts = (counts if MAX_SOURCES is None else counts.limit(MAX_SOURCES + 1)).collect()
    if MAX_SOURCES is not None and len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; join small ones under one label first")
    counts = sorted(((r.source, r.rows) for r in counts), key=lambda r: (r[0] is not None, r[0] or ""))
    number = {source: i for i, (source, _) in enumerate(counts)}
    blocks = {number[s]: -(-n // BLOCK_ROWS) for s, n in counts}
    if weights is None:
        target = {number[s]: float(n) ** 0.5 for s, n in counts}
    else:
        target = {number[s]: float(w) for s, w in weights.items() if s in number and w > 0}
    phases = phases_of({u: blocks[u] for u in target}, target)
    rest = {number[s]: float(n) for s, n in counts if number[s] not in target}
    late = phases_of({u: blocks[u] for u in rest}, rest)
    if phases and late:
        last = phases[-1]
        end = last["slot"] + max(-(-n // last["share"][u]) for u, n in last["taken"].items()) * last["frame"]
        late = [p | {"slot": p["slot"] + end} for p in late]
    slots = frame_slots(spark, phases)
    if late:
        slots = slots.union(frame_slots(spark, late).withColumn("phase", F.col("phase") + len(phases)))
    spans = [
        (k, u, p["first"][u], n, p["share"][u], p["slot"], p["frame"])
        for k, p in enumerate([*phases, *late])
        for u, n in p["taken"].items()
    ]
    names = ("phase", "unit", "first", "taken", "share", "start", "frame")
    if not spans:
        return spark.createDataFrame(
            [],
            "source string, doc_id long, rank long, block long, phase long, slot long, release long, deadline long",
        )
    table = _table(spark, {name: (pa.int64(), list(values)) for name, values in zip(names, zip(*spans))})
    by_unit = table.groupBy(F.col("unit").alias("of")).agg(F.collect_list(F.struct(*names)).alias("spans"))
    units = _table(spark, {"name": (pa.string(), list(number)), "unit": (pa.int32(), list(number.values()))})
    known = ranked(keys.join(F.broadcast(units), F.col("source").eqNullSafe(F.col("name"))).select("unit", "doc_id", "copies"))
    known = known.withColumn("block", F.floor(F.col("rank") / BLOCK_ROWS))
    # The spans and slots of all phases are bounded by the number of sources and the frame.
    placed = (
        known.join(F.broadcast(by_unit), F.col("unit") == F.col("of"))
        .withColumn(
            "span",
            F.get(
                F.filter("spans", lambda s: (F.col("block") >= s["first"]) & (F.col("block") < s["first"] + s["taken"])), F.lit(0)
            ),
        )
        .withColumn("turn_of_phase", F.col("block") - F.col("span.first"))
        .withColumn("turn", (F.col("turn_of_phase") % F.col("span.share")).cast("int"))
        .withColumn("frames", F.floor(F.col("turn_of_phase") / F.col("span.share")))
        .select("unit", "doc_id", "rank", "block", "span.phase", "span.share", "span.start", "span.frame", "turn", "frames")
    )
    at = slots.select(
        F.col("phase").cast("long").alias("p"), F.col("unit").alias("u"), F.col("turn").alias("k"), F.col("at")
    )
    base = F.col("start") + F.col("frames") * F.col("frame")
    done = placed.join(
        F.broadcast(at), (F.col("phase") == F.col("p")) & (F.col("unit") == F.col("u")) & (F.col("turn") == F.col("k"))
    )
    return (
        done.join(F.broadcast(units.withColumnRenamed("unit", "number")), F.col("unit") == F.col("number"))
        .select(
            F.col("name").alias("source"),
            "doc_id",
            "rank",
            "block",
            "phase",
            (base + F.col("at")).alias("slot"),
            (base + F.floor(F.col("turn") * F.col("frame") / F.col("share"))).alias("release"),
            (base + F.ceil((F.col("turn") + 1) * F.col("frame") / F.col("share"))).alias("deadline"),
        )
    )


def mixed(
    df: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """The rows of df sorted by slot and rank; written as files, they lie there in mixed order."""
    places = schedule(df, weights, id_col, source_col).select(
        F.col("source").alias("__source"), F.col("doc_id").alias("__id"), F.col("slot").alias("__slot"), F.col("rank").alias("__rank")
    )
    names = df.columns
    return (
        df.join(
            places,
            column(source_col).cast("string").eqNullSafe(F.col("__source"))
            & column(id_col).cast("long").eqNullSafe(F.col("__id")),
        )
        .orderBy("__slot", "__rank")
        .select(*[column(c) for c in names])
    )
