"""Global rank and exact quantiles without pulling the data into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.sources.staging import stage

# monotonically_increasing_id: partition number above this bit, row number below.
_ROW_BITS = 33
_ROW_MASK = (1 << _ROW_BITS) - 1

# Distinct values (estimated) up to which one task may hold all their counts: a few megabytes.
DISTINCT_LIMIT = 100_000


def _range_parts(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Range-partition and sort df, fix each row's `__part` and `__idx`, and stage it.

    Staging pins the partition bounds, which Spark samples anew for every plan.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__pos", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__pos", _ROW_BITS))
        .withColumn("__idx", F.col("__pos").bitwiseAND(F.lit(_ROW_MASK)))
        .drop("__pos")
    )
    return stage(placed)


def _part_offsets(parts: DataFrame, weight: Column) -> DataFrame:
    """Per range partition: weight, weight before it, and weight overall.

    The windows see one row per range partition, at most spark.sql.shuffle.partitions.
    """
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.groupBy("__part")
        .agg(F.sum(weight).alias("__weight"))
        .withColumn("__before", F.coalesce(F.sum("__weight").over(before), F.lit(0)))
        .withColumn("__total", F.sum("__weight").over(Window.partitionBy()))
    )


def global_rank(df: DataFrame, order: Sequence[str], rank: str = "rank", total: str | None = None) -> DataFrame:
    """Add the 1-based position of every row in the order of the columns `order`.

    `order` must end in a unique key, so that a heavy value is split over range partitions
    and ties are settled. Only these columns are sorted and staged; the ranks are joined back
    by the key. df is read three times (bounds, order, join): pass a staged table.
    """
    key = order[-1]
    parts = _range_parts(df.select(*order), order)
    offsets = _part_offsets(parts, F.lit(1))
    ranks = parts.join(F.broadcast(offsets), "__part").select(
        F.col(key).alias("__rank_key"),
        (F.col("__before") + F.col("__idx") + 1).alias(rank),
        *([F.col("__total").alias(total)] if total else []),
    )
    return df.join(ranks, F.col(key).eqNullSafe(F.col("__rank_key"))).drop("__rank_key")


def global_ranks(df: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """measure (place in `measures`), value (double), key, rank (from 1) and total of every non-null value of several measures.

    What global_rank does for one column, in one range partitioning and one staged table for all: the measures are melted to
    (measure, value, key), sorted as one list, and ranks count from each measure's first row. `key` must be unique.
    df is read twice (bounds, order): pass a staged table.
    """
    melted = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("measure"), F.col(m).cast("double").alias("value")) for i, m in enumerate(measures)])
        ).alias("__m"),
        key,
    )
    parts = _range_parts(
        melted.select("__m.measure", "__m.value", key).filter(F.col("value").isNotNull()), ["measure", "value", key]
    )
    # One row per measure and range partition: at most shuffle partitions + measures.
    before = Window.partitionBy("measure").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("measure", "__part")
        .agg(F.count("*").alias("__rows"), F.min("__idx").alias("__first"))
        .withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
        .withColumn("total", F.sum("__rows").over(Window.partitionBy("measure")))
    )
    rank = F.col("__before") + F.col("__idx") - F.col("__first") + 1
    return parts.join(F.broadcast(offsets), ["measure", "__part"]).select("measure", "value", key, rank.alias("rank"), "total")


def ranked_quantiles(ranks: DataFrame, wanted: dict[int, Sequence[float]]) -> dict[int, list[float | None]]:
    """The interpolated quantiles of some measures of `global_ranks`, by measure, in one aggregate."""
    names, aggs = [], []
    for m, probs in wanted.items():
        for p in probs:
            at = _position(p, F.col("total"))
            for place in (F.floor(at), F.least(F.floor(at) + 1, F.col("total") - 1)):
                hit = (F.col("measure") == m) & (F.col("rank") - 1 == place)
                aggs.append(F.max(F.when(hit, F.col("value"))).alias(f"w{len(aggs)}"))
            names.append((m, p))
    totals = [F.max(F.when(F.col("measure") == m, F.col("total"))).alias(f"t{m}") for m in wanted]
    found = ranks.agg(*aggs, *totals)
    values = found.select(
        *[
            _between(F.col(f"w{2 * i}"), F.col(f"w{2 * i + 1}"), _position(p, F.col(f"t{m}"))).alias(f"q{i}")
            for i, (m, p) in enumerate(names)
        ]
    ).first()
    out: dict[int, list[float | None]] = {m: [] for m in wanted}
    for (m, _), v in zip(names, values):
        out[m].append(v)
    return out


def _position(p: float, total: Column) -> Column:
    """Where a quantile lies among `total` values in order, counted from 0."""
    return F.lit(p) * (total - 1).cast("double")


def _between(low: Column, high: Column, position: Column) -> Column:
    """The value between the two next to a position."""
    t, step = position - F.floor(position), high - low
    return F.when(step == 0, low).when(t < 0.5, low + step * t).otherwise(high - step * (1 - t))


def exact_quantiles(
    df: DataFrame,
    col: str,
    probs: Sequence[float],
    weight: str | None = None,
    distinct_limit: int = DISTINCT_LIMIT,
) -> list[float | None]:
    """The linearly interpolated quantiles of the non-null values, one number per probability.

    Equal values collapse to one counted row. Up to distinct_limit of them are ordered
    in one task; beyond that they are sorted over range partitions, and only the
    partitions that hold a wanted position are searched. Both ways find the two values next to
    each position and interpolate alike. `weight` names the row count of a df that is
    collapsed already. df is read more than once: pass a staged table.
    """
    present = df.filter(F.col(col).isNotNull())
    few = present.agg(F.approx_count_distinct(col)).first()[0] <= distinct_limit
    if weight:
        counts = present.select(F.col(col).alias("v"), F.col(weight).alias("c"))
    else:
        counts = present.groupBy(F.col(col).alias("v")).agg(F.count("*").alias("c"))

    def position(p: float) -> Column:
        return _position(p, F.col("__total"))

    wanted = [
        at
        for p in probs
        for at in (F.floor(position(p)), F.least(F.floor(position(p)) + 1, F.col("__total") - 1))
    ]
    if few:
        running = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        rows = (
            counts.withColumn("__to", F.sum("c").over(running))
            .withColumn("__from", F.col("__to") - F.col("c"))
            .withColumn("__total", F.sum("c").over(Window.partitionBy()))
        )
    else:
        parts = _range_parts(counts, ["v"])
        offsets = _part_offsets(parts, F.col("c"))
        hit = F.lit(False)
        for at in wanted:
            hit = hit | ((at >= F.col("__before")) & (at < F.col("__before") + F.col("__weight")))
        running = Window.partitionBy("__part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        rows = (
            parts.join(F.broadcast(offsets.filter(hit)), "__part")
            .withColumn("__to", F.col("__before") + F.sum("c").over(running))
            .withColumn("__from", F.col("__to") - F.col("c"))
        )
    found = rows.agg(
        F.max("__total").alias("__total"),
        *[
            F.max(F.when((at >= F.col("__from")) & (at < F.col("__to")), F.col("v").cast("double"))).alias(f"w{i}")
            for i, at in enumerate(wanted)
        ],
    )
    edges = [_between(F.col(f"w{2 * i}"), F.col(f"w{2 * i + 1}"), position(p)) for i, p in enumerate(probs)]
    return list(found.select(*[e.alias(f"q{i}") for i, e in enumerate(edges)]).first())
