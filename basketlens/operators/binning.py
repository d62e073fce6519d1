"""Quantile and equal-width binning, histograms, top-k and value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.bins import doubles, edge_bin, labelled, rank_bin, width_bin, width_edges
from basketlens.operators.ranking import exact_quantiles, global_rank


def column_edges(df: DataFrame, col: str, bins: int) -> list[float | None]:
    """Edges of equal-width bins over the non-null values of a column."""
    x = F.col(col).cast("double")
    return width_edges(*df.agg(F.min(x), F.max(x)).first(), bins)


def cut(df: DataFrame, col: str, bins: int, out: str, labels: list | None = None) -> DataFrame:
    """Add the equal-width bin (1..bins) or its label. df is read twice: stage it."""
    bin_ = width_bin(F.col(col).cast("double"), column_edges(df, col, bins))
    return df.withColumn(out, labelled(bin_, labels) if labels else bin_)


def cut_edges(col: Column | str, edges: list[float], labels: list[str]) -> Column:
    """Label by explicit right-closed edges; values at or below the first edge get NULL."""
    x = F.col(col) if isinstance(col, str) else col
    out = F.when((x > edges[0]) & (x <= edges[1]), labels[0])
    for i in range(1, len(labels)):
        out = out.when((x > edges[i]) & (x <= edges[i + 1]), labels[i])
    return out


def qcut(df: DataFrame, col: str, q: int, out: str, labels: list | None = None) -> DataFrame:
    """Add the quantile bin (1..q) or its label; equal-width bins if quantile edges coincide.

    df is read several times: stage it.
    """
    edges = exact_quantiles(df, col, [i / q for i in range(q + 1)])
    if len(set(edges)) <= q:
        edges = width_edges(edges[0], edges[q], q)
    bin_ = edge_bin(F.col(col).cast("double"), edges)
    return df.withColumn(out, labelled(bin_, labels) if labels else bin_)


def rank_qcut(df: DataFrame, col: str, tie: str, q: int, out: str) -> DataFrame:
    """Add the quantile bin of the rank of `col`, ties in the order of the key `tie`.

    With a single row ranks have no quantiles and the equal-width bin of the value
    stands in, as for tied edges. `col` must not be null. df is read twice: stage it.
    """
    first = df.select(F.col(col).cast("double")).take(2)
    if len(first) == 1:
        return df.withColumn(out, edge_bin(F.col(col).cast("double"), width_edges(first[0][0], first[0][0], q)))
    ranked = global_rank(df, [col, tie], rank="__rank", total="__rows")
    return ranked.withColumn(out, rank_bin(F.col("__rank"), F.col("__rows"), q)).drop("__rank", "__rows")


def histogram(df: DataFrame, col: str, bins: int, weight: str | None = None) -> DataFrame:
    """Rows per equal-width bin, empty bins kept: bin, lower, upper, count.

    `weight` counts a pre-aggregated row that many times. df is read twice: stage it.
    """
    edges = column_edges(df, col, bins)
    n = F.sum(weight) if weight else F.count("*")
    counted = (
        df.filter(F.col(col).isNotNull())
        .select(width_bin(F.col(col).cast("double"), edges).alias("bin"), *([weight] if weight else []))
        .groupBy("bin")
        .agg(n.alias("count"))
    )
    return bin_frame(df, edges).join(counted, "bin", "left").select(
        "bin", "lower", "upper", F.coalesce("count", F.lit(0)).alias("count")
    )


def histograms(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Rows per equal-width bin of several columns, empty bins kept: measure, bin, lower, upper, count.

    Two scans for all of them: one finds every column's bounds, one counts (measure, bin), a row of df giving
    one entry for each column that it has a value of. df is read twice: stage it.
    """
    values = [F.col(c).cast("double") for c in columns]
    bounds = df.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(values) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    edges = [width_edges(bounds[f"lo{i}"], bounds[f"hi{i}"], bins) for i in range(len(columns))]
    entries = F.array(*[F.struct(F.lit(i).alias("m"), width_bin(x, e).alias("bin")) for i, (x, e) in enumerate(zip(values, edges))])
    counted = (
        df.select(F.explode(entries).alias("e"))
        .filter(F.col("e.bin").isNotNull())
        .groupBy(F.col("e.m").alias("m"), F.col("e.bin").alias("bin"))
        .agg(F.count("*").alias("count"))
    )
    place = F.col("id").cast("int")
    m, i = (place / bins).cast("int"), place % bins
    names, at = F.array(*[F.lit(c) for c in columns]), F.array(*[doubles(e) for e in edges])
    frame = df.sparkSession.range(0, len(columns) * bins, 1, 1).select(
        m.alias("m"), F.get(names, m).alias("measure"), (i + 1).alias("bin"),
        F.get(F.get(at, m), i).alias("lower"), F.get(F.get(at, m), i + 1).alias("upper"),
    )
    return frame.join(counted, ["m", "bin"], "left").select(
        "measure", "bin", "lower", "upper", F.coalesce("count", F.lit(0)).alias("count")
    )


def bin_frame(df: DataFrame, edges: list[float | None]) -> DataFrame:
    """One row per bin with its edges."""
    i, at = F.col("id").cast("int"), doubles(edges)
    return df.sparkSession.range(1, len(edges), 1, 1).select(
        i.alias("bin"), F.get(at, i - 1).alias("lower"), F.get(at, i).alias("upper")
    )


def top_k(df: DataFrame, n: int, metric: str, tie: str) -> DataFrame:
    """The n rows with the largest metric, nulls last, ties by the smaller key."""
    return df.orderBy(F.desc_nulls_last(metric), F.asc(tie)).limit(n)


def value_counts(df: DataFrame, col: str, out: str = "count") -> DataFrame:
    """Rows per non-null value, most frequent first, ties by value."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count("*").alias(out))
        .orderBy(F.desc(out), F.asc(col))
    )
