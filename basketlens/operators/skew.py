"""Joins whose left side may hold a large part of its rows under one key.

AQE splits a skewed join only if both sides come straight from a shuffle. Here the
right sides are often aggregates that are partitioned by the key already, so heavy
keys are found beforehand and salted: left rows with such a key are spread over
salts, and the few right rows of these keys are repeated once per salt. The result
is that of the plain join.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.sources.checks import once

# A key is heavy from this many times the rows of an average shuffle partition.
FACTOR = 5
# Least number of counters of the sketch that finds them.
COUNTERS = 10_000


@dataclass(frozen=True)
class HeavyKeys:
    """Heavy values of a key column (None included, if null is heavy), each with its number of salts."""

    salts: tuple[tuple[object, int], ...] = ()

    @property
    def values(self) -> tuple:
        return tuple(v for v, _ in self.salts)


NO_HEAVY_KEYS = HeavyKeys()


def heavy_keys(df: DataFrame, columns: Collection[str]) -> dict[str, HeavyKeys]:
    """Heavy keys per column, from one pass over these columns with a bounded sketch, once per table.

    No more than shuffle partitions / FACTOR keys can be heavy, so no more are asked for.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return once(df, f"heavy {sorted(columns)} {partitions}", lambda: _heavy_keys(df, columns, partitions))


def _heavy_keys(df: DataFrame, columns: Collection[str], partitions: int) -> dict[str, HeavyKeys]:
    most = -(-partitions // FACTOR) + 1
    counters = F.lit(max(COUNTERS, 20 * most))
    top = [F.call_function("approx_top_k", c, F.lit(most), counters).alias(c) for c in columns]
    found = df.agg(F.count("*").alias("__rows"), *top).first()
    average = max(1.0, found["__rows"] / partitions)
    out = {}
    for c in columns:
        heavy = [(item["item"], item["count"]) for item in found[c] or [] if item["count"] > FACTOR * average]
        out[c] = HeavyKeys(tuple((v, min(partitions, int(n // average) + 1)) for v, n in heavy))
    return out


def _salts(key: str, heavy: HeavyKeys) -> Column:
    """Number of salts of each row's key; 1 unless it is heavy."""
    named = [(v, n) for v, n in heavy.salts if v is not None]
    of_null = next((n for v, n in heavy.salts if v is None), 1)
    out = F.lit(1)
    if named:
        table = F.create_map(*[F.lit(x) for pair in named for x in pair])
        out = F.coalesce(F.try_element_at(table, F.col(key)), F.lit(1))
    return F.when(F.col(key).isNull(), F.lit(of_null)).otherwise(out)


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str, heavy: HeavyKeys = NO_HEAVY_KEYS) -> DataFrame:
    """left.join(right, key, how) for how in inner and left, with heavy left keys spread over tasks.

    The salt is a hash of the whole row and its input partition, so a task that is run
    again after a loss gives its rows the same salts.
    """
    if not heavy.salts:
        return left.join(right, key, how)
    spread = F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in left.columns])
    salt = F.pmod(spread, _salts(key, heavy).cast("long")).cast("int")
    salts = F.sequence(F.lit(0), _salts(key, heavy) - 1)
    joined = left.withColumn("__salt", salt).join(
        right.withColumn("__salt", F.explode(salts)), [key, "__salt"], how
    )
    return joined.drop("__salt")
