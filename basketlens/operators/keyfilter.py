"""A blocked Bloom filter as a small table: rows that cannot find a partner go before they are shuffled.

A key sets BITS bits in one 64-bit word. Words are put together by a bitwise or per task and then over tasks, and joined to the large
side by broadcast, which their number bounds: WORDS at most, 16 bytes each. A row stays if its word has all the
bits of its key, so no partner is ever lost; about one key in a hundred stays without having one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.sources.staging import stage

BITS = 4
BITS_PER_KEY = 16
WORDS = 1 << 20
# Keys beyond which a filter of this size lets too much pass.
MOST_KEYS = WORDS * 64 // BITS_PER_KEY


def _word(key: str, words: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(words))


def _bits(key: str) -> Column:
    """The bits of a key, from different parts of a second hash."""
    code, one = F.xxhash64(F.col(key), F.lit(2)), F.lit(1).cast("long")
    out = F.lit(0).cast("long")
    for i in range(BITS):
        place = F.shiftright(code, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", one, place))
    return out


def key_words(keys: DataFrame, key: str, expected: int) -> tuple[DataFrame, int]:
    """The filter of the non-null keys, staged, and its number of words."""
    words = max(1, min(WORDS, expected * BITS_PER_KEY // 64 + 1))
    rows = keys.filter(F.col(key).isNotNull()).select(_word(key, words).alias("__word"), _bits(key).alias("__bits"))
    return stage(rows.groupBy("__word").agg(F.bit_or("__bits").alias("__bits"))), words


def with_partner(df: DataFrame, key: str, words: DataFrame, count: int) -> DataFrame:
    """The rows of df whose key may be in the filter; null keys go."""
    kept = df.withColumns({"__word": _word(key, count), "__need": _bits(key)}).join(F.broadcast(words), "__word")
    return kept.filter(F.col("__bits").bitwiseAND(F.col("__need")) == F.col("__need")).select(df.columns)


def may_have_partner(df: DataFrame, key: str, words: DataFrame, count: int, mark: str) -> DataFrame:
    """df and whether its key may be in the filter, as column `mark`; null keys are not in it. No row moves."""
    found = df.withColumns({"__word": _word(key, count), "__need": _bits(key)}).join(F.broadcast(words), "__word", "left")
    held = F.col("__bits").bitwiseAND(F.col("__need")) == F.col("__need")
    return found.select(*df.columns, (F.col(key).isNotNull() & F.coalesce(held, F.lit(False))).alias(mark))
