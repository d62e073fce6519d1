"""Facts about input tables that are looked up once per table."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame

Fact = TypeVar("Fact")

_KNOWN: WeakKeyDictionary[DataFrame, dict[str, object]] = WeakKeyDictionary()


def once(df: DataFrame, name: str, look: Callable[[], Fact]) -> Fact:
    """What `look` finds out about df, from memory if it was asked before.

    Known per DataFrame object: whoever reads a table anew, because its files may have changed, looks anew.
    """
    facts = _KNOWN.setdefault(df, {})
    if name not in facts:
        facts[name] = look()
    return facts[name]
