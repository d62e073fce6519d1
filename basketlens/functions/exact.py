"""Sums and means that do not depend on how rows are partitioned, and lose nothing.

Money arrives as doubles. Adding doubles gives a last digit that changes with the
partition order. Here whole units, millionths and 10^-15ths are added as three long
integers; a part smaller than the spacing of the double itself is not the amount's but
its binary rounding and left out. The total is put together as a decimal. Amounts
the integers cannot hold (from 2^31 on, infinities, fractions finer than 10^-15) are added as
doubles beside them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACING = 2.0**-52
_LIMIT = float(2**31)
_EXACT = "decimal(38,15)"


def _amount(c: Column | str) -> Column:
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def money_sum(c: Column | str, weight: str | None = None) -> Column:
    """Sum of the non-null values as struct (exact, rest), for `sum_of_sums` and `total`.

    Both fields are NULL when there are no values. `weight` names a whole-number column
    to multiply each value by.
    """
    x = _amount(c)
    held = F.when(F.abs(x) < _LIMIT, x)
    units = F.floor(held)
    millionths = F.rint((held - units) * 1e6)
    finer = (held - units) - millionths / 1e6
    spacing = F.abs(held) * _SPACING
    femtos = F.when(F.abs(finer) > spacing, F.rint(finer * 1e15)).otherwise(F.lit(0.0))
    fits = (F.abs(finer) <= spacing) | (F.abs(finer - femtos / 1e15) <= spacing)
    fits = F.coalesce(fits, F.lit(False))
    times = F.col(weight) if weight else F.lit(1)

    def added(part: Column, scale: str, kind: str) -> Column:
        return F.sum(F.when(fits, part.cast("long") * times)).cast("decimal(20,0)") * F.lit(scale).cast(kind)

    exact = [
        added(units, "1", "decimal(1,0)"),
        added(millionths, "0.000001", "decimal(6,6)"),
        added(femtos, "0.000000000000001", "decimal(15,15)"),
    ]
    exact = [F.coalesce(p.cast(_EXACT), F.lit(0).cast(_EXACT)) for p in exact]
    rest = F.coalesce(F.sum(F.when(~fits, x * times)), F.lit(0.0))
    some = F.count(x) > 0
    return F.struct(
        F.when(some, (exact[0] + exact[1] + exact[2]).cast(_EXACT)).alias("exact"), F.when(some, rest).alias("rest")
    )


def sum_of_sums(c: str) -> Column:
    """Sum of a column made by `money_sum`."""
    return F.struct(F.sum(f"{c}.exact").cast(_EXACT).alias("exact"), F.sum(f"{c}.rest").alias("rest"))


def total(s: Column) -> Column:
    """A sum as a double; NULL when there were no values."""
    return s["exact"].cast("double") + s["rest"]


def exact_sum(c: Column | str, weight: str | None = None) -> Column:
    """Sum of the non-null values; 0 when there are none."""
    return F.coalesce(total(money_sum(c, weight)), F.lit(0.0))


def exact_mean(c: Column | str) -> Column:
    """Mean of the non-null values; NULL when there are none."""
    return F.try_divide(total(money_sum(c)), F.count(_amount(c)))
