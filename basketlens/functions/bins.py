"""Right-closed bin arithmetic as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def width_edges(lo: float | None, hi: float | None, bins: int) -> list[float | None]:
    """The bins + 1 edges of equal-width bins over [lo, hi]; all None without a range.

    A single-valued range is widened by 0.1 % to both sides. The low end of any
    other range is not lowered here: bins take the minimum anyway.
    """
    if lo is None or hi is None:
        return [None] * (bins + 1)
    if lo == hi:
        pad = 0.001 * abs(lo) if lo else 0.001
        lo, hi = lo - pad, hi + pad
    step = (hi - lo) / bins
    return [i * step + lo for i in range(bins)] + [hi]


def doubles(values: list[float | None]) -> Column:
    """A constant array of doubles."""
    return F.array(*[F.lit(v).cast("double") for v in values])


def width_bin(x: Column, edges: list[float | None]) -> Column:
    """1-based bin of x: edges[bin-1] < x <= edges[bin], the minimum in bin 1.

    One division finds the bin up to rounding, two edge comparisons settle it, so
    the cost per row does not grow with the number of bins.
    """
    bins = len(edges) - 1
    if edges[0] is None:
        return F.lit(None).cast("int")
    at = doubles(edges)
    share = (x - edges[0]) / (edges[-1] - edges[0])
    guess = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(share * bins).cast("int")))
    settled = (
        guess
        + F.when(x > F.get(at, guess), 1).otherwise(0)
        - F.when((x <= F.get(at, guess - 1)) & (x > edges[0]), 1).otherwise(0)
    )
    return F.when(x.isNotNull(), settled)


def edge_bin(x: Column, edges: list[float | None]) -> Column:
    """1-based right-closed bin of x by ascending edges, of which the outer two do not matter."""
    above = sum((F.when(x > F.lit(e).cast("double"), 1).otherwise(0) for e in edges[1:-1]), F.lit(1))
    return F.when(x.isNotNull(), above)


def rank_bin(rank: Column, n: Column, q: int) -> Column:
    """Quantile bin of a rank 1..n (n > 1): least b with rank <= 1 + b*(n-1)/q, in integers."""
    up = F.call_function("div", q * (rank - 1) + n - 2, n - 1)
    return F.greatest(F.lit(1), F.least(F.lit(q), up)).cast("int")


def labelled(bin_: Column, labels: list) -> Column:
    """Label of a 1-based bin; NULL outside 1..len(labels)."""
    out = F.when(bin_ == 1, F.lit(labels[0]))
    for i, label in enumerate(labels[1:], start=2):
        out = out.when(bin_ == i, F.lit(label))
    return out
