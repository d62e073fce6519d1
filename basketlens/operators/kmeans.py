"""k-means for many numbers of clusters and starts at once: one aggregate a round moves the centres of all fits.

A round is one pass over the points. Each task finds every point's nearest centre within each fit, as one matrix product per block
of points, and returns count, sums and cost per centre; these rows are added up, and the driver holds the centres, which are
bounded by the parameters. Fits that have settled take no part in later rounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points a task holds against all centres at a time.
BLOCK = 2048
# Rows per centre of up to so many tasks go to the driver as they are; those of more tasks are added up before.
PARTIALS = 64


def _round(points: DataFrame, columns: Sequence[str], fits: Sequence[np.ndarray], add: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per centre of all fits, in order: points, sums of their coordinates, squared distances. `add`: see PARTIALS."""
    centres = np.concatenate(fits)
    stops = np.cumsum([len(f) for f in fits])
    sums = [f"s{i}" for i in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, moved, cost = np.zeros(len(centres)), np.zeros(centres.shape), np.zeros(len(centres))
        norm = (centres**2).sum(1)
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy() for i in range(len(columns))])
            for block in (x[i : i + BLOCK] for i in range(0, len(x), BLOCK)):
                far = norm - 2 * block @ centres.T
                own = (block**2).sum(1)
                rows = np.arange(len(block))
                for start, stop in zip(stops - [len(f) for f in fits], stops):
                    near = far[:, start:stop].argmin(1) + start
                    n += np.bincount(near, minlength=len(centres))
                    cost += np.bincount(near, np.maximum(far[rows, near] + own, 0), len(centres))
                    for d in range(len(columns)):
                        moved[:, d] += np.bincount(near, block[:, d], len(centres))
        some = np.flatnonzero(n)
        found = [pa.array(some), pa.array(n[some]), pa.array(cost[some]), *[pa.array(moved[some, d]) for d in range(len(columns))]]
        yield pa.RecordBatch.from_arrays(found, ["centre", "n", "cost", *sums])

    schema = "centre long, n double, cost double, " + ", ".join(f"{s} double" for s in sums)
    found = points.select(*columns).mapInArrow(run, schema)
    if add:
        found = found.groupBy("centre").agg(*[F.sum(c).alias(c) for c in ("n", "cost", *sums)])
    n, moved, cost = np.zeros(len(centres)), np.zeros(centres.shape), np.zeros(len(centres))
    for row in found.collect():
        n[row.centre] += row.n
        cost[row.centre] += row.cost
        moved[row.centre] += row[3:]
    return n, moved, cost


def lloyd(
    points: DataFrame, columns: Sequence[str], starts: Sequence[np.ndarray], max_rounds: int, shift: float = 0.0
) -> tuple[list[np.ndarray], np.ndarray]:
    """Final centres of the fits that begin at `starts` (k x columns each), and the cost of each.

    A fit is settled once the squared moves of its centres sum to less than `shift`. A centre without points stays.
    `points` (double columns without nulls) is read once a round: persist or stage it.
    """
    fits = [np.array(s, float) for s in starts]
    add = points.rdd.getNumPartitions() > PARTIALS
    active = list(range(len(fits)))
    for _ in range(max_rounds):
        if not active:
            break
        n, moved, _ = _round(points, columns, [fits[i] for i in active], add)
        left, place = [], 0
        for i in active:
            own = slice(place, place + len(fits[i]))
            place += len(fits[i])
            some = n[own] > 0
            new = fits[i].copy()
            new[some] = moved[own][some] / n[own][some, None]
            if ((new - fits[i]) ** 2).sum() >= shift:
                left.append(i)
            fits[i] = new
        active = left
    cost = _round(points, columns, fits, add)[2] if fits else np.zeros(0)
    stops = np.cumsum([0, *[len(f) for f in fits]])
    return fits, np.array([cost[a:b].sum() for a, b in zip(stops, stops[1:])])


def seeded(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k starting centres among the rows of `sample`, far points likelier (k-means++); its first j are a start for j clusters."""
    rng = np.random.default_rng(seed)
    centres = [sample[rng.integers(len(sample))]]
    far = ((sample - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        weight = far.sum()
        pick = rng.choice(len(sample), p=far / weight) if weight > 0 else rng.integers(len(sample))
        centres.append(sample[pick])
        far = np.minimum(far, ((sample - centres[-1]) ** 2).sum(1))
    return np.array(centres)


def nearest(columns: Sequence[str], centres: np.ndarray) -> Column:
    """The place (from 0) of the nearest centre, the first of equals."""
    distances = F.array(
        *[sum(((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(columns, centre)), F.lit(0.0)) for centre in centres]
    )
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")
