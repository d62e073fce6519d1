"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.tables import forget, is_written, written


def _lowest(node: str, seed: int):
    """Order of nodes in a round: a hash, so that paths that fall all the way are short."""
    return F.struct(F.xxhash64(node, F.lit(seed)).alias("h"), F.col(node).alias("n"))


# Rounds whose results are put together in one plan before they are written.
COMPOSED = 3


def _composed(found: DataFrame | None, steps: list[DataFrame]) -> DataFrame:
    """Labels (node, label) after further steps (from, to); a written table. Deletes what it was made of."""
    labels = found
    for step in steps:
        if labels is None:
            labels = step.withColumnsRenamed({"from": "node", "to": "label"})
        else:
            moved = labels.join(step, F.col("label") == F.col("from"), "left")
            labels = moved.select("node", F.coalesce("to", "label").alias("label"))
    out = written(labels, "labels")
    forget(found, *steps)
    return out


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): the smallest node reachable, for every node with an edge; a written table.

    Rounds of contraction: every node hooks onto its lowest neighbour in an order drawn anew each
    round, hooks are followed twice, and the edges between different results are the next
    round's graph. At most half the nodes of a graph are lower than all their neighbours, so it
    shrinks at least by half or so each round. A round writes its graph and where its nodes went, and deletes
    the graph before; after COMPOSED rounds the labels so far are written, so plans do not grow with the rounds. Minima are
    combined before each shuffle; a hub's edges are a join input that adaptive execution can
    split. Only whether edges are left reaches the driver.
    """
    # The edges are read three times, and making them may be dear.
    given = is_written(edges)
    edges = edges if given else written(edges.select("a", "b"), "edges")
    straight = edges.where("a <> b")
    left = written(straight.union(straight.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    found: DataFrame | None = None
    steps: list[DataFrame] = []
    seed = 0
    while not left.isEmpty():
        seed += 1
        low = F.least(F.min(_lowest("b", seed)), _lowest("a", seed))["n"]
        hooks = left.groupBy("a").agg(low.alias("p"))
        twice = hooks.join(hooks.select(F.col("a").alias("q"), F.col("p").alias("r")), F.col("p") == F.col("q"))
        twice = twice.select("a", F.col("r").alias("p"))
        jumped = twice.join(twice.select(F.col("a").alias("q"), F.col("p").alias("r")), F.col("p") == F.col("q"))
        step = written(jumped.select(F.col("a").alias("from"), F.col("r").alias("to")), "hooks")
        ends = left.join(step.withColumnsRenamed({"from": "a", "to": "x"}), "a").join(
            step.withColumnsRenamed({"from": "b", "to": "y"}), "b"
        )
        ends = ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        before, left = left, written(ends, "edges")
        forget(before)
        steps.append(step)
        if len(steps) == COMPOSED:
            found, steps = _composed(found, steps), []
    if steps:
        found = _composed(found, steps)
    alone = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    if found is None:
        out = written(alone.select("node", F.col("node").alias("component")), "components")
    else:
        first = found.groupBy("label").agg(F.min("node").alias("component"))
        named = found.join(first, "label").select("node", "component")
        others = alone.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
        out = written(named.union(others), "components")
    forget(None if given else edges, left, found)
    return out


def merged(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, component) after more edges (a, b) between nodes, known ones or not; a written table."""

    def named(end: str) -> DataFrame:
        return classes.select(F.col("node").alias(f"__{end}"), F.col("component").alias(f"c{end}"))

    ends = edges.join(named("a"), F.col("a") == F.col("__a"), "left").join(named("b"), F.col("b") == F.col("__b"), "left")
    ends = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = components(ends)
    to = moved.select(F.col("node").alias("__of"), F.col("component").alias("to"))
    known = classes.join(to, F.col("component") == F.col("__of"), "left")
    known = known.select("node", F.coalesce("to", "component").alias("component"))
    new = moved.join(classes, "node", "left_anti")
    out = written(known.union(new), "components")
    forget(moved)
    return out
