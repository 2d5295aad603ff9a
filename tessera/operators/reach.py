"""What can be reached over a table of edges, by semi-naive evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.saved import broadcast_if_small, saved


def reachable(edges: DataFrame, source: str, target: str, starts: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(source, target, steps): all pairs with a path from source to target of one edge or more, and the edges of the shortest.

    starts: one column of sources to begin from (by default all). most: longest
    paths followed. A round joins only the pairs found in the last one with the
    edges, and keeps those that no earlier round found; so an edge is joined with
    a pair once, and rounds end after the longest shortest path. Found pairs are
    written round by round, and both joins are keyed, by the pairs' end and by the
    pair. Repeated edges count once, edges with a null end not at all; a circle
    reaches its own nodes.
    """
    steps = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).filter("a is not null and b is not null").distinct()
    steps = saved(steps, "edges")
    delta = steps if starts is None else steps.join(starts.select(F.col(starts.columns[0]).alias("a")).distinct(), "a")
    delta = saved(delta.withColumn("n", F.lit(1).cast("long")), "pairs-1")
    found, n = [delta], 1
    onward = broadcast_if_small(steps.select(F.col("a").alias("b"), F.col("b").alias("c")))
    while not delta.isEmpty() and (most is None or n < most):
        n += 1
        further = delta.join(onward, "b").select("a", F.col("c").alias("b")).distinct()
        for earlier in found:
            further = further.join(earlier.select("a", "b"), ["a", "b"], "left_anti")
        delta = saved(further.withColumn("n", F.lit(n).cast("long")), f"pairs-{n}")
        found.append(delta)
        if len(found) > 8:  # one table for the older rounds: a round's plan doesn't grow with their number
            found = [saved(union(found), "pairs")]
    return union(found).select(F.col("a").alias(source), F.col("b").alias(target), F.col("n").alias("steps"))


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
