"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the smallest node reachable.

    Each round hangs every node on its smallest neighbour (a map-side combined
    aggregate, so a hub costs no more than its edges), shortens the chains by
    pointer doubling, and contracts the edges to roots; the edges left shrink
    by at least half a round. All tables are narrow and written to the shared
    folder, so no lineage grows and no key is gathered into one task.
    Loops and repeated edges are allowed; nulls are ignored.
    """
    pair = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u is not null and v is not null")
    nodes = save(pair.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("root")), "nodes")
    pair = save(pair.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not pair.isEmpty():
        # every node with a smaller neighbour gets a parent below itself: a forest
        parent = save(pair.groupBy("u").agg(F.min("v").alias("p")), "parent")
        while True:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            longer = save(parent.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "parent")
            parent = longer.select("u", "p")
            if longer.filter("moved").isEmpty():
                break
        root = lambda name: parent.select(F.col("u").alias(name), F.col("p").alias(name + "_root"))
        nodes = save(nodes.join(root("root"), "root", "left").select("node", F.coalesce("root_root", "root").alias("root")), "nodes")
        moved = pair.join(root("u"), "u", "left").join(root("v"), "v", "left").select(F.coalesce("u_root", "u").alias("a"), F.coalesce("v_root", "v").alias("b"))
        pair = save(moved.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    return nodes
