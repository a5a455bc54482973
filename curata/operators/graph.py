"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.session import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an undirected edge table; a component is named by its smallest node.

    Each round gives every node its smallest neighbour as parent, follows parents to their roots
    (pointer jumping) and contracts the edges to those between different roots, until none is left.
    A node that no round joins to another is smaller than its neighbours, which then hook on smaller
    ones still, so it is joined in the next: roots at least halve in two rounds, and jumps halve the
    way to the root, whatever the order of ids along a chain. Tables are written to the shared folder
    after each step, which cuts the lineage. Nothing is collected but whether rows are left.
    """
    one = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    one = materialize(one.distinct(), "edges")
    labels = one.select(F.col("a").alias("node")).union(one.select("b")).distinct().withColumn("component", F.col("node"))
    labels = materialize(labels, "labels")
    pairs = _pairs(one)
    while pairs.limit(1).count():
        roots = _roots(pairs)
        own = roots.withColumnsRenamed({"node": "component", "root": "low"})
        labels = materialize(labels.join(own, "component", "left").select("node", F.coalesce("low", "component").alias("component")), "labels")
        near, far = (roots.withColumnsRenamed({"node": c, "root": f"{c}_root"}) for c in ("a", "b"))
        met = pairs.join(near, "a").join(far, "b", "left")
        pairs = _pairs(met.select(F.col("a_root").alias("a"), F.coalesce("b_root", "b").alias("b")))
    return labels


def _pairs(edges: DataFrame) -> DataFrame:
    """Each edge (a, b) between different nodes once, the greater node as a."""
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return materialize(ordered.distinct(), "pairs")


def _roots(pairs: DataFrame) -> DataFrame:
    """(node, root) where parents, a node's smallest neighbour, lead; nodes without a smaller neighbour are not listed."""
    found = materialize(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "roots")
    while True:
        above = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = found.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved"))
        written = materialize(jumped, "roots")
        found = written.select("node", "root")
        if not written.filter("moved").limit(1).count():
            return found
