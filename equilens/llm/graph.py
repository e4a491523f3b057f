"""Connected components of an edge list, by repeated contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_once


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    Each round joins every node to its smallest neighbour, contracts the graph
    to these parents and drops loops and repeats, so that a round at least
    halves the nodes that still have edges. The minimum is a partial
    aggregate: a node with a great many edges is one row after the map side.
    Rounds are written to the shared checkpoint folder, which cuts lineage;
    one boolean a round comes to the driver.
    """
    pairs = write_once(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    total = None
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("parent"))
        up = write_once(up, "parents")
        left, right = up.toDF("a", "pa"), up.toDF("b", "pb")
        pairs = (pairs.join(left, "a").join(right, "b").where("pa <> pb")
                 .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        pairs = write_once(pairs, "edges")
        if total is None:
            total = up
        else:   # every node of the first round follows its parent's parent
            onward = up.toDF("parent", "next")
            total = write_once(total.join(onward, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent")), "labels")
    if total is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    # a parent need not be the smallest node of its component: take the least over all that share the last parent
    least = total.groupBy("parent").agg(F.min("node").alias("component"))
    return total.join(least, "parent").select("node", "component")
