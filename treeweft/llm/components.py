"""Connected components of an edge table, by contraction.

In each round the nodes get a new order by a hash; each merges into the first of its neighbours, if that comes
before itself, and follows that one's own merges four steps far. The edges are then drawn anew between what is left.
A node with an edge comes before a given neighbour in half of all orders, so that a round leaves half of the nodes
at most, on average, whatever the edges look like: the rounds grow with the logarithm of the nodes. No neighbour
list is gathered: a round is a minimum per node and a few joins, whose large keys adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeweft.llm.common import stored


def hop(x: DataFrame, y: DataFrame) -> DataFrame:
    """(n, m): where ``y`` leads from where ``x`` leads from n; nodes that ``y`` lacks stay."""
    via = x.select("n", F.col("m").alias("_via")).join(y.select(F.col("n").alias("_via"), F.col("m").alias("_to")), "_via", "left")
    return via.select("n", F.coalesce("_to", "_via").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``edges``; the label is the component's smallest node.

    Loops and repeated edges are harmless, edges with a null end are none; no edges give no rows.
    """
    left = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    left = stored(left, "edges")
    moved = None
    turn = 0
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def rank(c, turn=turn):
            return F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("n"))

        first = both.groupBy("a").agg(F.min(rank("b")).alias("to"))
        step = first.select(F.col("a").alias("n"), F.least(F.col("to"), rank("a"))["n"].alias("m"))
        step = stored(step, "merges")
        two = hop(step, step)
        four = stored(hop(two, two), "merges")
        ends = left.select(F.col("a").alias("n"), F.col("b").alias("m"))
        ends = hop(ends, four).select(F.col("m").alias("n"), F.col("n").alias("m"))
        ends = hop(ends, four).select(F.least("n", "m").alias("a"), F.greatest("n", "m").alias("b"))
        left = stored(ends.filter("a <> b").distinct(), "edges")
        moved = four if moved is None else hop(moved, four)
        turn += 1
    if moved is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    moved = stored(moved, "labels")
    least = moved.groupBy("m").agg(F.min("n").alias("label"))
    return moved.join(least, "m").select(F.col("n").alias("node"), "label")
