"""Forests as edge tables (tumour, parent, child, length).

What depends on a node's ancestors or descendants is found by pointer doubling: each node knows a value about the ancestors up to
1, 2, 4.. steps away, and a round joins it with that of the last of them. So a path of n nodes takes log2 n rounds, and each round is
one join or one join and one aggregate over all nodes. ``intervals`` numbers nodes as a walk through their tree meets them, so that
descendants are a range and sums over them are differences of running sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeweft.functions.vectors import positions, running
from treeweft.plans.lineage import settled


def nodes(edges: DataFrame) -> DataFrame:
    """(tumour, node, parent, length): every node once; roots have a null parent."""
    inner = edges.select("tumour", F.col("child").alias("node"), "parent", "length")
    tops = roots(edges).select("tumour", "node", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("double").alias("length"))
    return inner.unionByName(tops)


def roots(edges: DataFrame) -> DataFrame:
    """(tumour, node): parents that are nobody's child."""
    parents = edges.select("tumour", F.col("parent").alias("node")).distinct()
    children = edges.select("tumour", F.col("child").alias("node"))
    return parents.join(children, ["tumour", "node"], "left_anti")


def in_degrees(edges: DataFrame, *by: str) -> DataFrame:
    return edges.groupBy(*by, "child").agg(F.count("*").alias("in_degree"))


def check_forest(edges: DataFrame) -> None:
    """Raise ValueError if a node has two parents or a label stands in two trees."""
    if in_degrees(edges).filter("in_degree > 1").head(1):
        raise ValueError("a node has more than one parent")
    ends = edges.select("tumour", F.explode(F.array("parent", "child")).alias("node"))
    if ends.groupBy("node").agg(F.min("tumour").alias("a"), F.max("tumour").alias("b")).filter("a <> b").head(1):
        raise ValueError("a label occurs in more than one tree")


def to_roots(edges: DataFrame) -> DataFrame:
    """(tumour, node, root, depth): every node that isn't a root, with each root above it and the fewest steps to that.

    A node may have several parents. A cycle is a ValueError: no path is longer than there are nodes.
    """
    tops = roots(edges).select("tumour", F.col("node").alias("anc"), F.lit(True).alias("done"))
    ups = edges.select("tumour", F.col("child").alias("node"), F.col("parent").alias("anc")).distinct()
    state = settled(ups.join(tops, ["tumour", "anc"], "left").select("tumour", "node", "anc", F.lit(1).alias("depth"), F.coalesce("done", F.lit(False)).alias("done")))
    longest, reach = state.select("tumour", "node").distinct().count(), 1
    while not state.filter("not done").isEmpty():
        if reach > longest:
            raise ValueError("the edges have a cycle")
        hop = state.select("tumour", F.col("node").alias("anc"), F.col("anc").alias("_to"), F.col("depth").alias("_more"), F.col("done").alias("_end"))
        far = state.filter("not done").join(hop, ["tumour", "anc"])
        far = far.select("tumour", "node", F.col("_to").alias("anc"), (F.col("depth") + F.col("_more")).alias("depth"), F.col("_end").alias("done"))
        # ways of one length to one ancestor are one way
        state = state.filter("done").unionByName(far).groupBy("tumour", "node", "anc", "done").agg(F.min("depth").alias("depth"))
        state, reach = settled(state), 2 * reach
    return state.select("tumour", "node", F.col("anc").alias("root"), "depth")


def depths(edges: DataFrame) -> DataFrame:
    """(tumour, node, depth): every node once, with the fewest steps from a root."""
    below = to_roots(edges).groupBy("tumour", "node").agg(F.min("depth").alias("depth"))
    return roots(edges).withColumn("depth", F.lit(0)).unionByName(below)


def path_sums(values: DataFrame, names: list[str]) -> DataFrame:
    """From (tumour, node, parent, *names), (tumour, node, *names): each summed over a node and all its ancestors."""
    state = settled(values.select("tumour", "node", F.col("parent").alias("anc"), *names))
    while not state.filter("anc is not null").isEmpty():
        hop = state.select("tumour", F.col("node").alias("anc"), F.col("anc").alias("_to"), *[F.col(n).alias(f"_{n}") for n in names])
        far = state.join(hop, ["tumour", "anc"], "left")
        more = [(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in names]
        state = settled(far.select("tumour", "node", F.col("_to").alias("anc"), *more))
    return state.drop("anc")


def subtree_sums(values: DataFrame, name: str) -> DataFrame:
    """From (tumour, node, parent, name), (tumour, node, name): summed over a node and all its descendants."""
    state = settled(values.select("tumour", "node", F.col("parent").alias("anc"), name))
    while not (live := state.filter("anc is not null")).isEmpty():
        given = live.groupBy("tumour", F.col("anc").alias("node")).agg(F.sum(name).alias("_given"))
        hop = live.select("tumour", F.col("node").alias("anc"), F.col("anc").alias("_to"))
        far = state.join(given, ["tumour", "node"], "left").join(hop, ["tumour", "anc"], "left")
        state = settled(far.select("tumour", "node", F.col("_to").alias("anc"), (F.col(name) + F.coalesce("_given", F.lit(0))).alias(name)))
    return state.drop("anc")


def intervals(edges: DataFrame) -> DataFrame:
    """(tumour, node, parent, length, depth, size, nth, entry, exit) of every node of a forest.

    A walk through a tree's nodes, parents before children and those in order of their labels, meets ``node`` at ``entry``, from 0,
    and its descendants up to ``exit``; it is its parent's ``nth`` child, from 0. Several roots of a tumour follow each
    other. Nodes with two parents and cycles are ValueErrors.
    """
    if in_degrees(edges.select("tumour", "child"), "tumour").filter("in_degree > 1").head(1):
        raise ValueError("a node has more than one parent")
    depth = depths(edges)  # a cycle is an error here
    every = settled(nodes(edges))
    sizes = subtree_sums(every.withColumn("size", F.lit(1).cast("long")), "size")
    beside = every.join(sizes, ["tumour", "node"]).withColumn("_top", F.col("parent").isNull()).withColumn("_up", F.coalesce("parent", F.lit("")))
    beside = running(beside, ["tumour", "_top", "_up"], ["node"], {"_sizes": F.col("size"), "_nth": F.lit(1)})
    # on the way down to a node: one step each, and past all that elder brothers and sisters hold
    placed = settled(beside.withColumn("_steps", F.col("_sizes") - F.col("size") + F.when(F.col("_top"), 0).otherwise(1)))
    entry = path_sums(placed.select("tumour", "node", "parent", F.col("_steps").alias("entry")), ["entry"])
    both = placed.join(entry, ["tumour", "node"]).join(depth, ["tumour", "node"])
    return both.select(
        "tumour", "node", "parent", "length", "depth", "size", (F.col("_nth") - 1).alias("nth"), "entry", (F.col("entry") + F.col("size") - 1).alias("exit")
    )


def within(placed: DataFrame, values: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """(tumour, node[, by], value): of each of ``placed`` (tumour, node[, by], entry, exit), the sum of ``value`` over the
    ``values`` (tumour[, by], entry, value) that lie in its interval, by differences of running sums."""
    keys = ["tumour", *([by] if by else [])]
    zero = F.lit(0).cast("long")
    # at one place values come before the end of an interval, and after its begin
    marks = placed.select(*keys, "node", F.explode(F.array(F.struct(F.col("entry").alias("at"), F.lit(0).alias("turn")), F.struct(F.col("exit").alias("at"), F.lit(2).alias("turn")))).alias("m"))
    marks = marks.select(*keys, "node", "m.at", "m.turn", zero.alias("value"))
    given = values.select(*keys, F.lit(None).cast("string").alias("node"), F.col("entry").alias("at"), F.lit(1).alias("turn"), F.col(value).cast("long").alias("value"))
    upto = running(marks.unionByName(given), keys, ["at", "turn"], {"upto": F.col("value")}).filter("node is not null")
    ends = F.sum(F.when(F.col("turn") == 2, F.col("upto")).otherwise(-F.col("upto")))
    return upto.groupBy(*keys, "node").agg(ends.alias(value))


def by_depth(found: DataFrame) -> DataFrame:
    """(depth, n_nodes, node): every node with the number of nodes of its level; no level is gathered."""
    sizes = found.groupBy("depth").agg(F.count("*").alias("n_nodes"))
    return found.join(sizes, "depth").select("depth", "n_nodes", "node")


def union(*forests: DataFrame) -> DataFrame:
    """One forest; nodes with one label are one node, which keeps its parent in the first of the forests that have it (the
    first by tumour and label, if that has several)."""
    both = None
    for turn, f in enumerate(forests):
        f = f.withColumn("_turn", F.lit(turn))
        both = f if both is None else both.unionByName(f)
    names = [c for c in both.columns if c != "child"]
    first = both.groupBy("child").agg(F.min(F.struct("_turn", "tumour", "parent", *[c for c in names if c not in ("_turn", "tumour", "parent")])).alias("e"))
    return first.select(*[F.col("child") if c == "child" else F.col(f"e.{c}") for c in forests[0].columns])


def topological(found: DataFrame) -> DataFrame:
    """(..., position): parents before children, by depth, then label; numbered without gathering the forest."""
    return positions(found.withColumn("_all", F.lit(0)), "_all", ["depth", "node"]).drop("_all")
