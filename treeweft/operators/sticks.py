"""Stick breaking with keyed draws: weights, atoms and draws from a Dirichlet process."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeweft.functions.rng import beta_one, exponential, uniform
from treeweft.plans.lineage import settled


def sticks(ids: DataFrame, pieces: int, alpha: float, stream: str = "stick") -> DataFrame:
    """(node, k, weight, cum_lo, cum_hi): the first ``pieces`` pieces of each node's stick."""
    order = Window.partitionBy("node").orderBy("k")
    rows = broken(ids, F.lit(pieces), alpha, stream)
    high = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("node", "k", "weight", (high - F.col("weight")).alias("cum_lo"), high.alias("cum_hi"))


def broken(ids: DataFrame, pieces: Column, alpha: float, stream: str) -> DataFrame:
    """(node, k, weight, rest, rest_after): each piece and how much of the stick is left before and after it."""
    rows = ids.withColumn("k", F.explode(F.sequence(F.lit(0), pieces - 1)))
    rows = rows.withColumn("v", beta_one(alpha, stream, F.col("node"), F.col("k")))
    before = Window.partitionBy("node").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("rest", F.exp(F.coalesce(F.sum(F.ln(1 - F.col("v"))).over(before), F.lit(0.0))))
    return rows.select("node", "k", (F.col("v") * F.col("rest")).alias("weight"), "rest", (F.col("rest") * (1 - F.col("v"))).alias("rest_after"))


def heaviest(ids: DataFrame, most: int, alpha: float, stream: str = "stick") -> DataFrame:
    """(node, k, weight): the ``most`` largest of all pieces of each node's stick, the later of equal ones first.

    Sticks are broken, in twice as many pieces each time, until what is left is smaller than the last of these.
    """
    need, pieces, found = settled(ids.select("node").distinct()), 16, None
    order = Window.partitionBy("node").orderBy(F.col("weight").desc(), F.col("k").desc())
    while not need.isEmpty():
        rows = broken(need, F.lit(pieces), alpha, stream).withColumn("left", F.min("rest_after").over(Window.partitionBy("node")))
        top = settled(rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most))
        done = top.groupBy("node").agg(F.min("weight").alias("w"), F.max("left").alias("left"), F.count("*").alias("n"))
        done = done.filter((F.col("n") == most) & (F.col("left") < F.col("w"))).select("node")
        here = top.join(done, "node", "left_semi").select("node", "k", "weight")
        found = here if found is None else found.unionByName(here)
        need, pieces = settled(need.join(done, "node", "left_anti")), 2 * pieces
    return ids.select("node", F.lit(0).alias("k"), F.lit(0.0).alias("weight")).limit(0) if found is None else found


def pick(draws: DataFrame, alpha: float, stream: str = "stick") -> DataFrame:
    """(node, draw, k): the piece in which each (node, draw, u) falls; u lies in [0, 1).

    Sticks are broken until what is left of them is less than what lies above their node's largest u: pieces are
    doubled for the nodes that need more, and what is left falls geometrically. Draws meet pieces by what is left of
    the stick, which stays exact where sums of weights come close to 1.
    """
    need = settled(draws.groupBy("node").agg(F.min(1 - F.col("u")).alias("above")))
    pieces, found = 16, None
    while not need.isEmpty():
        rows = broken(need.select("node"), F.lit(pieces), alpha, stream)
        enough = rows.groupBy("node").agg(F.min("rest_after").alias("left"))
        enough = settled(need.join(enough, "node"))
        done = rows.join(enough.filter("left < above").select("node"), "node", "left_semi")
        found = done if found is None else found.unionByName(done)
        need = enough.filter("left >= above").select("node", "above")
        pieces *= 2
    if found is None:
        return draws.select("node", "draw", F.lit(0).alias("k")).limit(0)
    above = 1 - draws["u"]
    both = draws.join(found, (draws["node"] == found["node"]) & (above <= found["rest"]) & (above > found["rest_after"]))
    return both.select(draws["node"], "draw", "k")


def tree_draws(forest: DataFrame, draws: DataFrame, alpha: float, stream: str = "tree") -> DataFrame:
    """(node, draw, root, k) of (node, draw): draws from processes whose atoms are draws of their parent's process.

    ``forest`` holds (node, parent, depth) of all nodes; labels are unique. Each node breaks one stick, whoever asks. Piece k of a
    node below a root stands for one draw of its parent, keyed by the two, so that all draws that fall into that piece are
    one atom, and nodes whose pieces fall into one piece further up share it. Piece k of a root is an atom of its own: what
    is returned is which. Requests go up level by level, each asked once, and answers come down: one join a level each way.
    """
    asked = settled(draws.join(forest, "node").select("node", "depth", F.concat_ws("|", F.lit("draw"), "draw").alias("key"), "draw"))
    ups = forest.select("node", "parent")
    above, levels = None, []
    deepest = asked.agg(F.max("depth")).head()[0]
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        here = asked.filter(F.col("depth") == depth).select("node", "key")
        here = here if above is None else here.unionByName(above)
        picked = pick(here.select("node", F.col("key").alias("draw"), uniform(stream, F.col("node"), F.col("key")).alias("u")), alpha, f"{stream}-stick")
        wanted = F.concat_ws("|", F.lit("atom"), "node", "k").alias("wanted")
        levels.append(settled(picked.join(ups, "node").select("node", "parent", F.col("draw").alias("key"), "k", wanted)))
        above = levels[-1].filter("parent is not null").select(F.col("parent").alias("node"), F.col("wanted").alias("key")).distinct()
    known = found = None
    for level in reversed(levels):
        here = level.filter("parent is null").select("node", "key", F.col("node").alias("root"), "k")
        if known is not None:
            up = known.select(F.col("node").alias("parent"), F.col("key").alias("wanted"), "root", F.col("k").alias("_k"))
            here = here.unionByName(level.join(up, ["parent", "wanted"]).select("node", "key", "root", F.col("_k").alias("k")))
        known = settled(here)
        found = known if found is None else found.unionByName(known)
    if found is None:
        return asked.select("node", "draw", F.col("node").alias("root"), F.lit(0).alias("k"))
    return asked.join(found, ["node", "key"]).select("node", "draw", "root", "k")


def atoms(ks: DataFrame, channels: int, stream: str = "atom", concentration: float = 1.0) -> DataFrame:
    """(k, channel, p): for each row (k) a draw of a symmetric Dirichlet, whose concentration is a multiple of a half.

    A gamma variate of shape 1 is exponential; one of shape 1/2 is half the square of a normal variate.
    """
    halves = round(2 * concentration)
    if halves < 1 or halves != 2 * concentration:
        raise ValueError("concentrations are positive multiples of 0.5")
    rows = ks.select("k", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel"))
    key = (stream, F.col("k"), F.col("channel"))
    whole = [exponential(*key, *([i] if i else [])) for i in range(halves // 2)]
    turn = F.cos(2 * math.pi * uniform(*key, "turn"))
    half = [exponential(*key, "size") * turn * turn] if halves % 2 else []
    rows = rows.withColumn("g", sum(half, sum(whole[1:], whole[0])) if whole else half[0])
    return rows.withColumn("p", F.col("g") / F.sum("g").over(Window.partitionBy("k"))).drop("g")


def sample(ids: DataFrame, draws: int, alpha: float) -> DataFrame:
    """(node, draw, k): ``draws`` draws from each node's process."""
    rows = ids.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return pick(rows.withColumn("u", uniform("pick", F.col("node"), F.col("draw"))), alpha)


def poisson(means: DataFrame, stream: str = "arrival") -> DataFrame:
    """(node, n) of (node, mean): how many arrivals with exponential gaps come up to the mean.

    Gaps are drawn in rows, twice the mean and some at first; the nodes whose arrivals end before their mean get double.
    """
    need = settled(means.select("node", "mean", F.ceil(2 * F.col("mean") + 16).cast("int").alias("size")))
    order = Window.partitionBy("node").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    found = None
    while found is None or not need.isEmpty():
        gaps = need.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
        times = gaps.withColumn("t", F.sum(exponential(stream, F.col("node"), F.col("i"))).over(order))
        counted = times.groupBy("node", "mean", "size").agg(F.count_if(F.col("t") <= F.col("mean")).alias("n"), F.max("t").alias("last"))
        counted = settled(counted)
        done = counted.filter("last > mean").select("node", "n")
        found = done if found is None else found.unionByName(done)
        need = counted.filter("last <= mean").select("node", "mean", (F.col("size") * 2).alias("size"))
    return found


def multinomial(totals: DataFrame, signatures: DataFrame, stream: str = "mutation") -> DataFrame:
    """(node, channel, n): each of a node's n mutations falls on a channel of its signature k; 0 is left out."""
    rows = totals.filter("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    draws = rows.select("node", F.col("i").alias("draw"), "k", uniform(stream, F.col("node"), F.col("i")).alias("u"))
    return channel_of(signatures, draws).groupBy("node", "channel").agg(F.count("*").alias("n"))


def sample_channel(signatures: DataFrame, draws: DataFrame, stream: str = "channel") -> DataFrame:
    """(node, draw, k, channel): one categorical channel of each draw's signature, by its running sums."""
    return channel_of(signatures, draws.withColumn("u", uniform(stream, F.col("node"), F.col("draw"), F.col("k"))))


def channel_of(signatures: DataFrame, draws: DataFrame) -> DataFrame:
    """(node, draw, k, channel) of (node, draw, k, u): where u falls among the running sums of signature k."""
    order = Window.partitionBy("k").orderBy("channel").rowsBetween(Window.unboundedPreceding, 0)
    sums = signatures.withColumn("hi", F.sum("p").over(order)).withColumn("lo", F.col("hi") - F.col("p"))
    sums = sums.select(F.col("k").alias("_k"), "channel", "lo", "hi")
    both = draws.join(sums, (draws["k"] == sums["_k"]) & (draws["u"] >= sums["lo"]) & (draws["u"] < sums["hi"]))
    return both.select("node", "draw", "k", "channel")


def synthesise(ks: DataFrame, correlation: float, channels: int = 96) -> DataFrame:
    """(k, channel, p) for each row (k): a shared and an own flat Dirichlet row, mixed by ``correlation``, to the power 1.5."""
    if not 0 <= correlation <= 1:
        raise ValueError("the correlation lies between 0 and 1")
    base = atoms(ks.sparkSession.range(1).select(F.lit(0).alias("k")), channels, "base").select("channel", F.col("p").alias("b"))
    rows = atoms(ks, channels, "own").join(F.broadcast(base), "channel")
    rows = rows.withColumn("m", F.pow(correlation * F.col("b") + (1 - correlation) * F.col("p"), 1.5))
    return rows.select("k", "channel", (F.col("m") / F.sum("m").over(Window.partitionBy("k"))).alias("p"))


def zero_subset(components: DataFrame, sparsity: float, stream: str = "mask") -> DataFrame:
    """(k, active): min(round(sparsity*K), K-1) components, those with the smallest keyed draws, are off."""
    if not 0 <= sparsity < 1:
        raise ValueError("the sparsity lies in [0, 1)")
    everywhere = Window.partitionBy(F.lit(0))
    n = F.count("*").over(everywhere)
    rank = F.row_number().over(everywhere.orderBy(uniform(stream, F.col("k")), "k"))
    off = F.least(F.bround(F.lit(float(sparsity)) * n), n - 1)
    return components.select("k", (rank > off).alias("active"))


def dropout(rows: DataFrame, rate: float) -> DataFrame:
    """(node, k, e, kept): each active component of a node goes off at ``rate``; if all would, one is left on.

    A node with one active component keeps it.
    """
    node = Window.partitionBy("node")
    on = F.col("e") > 0
    survives = on & (uniform("drop", F.col("node"), F.col("k")) >= rate)
    rows = rows.withColumn("_on", on).withColumn("_s", survives)
    rows = rows.withColumn("_n", F.count_if("_on").over(node)).withColumn("_left", F.count_if("_s").over(node))
    lucky = F.row_number().over(node.orderBy(F.col("_on").desc(), uniform("revive", F.col("node"), F.col("k")), "k")) == 1
    kept = F.when(F.col("_n") <= 1, F.col("_on")).when(F.col("_left") == 0, F.col("_on") & F.col("_lucky")).otherwise(F.col("_s"))
    return rows.withColumn("_lucky", lucky).select("node", "k", "e", kept.alias("kept"))
