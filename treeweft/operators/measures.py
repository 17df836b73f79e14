"""Measures over channels: what a signature can be drawn from. Draws are keyed, so that asking twice gives the same."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeweft.functions.rng import uniform
from treeweft.operators.sticks import atoms, pick, tree_draws


class Measure(ABC):
    """A probability measure over signatures; a base class for those of one's own."""

    @abstractmethod
    def sample(self, draws: DataFrame) -> DataFrame:
        """(node, draw, channel, p) for each row (node, draw): a signature, whose p sum to 1."""


class DirichletPrior(Measure):
    """Each draw is a signature of its own, from a symmetric Dirichlet."""

    def __init__(self, channels: int = 96, concentration: float = 0.5, stream: str = "prior"):
        self.channels, self.concentration, self.stream = channels, concentration, stream

    def sample(self, draws: DataFrame) -> DataFrame:
        rows = draws.select("node", "draw", F.concat_ws("|", F.col("node").cast("string"), F.col("draw").cast("string")).alias("k"))
        return rows.join(atoms(rows.select("k").distinct(), self.channels, self.stream, self.concentration), "k").drop("k")


class DirichletProcess(Measure):
    """Each node has atoms from ``base`` with the weights of a broken stick; draws of a node share atoms, those of
    different nodes don't: a ``TreeProcess`` is for nodes that share their parent's."""

    def __init__(self, base: Measure, alpha: float, stream: str = "process"):
        self.base, self.alpha, self.stream = base, alpha, stream

    def sample(self, draws: DataFrame) -> DataFrame:
        picked = pick(draws.select("node", "draw", uniform(self.stream, F.col("node"), F.col("draw")).alias("u")), self.alpha, f"{self.stream}-stick")
        own = self.base.sample(picked.select("node", F.col("k").alias("draw")).distinct())
        return picked.join(own.withColumnRenamed("draw", "k"), ["node", "k"]).select("node", "draw", "channel", "p")


class TreeProcess(Measure):
    """The nodes of a forest (node, parent, depth): atoms of roots come from ``base``, those of others are draws of their
    parent's process, so that relatives share signatures."""

    def __init__(self, base: Measure, alpha: float, forest: DataFrame, stream: str = "tree"):
        self.base, self.alpha, self.forest, self.stream = base, alpha, forest, stream

    def sample(self, draws: DataFrame) -> DataFrame:
        picked = tree_draws(self.forest, draws.select("node", "draw"), self.alpha, self.stream)
        own = self.base.sample(picked.select(F.col("root").alias("node"), F.col("k").alias("draw")).distinct())
        both = picked.join(own.select(F.col("node").alias("root"), F.col("draw").alias("k"), "channel", "p"), ["root", "k"])
        return both.select("node", "draw", "channel", "p")
