"""Forward simulation: random forests, activities that descend along them, and mutation counts.

Trees are independent, so a tree is the unit of work: a group of nodes in one task. Every node's numbers come from a
generator seeded by (seed, tumour, label), so results do not depend on partitioning, and asking twice gives the
same data.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeweft.functions.rng import STEPS, uniform_int
from treeweft.operators.tree import nodes

NODE = "tumour int, node string, parent string, length double, is_root boolean, num_mutations bigint, e array<double>"
FLOOR = 1e-12


def generator(seed: int, *key) -> np.random.Generator:
    return np.random.default_rng([seed, *(zlib.crc32(str(k).encode()) for k in key)])


def keyed(*key) -> float:
    """The number in (0, 1) that rng.uniform gives for the key."""
    return (int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:13], 16) + 0.5) / STEPS


def random_forest(
    spark: SparkSession, num_trees: int, min_leaves: int, max_leaves: int, seed: int, min_branch=100, max_branch=3000
) -> DataFrame:
    """Edges of random binary trees: a leaf at random splits until the number of leaves is reached.

    Labels are T<tree>_<i>, from 1, parents before children; lengths are whole numbers, both ends included. All draws
    are keyed.
    """
    return grown_forest(spark.range(num_trees), min_leaves, max_leaves, seed, min_branch, max_branch)


def grown_forest(trees: DataFrame, min_leaves: int, max_leaves: int, seed: int, min_branch=100, max_branch=3000) -> DataFrame:
    """The edges of a tree for each row (id)."""
    if not 1 <= min_leaves <= max_leaves or min_branch > max_branch:
        raise ValueError("bounds are the wrong way round")

    def grow(frames):
        for frame in frames:
            rows = []
            for t in frame["id"].tolist():
                leaves, made = [0], 1
                for step in range(min_leaves + int(keyed("leaves", seed, t) * (max_leaves - min_leaves + 1)) - 1):
                    at = leaves.pop(int(keyed("split", seed, t, step) * len(leaves)))
                    rows += [(t, f"T{t + 1}_{at + 1}", f"T{t + 1}_{i + 1}") for i in (made, made + 1)]
                    leaves += [made, made + 1]
                    made += 2
            yield pd.DataFrame(rows, columns=["tumour", "parent", "child"])

    edges = trees.select(F.col("id").cast("long").alias("id")).mapInPandas(grow, "tumour int, parent string, child string")
    far = uniform_int(min_branch, max_branch, "branch", str(seed), F.col("child"))
    return edges.withColumn("length", far.cast("double"))


def baseline(size: int, alpha_0: float, sparsity: float, seed: int) -> np.ndarray:
    """A draw of Dir(alpha_0/size) on what is left after min(round(sparsity*size), size-1) components go off."""
    if not 0 <= sparsity < 1:
        raise ValueError("the sparsity lies in [0, 1)")
    rng = generator(seed, "baseline")
    off = rng.permutation(size)[: min(round(sparsity * size), size - 1)]
    on = np.setdiff1d(np.arange(size), off)
    e = np.zeros(size)
    e[on] = dirichlet(rng, np.full(len(on), alpha_0 / size))
    return e


def dirichlet(rng: np.random.Generator, concentration: np.ndarray) -> np.ndarray:
    """Stays a point of the simplex where all gamma draws of small concentrations would be 0."""
    c = np.maximum(concentration, FLOOR)
    # log of a gamma draw: that of shape c+1, and a power of a uniform
    logs = np.log(rng.standard_gamma(c + 1)) + np.log(rng.uniform(size=len(c)).clip(1e-300)) / c
    p = np.exp(logs - logs.max())
    return p / p.sum()


def child_activity(rng: np.random.Generator, parent: np.ndarray, alpha: float, dropout: float) -> np.ndarray:
    """A draw around the parent on its support; components that are off stay off in all descendants."""
    on = np.flatnonzero(parent > 0)
    if dropout > 0 and len(on) > 1:
        kept = on[rng.uniform(size=len(on)) >= dropout]
        on = kept if len(kept) else on[[int(rng.integers(len(on)))]]
    e = np.zeros(len(parent))
    e[on] = dirichlet(rng, alpha * parent[on])
    return e


def count(rng: np.random.Generator, mean: float, dispersion: float | None) -> int:
    """Poisson, or with a dispersion r negative binomial of variance mean*(1 + mean/r)."""
    if mean <= 0:
        return 0
    return int(rng.poisson(mean if dispersion is None else rng.gamma(dispersion, mean / dispersion)))


def simulate(
    edges: DataFrame, e0: np.ndarray, alpha: float = 1.0, lam: float = 1000.0, dispersion: float | None = 2.0,
    dropout: float = 0.0, seed: int = 42,
) -> DataFrame:
    """The truth of every node: NODE columns. A root's mean count is ``lam``, another's its branch length."""

    def tree(frame: pd.DataFrame) -> pd.DataFrame:
        below: dict[str, list[int]] = {}
        rows = frame.sort_values("node").to_dict("records")
        for i, r in enumerate(rows):
            below.setdefault(r["parent"] if isinstance(r["parent"], str) else "", []).append(i)
        out, wait = [], [(i, e0) for i in below.get("", [])]
        while wait:
            i, up = wait.pop(0)
            r = rows[i]
            root = not isinstance(r["parent"], str)
            rng = generator(seed, r["tumour"], r["node"])
            e = child_activity(rng, up, alpha, 0.0 if root else dropout)
            n = count(rng, lam if root else float(r["length"] or 0), dispersion)
            out.append((r["tumour"], r["node"], None if root else r["parent"], None if root else r["length"], root, n, e.tolist()))
            wait += [(j, e) for j in below.get(r["node"], [])]
        return pd.DataFrame(out, columns=["tumour", "node", "parent", "length", "is_root", "num_mutations", "e"])

    return nodes(edges).groupBy("tumour").applyInPandas(tree, NODE)


def count_matrix(truth: DataFrame, signatures: np.ndarray, seed: int = 42) -> DataFrame:
    """(node, channel, n): multinomial counts of e times the signatures; nodes without mutations are left out."""

    def draw(frames):
        for frame in frames:
            nodes_, channels, ns = [], [], []
            for t, node, m, e in zip(frame["tumour"], frame["node"], frame["num_mutations"], frame["e"], strict=True):
                p = np.asarray(e) @ signatures
                x = generator(seed, "counts", t, node).multinomial(int(m), p / p.sum())
                nodes_ += [node] * len(x)
                channels += range(len(x))
                ns += x.tolist()
            yield pd.DataFrame({"node": nodes_, "channel": channels, "n": ns})

    seen = truth.filter(F.col("num_mutations") > 0).select("tumour", "node", "num_mutations", "e")
    return seen.mapInPandas(draw, "node string, channel int, n bigint")


def summary(truth: DataFrame, size: int, true_size: int, alpha: float) -> DataFrame:
    m = F.col("num_mutations")
    zero = F.lit(0)
    return truth.agg(
        F.count_distinct("tumour").alias("n_tumours"), F.count("*").alias("n_nodes_total"),
        F.count_if(m > 0).alias("n_nodes_observed"), F.lit(size).alias("K"), F.lit(true_size).alias("true_K"),
        F.lit(float(alpha)).alias("alpha"), F.coalesce(F.avg(m), F.lit(0.0)).alias("mean_mutations"),
        F.coalesce(F.min(m), zero).alias("min_mutations"), F.coalesce(F.max(m), zero).alias("max_mutations"),
    )


def check_signatures(matrix: np.ndarray, channels: int = 96) -> None:
    if matrix.ndim != 2 or matrix.shape[1] != channels:
        raise ValueError(f"signatures are rows of {channels} channels")
    if not np.allclose(matrix.sum(axis=1), 1, atol=1e-6):
        raise ValueError("a signature does not sum to 1")
    if (matrix < 0).any():
        raise ValueError("a signature has a negative entry")
