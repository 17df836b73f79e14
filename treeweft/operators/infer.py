"""Bayesian activities on a forest with fixed signatures: a logistic-normal walk, sampled with NUTS.

Each root's free logits are N(0, sigma_0^2); a child's are its parent's plus sigma times standard normal steps; the
last logit is 0. Counts are multinomial with profile e times the signatures. Chains are independent: one a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

DRAWS = "var string, chain int, draw int, node string, k int, value double"

# priors of a positive number: log density and its slope, without constants
PRIORS = {
    "LogNorm": lambda x, mu, s: (-np.log(x) - (np.log(x) - mu) ** 2 / (2 * s * s), -1 / x - (np.log(x) - mu) / (s * s * x)),
    "HalfNorm": lambda x, s: (-x * x / (2 * s * s), -x / (s * s)),
    "Exp": lambda x, rate: (-rate * x, -rate),
    "Gamma": lambda x, a, b: ((a - 1) * np.log(x) - b * x, (a - 1) / x - b),
    "Norm": lambda x, mu, s: (-((x - mu) ** 2) / (2 * s * s), -(x - mu) / (s * s)),
    "Beta": lambda x, a, b: ((a - 1) * np.log(x) + (b - 1) * np.log1p(-x), (a - 1) / x - (b - 1) / (1 - x)),
}


def prior(name: str):
    """A registered prior of a positive number by name, None for a fixed one; KeyError for others, as for those of
    vectors."""
    return None if name == "Fixed" else PRIORS[name]


class TreeModel:
    """log density and slope over (log sigma, root logits, steps); parents stand before children."""

    def __init__(self, labels, parents, counts, signatures, sigma_prior=("LogNorm", 0.0, 1.0), sigma_0=1.0):
        self.labels, self.parents = list(labels), np.asarray(parents, dtype=np.int64)
        self.x, self.s, self.sigma_0 = np.asarray(counts, dtype=float), np.asarray(signatures, dtype=float), sigma_0
        self.n, self.free = len(self.labels), self.s.shape[0] - 1
        self.root = self.parents < 0
        self.prior, self.args = prior(sigma_prior[0]), sigma_prior[1:]
        depth = np.zeros(self.n, dtype=np.int64)
        for i, p in enumerate(self.parents):
            if p >= i:
                raise ValueError("parents stand before children")
            depth[i] = 0 if p < 0 else depth[p] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]
        self.seen = self.x.sum(axis=1) > 0
        self.size = 1 + self.n * self.free

    def walk(self, theta):
        sigma = np.exp(theta[0]) if self.prior else self.args[0]
        z = theta[1:].reshape(self.n, self.free)
        eta = np.where(self.root[:, None], z, sigma * z)
        for level in self.levels:
            eta[level] += eta[self.parents[level]]
        full = np.concatenate([eta, np.zeros((self.n, 1))], axis=1)
        full = np.exp(full - full.max(axis=1, keepdims=True))
        return sigma, z, full / full.sum(axis=1, keepdims=True)

    def logp_grad(self, theta):
        sigma, z, e = self.walk(theta)
        p = np.maximum(e @ self.s, 1e-300)
        seen = self.seen[:, None]
        pull = np.where(seen, (self.x / p) @ self.s.T, 0.0)
        total = np.where(self.seen, self.x.sum(axis=1), 0.0)
        g = (e * (pull - total[:, None]))[:, :-1]
        for level in reversed(self.levels):
            np.add.at(g, self.parents[level], g[level])
        r = self.root[:, None]
        var0 = self.sigma_0**2
        dz = np.where(r, g - z / var0, sigma * g - z)
        if self.prior is None:  # nothing depends on the first number, which is standard normal
            value = (np.where(seen, self.x * np.log(p), 0.0)).sum() - (np.where(r, z * z / var0, z * z)).sum() / 2 - theta[0] ** 2 / 2
            return float(value), np.concatenate([[-theta[0]], dz.ravel()])
        lp, slope = self.prior(sigma, *self.args)
        value = (np.where(seen, self.x * np.log(p), 0.0)).sum() - (np.where(r, z * z / var0, z * z)).sum() / 2 + lp + theta[0]
        dsigma = (np.where(r, 0.0, z * g)).sum() + slope
        return float(value), np.concatenate([[sigma * dsigma + 1], dz.ravel()])


def nuts(model, rng, draws: int, tune: int, target: float = 0.95, max_depth: int = 10):
    """Draws of theta: multinomial no-U-turn sampling, dual averaging of the step, diagonal mass from tuning."""
    theta = 0.1 * rng.standard_normal(model.size)
    value, slope = model.logp_grad(theta)
    mass = np.ones(model.size)
    step, out = 0.1, []
    log_avg, h_bar, mu, age = 0.0, 0.0, np.log(1.0), 0
    mean, square, seen = np.zeros(model.size), np.zeros(model.size), 0

    def leap(q, p, g, eps):
        p = p + eps / 2 * g
        q = q + eps * p / mass
        v, g = model.logp_grad(q)
        return q, p + eps / 2 * g, v, g

    def tree(q, p, g, sign, depth, start):
        if depth == 0:
            q, p, v, g = leap(q, p, g, sign * step)
            energy = v - (p * p / mass).sum() / 2
            gap = energy - start if np.isfinite(energy) else -np.inf
            ok = gap > -1000
            return [(q, p, g), (q, p, g), (q, v, g), gap, ok, min(1.0, np.exp(min(gap, 0.0))), 1]
        one = tree(q, p, g, sign, depth - 1, start)
        if not one[4]:
            return one
        two = tree(*(one[1] if sign > 0 else one[0]), sign, depth - 1, start)
        ends = (one[0], two[1]) if sign > 0 else (two[0], one[1])
        weight = np.logaddexp(one[3], two[3])
        pick = two[2] if np.log(rng.uniform()) < two[3] - weight else one[2]
        return [*ends, pick, weight, two[4] and straight(*ends), one[5] + two[5], one[6] + two[6]]

    def straight(a, b):
        span = b[0] - a[0]
        return span @ a[1] > 0 and span @ b[1] > 0

    for it in range(tune + draws):
        p = rng.standard_normal(model.size) * np.sqrt(mass)
        start = value - (p * p / mass).sum() / 2
        left = right = (theta, p, slope)
        weight, accept, n = 0.0, 0.0, 0
        for depth in range(max_depth):
            sign = 1 if rng.uniform() < 0.5 else -1
            grown = tree(*(right if sign > 0 else left), sign, depth, start)
            left, right = (left, grown[1]) if sign > 0 else (grown[0], right)
            accept, n = accept + grown[5], n + grown[6]
            if not grown[4]:
                break
            if np.log(rng.uniform()) < grown[3] - weight:
                theta, value, slope = grown[2]
            weight = np.logaddexp(weight, grown[3])
            if not straight(left, right):
                break
        if it < tune:
            age += 1
            eta = 1 / (age + 10)
            h_bar = (1 - eta) * h_bar + eta * (target - accept / max(n, 1))
            log_step = mu - np.sqrt(age) / 0.05 * h_bar
            fade = age**-0.75
            log_avg = fade * log_step + (1 - fade) * log_avg
            step = float(np.exp(np.clip(log_step, -15, 2)))
            if it >= tune // 4:
                seen += 1
                gap = theta - mean
                mean = mean + gap / seen
                square = square + gap * (theta - mean)
            if it in (tune // 2, 3 * tune // 4) and seen > 10:
                var = square / (seen - 1)
                mass = 1 / (var * seen / (seen + 5) + 1e-3 * 5 / (seen + 5))
                mu, h_bar, log_avg, age = np.log(10 * step), 0.0, np.log(step), 0
            if it == tune - 1:
                step = float(np.exp(log_avg))
        else:
            out.append(theta)
    return np.array(out).reshape(-1, model.size)


def fit(
    spark: SparkSession, model: TreeModel, draws: int = 1000, tune: int = 1000, chains: int = 4, target: float = 0.95,
    max_depth: int = 10, seed: int = 42,
) -> DataFrame:
    """DRAWS of sigma and of every node's activities e, one chain a task."""

    def run(frames):
        for frame in frames:
            for chain in frame["id"]:
                found = nuts(model, np.random.default_rng([seed, int(chain)]), draws, tune, target, max_depth)
                walks = [model.walk(theta) for theta in found]
                yield pd.DataFrame({"var": "sigma", "chain": chain, "draw": range(len(walks)), "node": None, "k": None, "value": [w[0] for w in walks]})
                e = np.array([w[2] for w in walks]).reshape(-1, model.n, model.free + 1)
                for j, label in enumerate(model.labels):
                    size = model.free + 1
                    yield pd.DataFrame({
                        "var": "e", "chain": chain, "draw": np.repeat(np.arange(len(e)), size), "node": label,
                        "k": np.tile(np.arange(size), len(e)), "value": e[:, j].ravel(),
                    })

    return spark.range(0, chains, 1, chains).mapInPandas(run, DRAWS)
