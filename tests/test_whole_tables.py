"""Queries over whole tables against brute force."""

from collections import defaultdict
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F
from treeweft.plans import domain as D
from treeweft.plans.queries import QUERIES

TABLES = "/root/testdata/sf0.001"


def best_by_trying_all(cosine):
    """By masks of the inferred labels taken: the largest sum and its labels."""
    best = {0: (0.0, ())}
    for row in cosine:
        after = {}
        for mask, (total, picks) in best.items():
            for a, c in enumerate(row):
                if not mask >> a & 1 and after.get(mask | 1 << a, (-1.0,))[0] < total + c:
                    after[mask | 1 << a] = (total + c, (*picks, a))
        best = after
    return max(best.values())[1]


@pytest.fixture(scope="module")
def sides(spark):
    found = []
    for odd in (1, 0):
        cells = {(r["k"], r["channel"]): r["p"] for r in D.vector_signatures(spark, TABLES, odd).collect()}
        labels, channels = (sorted({x[i] for x in cells}) for i in (0, 1))
        assert labels == list(range(10))
        found.append(np.array([[cells[k, c] for c in channels] for k in labels]))
    inferred, true = found
    unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (true, inferred)]
    cosine = unit[0] @ unit[1].T
    return inferred, true, cosine, best_by_trying_all(cosine)


def test_alignment_of_all_labels(spark, sides):
    inferred, true, cosine, picks = sides
    found = {r["true_k"]: (r["matched"], r["cosine"]) for r in QUERIES["align_signatures"](spark, TABLES).collect()}
    assert found == {k: (a, pytest.approx(cosine[k, a], abs=2e-6)) for k, a in enumerate(picks)}
    rows = {r["true_signature"]: r for r in QUERIES["compare_signatures"](spark, TABLES).collect()}
    assert len(rows) == 10
    for k, a in enumerate(picks):
        row = rows[f"True_Sig_{k}"]
        assert row["matched_inferred_idx"] == a and row["mae"] == pytest.approx(np.abs(true[k] - inferred[a]).mean(), abs=2e-6)


def test_figures_of_all_labels(spark, sides):
    inferred, true, cosine, picks = sides
    heat = {(r["a"], r["b"]): (r["cosine"], r["is_match"]) for r in QUERIES["cosine_heatmap"](spark, TABLES).collect()}
    assert heat == {(a, b): (pytest.approx(cosine[b, a], abs=2e-6), picks[b] == a) for a in range(10) for b in range(10)}
    grid = QUERIES["comparison_grid"](spark, TABLES).collect()
    assert {(r["true_k"], r["matched"]) for r in grid} == set(enumerate(picks)) and len(grid) == true.size
    assert all(r["true_p"] == pytest.approx(true[r["true_k"], r["channel"]], abs=2e-6) for r in grid)


def test_activities_of_all_labels(spark, sides):
    picks = sides[3]
    true, inferred = defaultdict(dict), defaultdict(dict)
    for r in D.activities(spark, TABLES).collect():
        true[r["node"]][r["k"]], inferred[r["node"]][r["k"]] = r["true_e"], r["inferred_e"]
    want = {n: np.mean([abs(true[n].get(k, 0) - inferred[n].get(a, 0)) for k, a in enumerate(picks)]) for n in true}
    found = {r["node"]: r["mae"] for r in QUERIES["compare_activities_unknown"](spark, TABLES).collect()}
    assert found == {n: pytest.approx(x, abs=2e-6) for n, x in want.items()}


def test_half_even_and_fractions_of_every_line(spark):
    want = sorted((r["l_partkey"], round(r["l_quantity"] / 4), r["l_quantity"] / 96) for r in D.table(spark, TABLES, "lineitem").collect())
    found = QUERIES["half_even_and_fractions"](spark, TABLES).collect()
    assert sorted((r["l_partkey"], r["quarter"], r["share"]) for r in found) == want


def plain_ess(x):
    """Of (chains, draws), autocovariances one lag at a time; Geyer's initial monotone sequence."""
    m, n = x.shape
    away = x - x.mean(axis=1, keepdims=True)
    acov = [np.mean([sum(c[: n - lag] * c[lag:]) / n for c in away]) for lag in range(n)]
    within = acov[0] * n / (n - 1)
    plus = within * (n - 1) / n + x.mean(axis=1).var(ddof=1)
    rho = [1.0, *(1 - (within - a) / plus for a in acov[1:])]
    kept = []
    for i in range(0, n - 1, 2):
        if rho[i] + rho[i + 1] <= 0:
            break
        kept.append(min([rho[i] + rho[i + 1], *kept[-1:]]))
    return m * n / max(2 * sum(kept) - 1, 1 / np.log10(m * n))


def plain_sizes(x):
    half = x.shape[1] // 2
    halves = np.concatenate([x[:, :half], x[:, -half:]])
    ranks = halves.ravel().argsort().argsort() + 1
    z = np.array([NormalDist().inv_cdf((r - 0.375) / (x.size + 0.25)) for r in ranks]).reshape(halves.shape)
    return plain_ess(z), min(plain_ess((halves <= np.quantile(x, q)).astype(float)) for q in (0.05, 0.95))


def test_effective_sizes_reach_the_gates(spark, monkeypatch):
    """Slowly moving chains for component 0, so that some sizes are under the gate and most are not."""
    rows = D.draws(spark, TABLES).filter("k < 3 and node < 'N12'")
    slow = F.col("value") + F.when(F.col("k") == 0, F.col("draw") * 1.0).otherwise(0.0)
    made = rows.withColumn("value", slow).toPandas()
    frame = spark.createDataFrame(made)
    monkeypatch.setattr(D, "draws", lambda spark, d: frame)
    want = {}
    for key, part in made.groupby(["node", "k"]):
        want[key] = plain_sizes(part.pivot(index="chain", columns="draw", values="value").to_numpy())
    stats = {(r["node"], r["signature"]): r for r in QUERIES["depth_stats"](spark, TABLES).collect()}
    assert {k: (r["ess_bulk"], r["ess_tail"]) for k, r in stats.items()} == {k: pytest.approx(x, abs=1e-4) for k, x in want.items()}
    low = sum(bulk < 100 for bulk, _ in want.values())
    bad = sum(r["r_hat"] > 1.01 for r in stats.values())
    gates = QUERIES["convergence_gates"](spark, TABLES).first()
    assert 0 < low < len(want) and (gates["n"], gates["n_bad_r_hat"], gates["n_low_ess"]) == (len(want), bad, low)
    assert gates["pct_low_ess"] == pytest.approx(100 * low / len(want), abs=1e-6)
    for r in QUERIES["depth_medians"](spark, TABLES).collect():
        here = [k for k, s in stats.items() if s["depth"] == r["depth"]]
        assert r["median_ess_bulk"] == pytest.approx(np.median([want[k][0] for k in here]), abs=1e-4)
        assert r["median_ess_tail"] == pytest.approx(np.median([want[k][1] for k in here]), abs=1e-4)
