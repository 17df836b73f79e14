import itertools
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeweft.functions import arrays, vectors
from treeweft.operators import assign, diagnostics, evaluate, infer, plotdata, simulate, sticks, tree
from treeweft.sources import files, newick

EDGES = "tumour int, parent string, child string, length double"


@pytest.fixture(scope="module")
def forest(spark):
    rows = [(0, "A", "B", 1.0), (0, "A", "C", 2.0), (0, "B", "D", 3.0), (0, "B", "E", 4.5), (1, "R", "S", 5.0), (1, "S", "T", 6.0)]
    return spark.createDataFrame(rows, EDGES)


def test_depths_and_roots(forest):
    found = {r["node"]: r["depth"] for r in tree.depths(forest).collect()}
    assert found == {"A": 0, "B": 1, "C": 1, "D": 2, "E": 2, "R": 0, "S": 1, "T": 2}
    assert {r["node"] for r in tree.roots(forest).collect()} == {"A", "R"}
    tree.check_forest(forest)


def test_check_forest(spark):
    with pytest.raises(ValueError):
        tree.check_forest(spark.createDataFrame([(0, "A", "C", 1.0), (0, "B", "C", 1.0)], EDGES))
    with pytest.raises(ValueError):
        tree.check_forest(spark.createDataFrame([(0, "A", "C", 1.0), (1, "B", "A", 1.0)], EDGES))


def test_newick(spark, forest):
    text = " ; ((D:3,E:4.5)B:1,C:2)A;((T:6)S:5)R; "
    found = {tuple(r) for r in newick.parse(spark.createDataFrame([(text,)], "value string")).collect()}
    assert found == {tuple(r) for r in forest.collect()}
    written = [r["newick"] for r in newick.serialise(forest).orderBy("tumour").collect()]
    assert written == ["((D:3.0,E:4.5)B:1.0,C:2.0)A;", "((T:6.0)S:5.0)R;"]
    assert newick.parse_tree("('a b':1,c)'it''s';", 0) == [(0, "it's", "a b", 1.0), (0, "it's", "c", None)]
    with pytest.raises(ValueError):
        newick.parse_tree("((a,b);", 0)


def test_empty_forest(spark):
    none = spark.createDataFrame([], EDGES)
    assert tree.depths(none).count() == 0 and newick.serialise(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(0, 2), st.integers(0, 10**6))
def test_hungarian_is_optimal(n, more, seed):
    cost = np.random.default_rng(seed).random((n, n + more)).round(2)
    found = assign.hungarian(cost)
    assert len(set(found)) == n
    best = min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(n + more), n))
    assert abs(cost[np.arange(n), found].sum() - best) < 1e-9


def test_align(spark):
    true = [[0.7, 0.1, 0.1, 0.1], [0.1, 0.7, 0.1, 0.1], [0.1, 0.1, 0.7, 0.1]]
    inferred = [true[2], [0.25] * 4, true[0], true[1]]

    def rows(m):
        return spark.createDataFrame([(k, c, float(p)) for k, r in enumerate(m) for c, p in enumerate(r)], "k int, channel int, p double")

    found = {r["true_k"]: r["matched"] for r in assign.align(rows(inferred), rows(true)).collect()}
    assert found == {0: 2, 1: 3, 2: 0}
    with pytest.raises(Exception, match="fewer inferred"):
        assign.align(rows(true[:2]), rows(true)).collect()
    pairs = assign.align(rows(inferred), rows(true))
    table = evaluate.compare_signatures(rows(inferred), rows(true), pairs).collect()
    assert len(table) == 3 and all(r["mae"] < 1e-12 and r["cosine_similarity"] > 1 - 1e-9 for r in table)


def test_scalars(spark):
    one = spark.range(1)
    row = one.select(
        arrays.fraction(F.lit("1/96")), arrays.fraction(F.lit(" 0.25")), arrays.fraction(F.lit("x")), arrays.fraction(F.lit("1/0")),
        arrays.none_to_null(F.lit("None")), arrays.gather(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(0))),
        arrays.softmax_last_zero(F.array(F.lit(800.0), F.lit(0.0))),
    ).head()
    assert row[0] == 1 / 96 and row[1] == 0.25 and row[2] is None and row[3] is None and row[4] is None
    assert row[5] == [2, 1] and row[6] == [1.0, 0.0, 0.0]


def test_constant_correlation_is_null(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0)], "g int, a double, b double")
    assert rows.groupBy("g").agg(vectors.pearson("a", "b").alias("r")).head()["r"] is None


def test_top_k_ties(spark):
    rows = spark.createDataFrame([("n", 0, 0.5), ("n", 1, 0.5), ("n", 2, 0.1)], "node string, k int, e double")
    assert [r["k"] for r in vectors.top_k(rows, "node", "e", "k", 2).orderBy("rank").collect()] == [1, 0]


def test_medians_skip_null_groups_and_nan(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, float("nan")), (0, 3.0), (None, 5.0)], "depth int, r_hat double")
    assert [tuple(r) for r in evaluate.medians(rows, "depth", ["r_hat"]).collect()] == [(0, 2.0)]


def test_node_posterior(spark):
    draws = spark.createDataFrame([(0, 0, "a", 0, 0.5), (0, 0, "b", 0, 0.1)], "chain int, draw int, node string, k int, value double")
    assert evaluate.node_posterior(draws, "a").head()["value"] == 0.5
    with pytest.raises(KeyError):
        evaluate.node_posterior(draws, "c")


def test_hdi(spark):
    x = np.random.default_rng(0).gamma(2, 1, 200)
    rows = spark.createDataFrame([("n", float(v)) for v in x], "node string, value double")
    r = evaluate.hdi(rows, "node", prob=0.9).head()
    s, span = np.sort(x), 180
    i = int(np.argmin(s[span:] - s[:-span]))
    assert (r["lo"], r["hi"]) == (s[i], s[i + span])


def plain_summary(x, prob=0.94):
    """Vehtari et al. 2021 on (chains, draws), step by step."""
    from statistics import NormalDist

    def ess(y):
        m, n = y.shape
        if n < 4 or np.ptp(y) < 1e-300:
            return float(m * n)
        dev = y - y.mean(axis=1, keepdims=True)
        acov = np.array([(dev[:, : n - t] * dev[:, t:]).sum(axis=1).mean() / n for t in range(n)])
        within = acov[0] * n / (n - 1)
        rho = 1 - (within - acov) / (acov[0] + (y.mean(axis=1).var(ddof=1) if m > 1 else 0))
        rho[0], total, least = 1.0, 0.0, np.inf
        for p in range(n // 2):
            pair = rho[2 * p] + rho[2 * p + 1]
            if pair <= 0:
                break
            least = min(least, pair)
            total += least
        return m * n / max(2 * total - 1, 1 / np.log10(m * n))

    def scores(y):
        flat = y.ravel()
        ranks = np.array([(flat < v).sum() + ((flat == v).sum() + 1) / 2 for v in flat])
        return np.array([NormalDist().inv_cdf((r - 0.375) / (len(flat) + 0.25)) for r in ranks]).reshape(y.shape)

    def r_hat(y):
        within = y.var(axis=1, ddof=1).mean()
        return np.sqrt((y.shape[1] - 1) / y.shape[1] + y.mean(axis=1).var(ddof=1) / within) if within > 0 else np.nan

    half = x.shape[1] // 2
    h = np.concatenate([x[:, :half], x[:, x.shape[1] - half :]])
    s = np.sort(x.ravel())
    span = min(int(prob * len(s)), len(s) - 1)
    i = int(np.argmin(s[span:] - s[: len(s) - span]))
    sd, z = s.std(ddof=1), scores(h)
    hats = [v for v in (r_hat(z), r_hat(scores(np.abs(h - np.median(h))))) if not np.isnan(v)]
    return {
        "mean": s.mean(), "sd": sd, "hdi_lo": s[i], "hdi_hi": s[i + span], "mcse_mean": sd / np.sqrt(ess(h)), "mcse_sd": sd / np.sqrt(2 * ess((h - s.mean()) ** 2)),
        "ess_bulk": ess(z), "ess_tail": min(ess((h <= np.quantile(s, q)).astype(float)) for q in (0.05, 0.95)), "r_hat": max(hats, default=np.nan),
    }


def test_r_hat(spark):
    g = np.random.default_rng(1)
    x = g.standard_normal((4, 200))
    rows = [(c, d, float(x[c, d])) for c in range(4) for d in range(200)]
    frame = spark.createDataFrame(rows, "chain int, draw int, value double").withColumn("k", F.lit(0))
    found = diagnostics.split_r_hat(frame, ["k"]).head()["r_hat"]
    h = np.concatenate([x[:, :100], x[:, 100:]])
    assert abs(found - np.sqrt(0.99 + h.mean(axis=1).var(ddof=1) / h.var(axis=1, ddof=1).mean())) < 1e-9


def test_summary_of_chains(spark):
    """Slow and fast chains, ties, constants, an odd number of draws, one chain, few draws and a null key, against plain steps."""
    g = np.random.default_rng(2)
    sizes = [(4, 120), (4, 120), (4, 121), (2, 300), (4, 60), (1, 80), (3, 6), (4, 50)]
    held, rows = {}, []
    for k, (m, n) in enumerate(sizes):
        x = np.zeros((m, n))
        for d in range(n):
            x[:, d] = (0.0, 0.8, -0.5, 0.98, 0.0, 0.3, 0.0, 0.0)[k] * x[:, d - 1] + g.standard_normal(m)
        x = {1: x + np.arange(m)[:, None], 4: np.round(x), 7: np.full((m, n), 2.0)}.get(k, x)
        node = None if k == 3 else f"n{k % 2}"
        held[node, k] = x
        rows += [(node, k, c, 3 * d, float(x[c, d])) for c in range(m) for d in range(n)]
    frame = spark.createDataFrame(rows, "node string, k int, chain int, draw int, value double").repartition(5)
    found = {(r["node"], r["k"]): r.asDict() for r in diagnostics.summary(frame).collect()}
    assert set(found) == set(held)
    for key, x in held.items():
        want = plain_summary(x)
        assert {c: found[key][c] for c in want} == {c: pytest.approx(float(v), rel=1e-9, abs=1e-12, nan_ok=True) for c, v in want.items()}, key
    assert "Python" not in diagnostics.summary(frame)._jdf.queryExecution().executedPlan().toString()
    assert diagnostics.summary(frame.limit(0)).count() == 0


def test_histogram_and_box(spark):
    rows = spark.createDataFrame([(0, float(v)) for v in (0, 1, 2, 3, 4, 100)], "g int, v double")
    bins = plotdata.histogram(rows, "v", 4).orderBy("bin").collect()
    assert [r["height"] for r in bins] == [5, 0, 0, 1]
    r = plotdata.box(rows, "g", "v").head()
    assert r["median"] == 2.5 and r["whisker_hi"] == 4.0 and r["n_outliers"] == 1
    assert plotdata.histogram(rows.filter("v < 0"), "v", 4).count() == 0
    assert plotdata.average_linkage(np.array([[0, 5, 1], [5, 0, 6], [1, 6, 0.0]])) == [0, 2, 1]


def test_simulation_keeps_its_promises(spark):
    forest = simulate.random_forest(spark, 12, 3, 5, seed=3)
    tree.check_forest(forest)
    assert forest.agg(F.min("length"), F.max("length")).head()[0] >= 100
    e0 = simulate.baseline(6, 10.0, 0.4, 1)
    assert (e0 > 0).sum() == 4
    truth = simulate.simulate(forest, e0, alpha=15.0, dropout=0.3, seed=5)
    rows = {r["node"]: r for r in truth.collect()}
    again = {r["node"]: r for r in truth.repartition(7).collect()}
    assert rows == again
    for r in rows.values():
        e = np.array(r["e"])
        assert abs(e.sum() - 1) < 1e-9
        up = rows[r["parent"]]["e"] if r["parent"] else e0
        assert not (e[np.array(up) == 0] > 0).any()
    s = np.random.default_rng(0).dirichlet(np.ones(96), 6)
    simulate.check_signatures(s)
    totals = {r["node"]: r["t"] for r in simulate.count_matrix(truth, s).groupBy("node").agg(F.sum("n").alias("t")).collect()}
    assert totals == {n: r["num_mutations"] for n, r in rows.items() if r["num_mutations"]}


def test_counts_have_their_moments():
    g = np.random.default_rng(0)
    x = np.array([simulate.count(g, 50, 2.0) for _ in range(4000)])
    assert abs(x.mean() - 50) < 3 and abs(x.var() / (50 * 26) - 1) < 0.2
    assert abs(np.mean([simulate.count(g, 50, None) for _ in range(4000)]) - 50) < 1


def test_sticks(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "node string")
    found = sticks.sticks(rows, 40, 1.0).groupBy("node").agg(F.sum("weight").alias("s"), F.min("weight").alias("m")).collect()
    assert all(0.99 < r["s"] <= 1 + 1e-9 and r["m"] > 0 for r in found)
    with pytest.raises(ValueError):
        sticks.synthesise(spark.range(2).withColumnRenamed("id", "k"), 1.5)
    kept = sticks.dropout(spark.createDataFrame([(str(i), k, 0.5) for i in range(40) for k in (0, 1)], "node string, k int, e double"), 0.95)
    assert kept.groupBy("node").agg(F.count_if("kept").alias("n")).filter("n = 0").count() == 0


@pytest.fixture(scope="module")
def model():
    g = np.random.default_rng(2)
    s = g.dirichlet(np.full(20, 0.3), 3)
    e = np.array([[0.6, 0.3, 0.1], [0.5, 0.4, 0.1], [0.1, 0.1, 0.8], [0.2, 0.1, 0.7]])
    x = np.array([g.multinomial(800, p) for p in e @ s])
    x[1] = 0
    return infer.TreeModel("abcd", [-1, 0, -1, 2], x, s), e


def test_slope(model):
    m = model[0]
    theta = np.random.default_rng(3).standard_normal(m.size) * 0.3
    _, slope = m.logp_grad(theta)
    for i in range(m.size):
        step = np.zeros(m.size)
        step[i] = 1e-5
        assert abs((m.logp_grad(theta + step)[0] - m.logp_grad(theta - step)[0]) / 2e-5 - slope[i]) < 1e-2


def test_fit_recovers(spark, model):
    m, e = model
    draws = infer.fit(spark, m, draws=150, tune=250, chains=2)
    means = {(r["node"], r["k"]): r["m"] for r in draws.filter("var = 'e'").groupBy("node", "k").agg(F.avg("value").alias("m")).collect()}
    for node, row in zip("acd", e[[0, 2, 3]], strict=True):
        got = np.array([means[node, k] for k in range(3)])
        assert got @ row / (np.linalg.norm(got) * np.linalg.norm(row)) > 0.97
    with pytest.raises(KeyError):
        infer.prior("Cauchy")


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 5), ("b", 95, 7)], "node string, channel int, n long")
    wide = files.to_matrix(rows, "node", "channel", "n", [(c, f"Channel_{c}") for c in range(96)], F.lit(0).cast("bigint"))
    files.write_matrix(wide, str(tmp_path / "m"))
    back = files.from_matrix(files.read_counts(spark, str(tmp_path / "m")), "node", "channel", "n", "Channel_").filter("n > 0")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in rows.collect()}
    with pytest.raises(ValueError):
        files.read_matrix(spark, str(tmp_path / "m"), "node", "Channel_", 95)
    with pytest.raises(ValueError, match="does not sum"):
        files.check_signature_rows(wide)
    files.write_report(spark.createDataFrame([(1, None)], "a int, b double"), str(tmp_path / "r"))
    assert json.loads(next((tmp_path / "r").glob("part*")).read_text()) == {"a": 1, "b": None}
    assert files.make_output_dir(str(tmp_path), "x").is_dir()
    with pytest.raises(FileNotFoundError):
        files.load_config(str(tmp_path / "no.yaml"))


def test_stream(spark, tmp_path):
    from treeweft.streaming.posterior import arriving_draws, running_moments

    rows = spark.createDataFrame([(0, d, "n", 0, float(d)) for d in range(4)], "chain int, draw int, node string, k int, value double")
    rows.write.parquet(str(tmp_path / "in"))
    q = running_moments(arriving_draws(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("moments").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("select * from moments").head()
    assert (r["n"], r["mean"]) == (4, 1.5)


def test_sticks_are_broken_until_they_cover_a_draw(spark):
    """Draws far out in the stick, beyond any number of pieces that is fixed beforehand."""
    tops = [0.0, 0.5, 1 - 1e-6, 1 - 1e-12, 1 - 2**-53]
    draws = spark.createDataFrame([(f"n{i}", j, u) for i in range(4) for j, u in enumerate(tops)], "node string, draw int, u double")
    found = sticks.pick(draws, 3.0)
    rows = {(r["node"], r["draw"]): r["k"] for r in found.collect()}
    assert len(rows) == 20 and max(rows.values()) > 60
    for i in range(4):
        ks = [rows[f"n{i}", j] for j in range(len(tops))]
        assert ks == sorted(ks) and ks[0] == 0
    held = {(r["node"], r["k"]): r for r in sticks.sticks(draws.select("node").distinct(), 40, 3.0).collect()}
    for (node, draw), k in rows.items():
        if draw < 2:
            assert held[node, k]["cum_lo"] - 1e-9 <= tops[draw] < held[node, k]["cum_hi"] + 1e-9
    assert sticks.pick(draws.limit(0), 3.0).count() == 0


def test_atoms_of_any_half(spark):
    ks = spark.range(40).select(F.col("id").cast("int").alias("k"))
    spread = {}
    for c in (0.5, 1.0, 2.5):
        rows = sticks.atoms(ks, 50, "t", c).groupBy("k").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")).collect()
        assert all(abs(r["s"] - 1) < 1e-9 for r in rows)
        spread[c] = np.mean([r["q"] for r in rows])
    for c, q in spread.items():  # the mean of the sum of squares is (c + 1) / (50 c + 1)
        assert abs(q / ((c + 1) / (50 * c + 1)) - 1) < 0.1
    with pytest.raises(ValueError):
        sticks.atoms(ks, 50, "t", 0.3)


def test_fixed_prior_and_the_default_scale():
    from treeweft.operators import infer

    g = np.random.default_rng(0)
    model = infer.TreeModel("abc", [-1, 0, 0], g.integers(0, 9, (3, 4)), g.dirichlet(np.ones(4), 3), ("Fixed", 0.7))
    assert model.sigma_0 == 1.0
    theta = g.standard_normal(model.size)
    assert model.walk(theta)[0] == 0.7
    value, slope = model.logp_grad(theta)
    for i in range(model.size):
        step = np.zeros(model.size)
        step[i] = 1e-6
        assert abs((model.logp_grad(theta + step)[0] - value) / 1e-6 - slope[i]) < 1e-3
    for name in ("Dir", "Cauchy"):
        with pytest.raises(KeyError):
            infer.prior(name)


def test_activity_and_signature_files(spark, tmp_path):
    wide = spark.createDataFrame([("a", 0.25, 0.75), ("b", 1.0, 0.0)], "node string, Signature_0 double, Signature_1 double")
    files.write_matrix(wide, f"file://{tmp_path}/true.csv")
    found = {(r["node"], r["k"]): r["true_e"] for r in files.read_activities(spark, f"file://{tmp_path}/true.csv").collect()}
    assert found == {("a", 0): 0.25, ("a", 1): 0.75, ("b", 0): 1.0, ("b", 1): 0.0}
    rows = spark.createDataFrame([(k, c, 1 / 96) for k in (0, 1) for c in range(96)], "k int, channel int, p double")
    files.write_inferred_signatures(rows, f"file://{tmp_path}/inferred.csv")
    again = files.read_signatures(spark, f"file://{tmp_path}/inferred.csv").collect()
    assert sorted(r["name"] for r in again) == ["Signature_0", "Signature_1"] and again[0]["Channel_95"] == pytest.approx(1 / 96)


def test_a_tree_a_row(spark):
    rows = spark.createDataFrame([(7, "(a:1,b:2)c;"), (3, "(x,(y)z)w;"), (5, " ")], "t int, tree string")
    found = {tuple(r)[:3] for r in newick.parse(rows, "tree", "t").collect()}
    assert found == {(7, "c", "a"), (7, "c", "b"), (3, "w", "x"), (3, "w", "z"), (3, "z", "y")}


def test_measures(spark):
    from treeweft.operators.measures import DirichletPrior, DirichletProcess, Measure

    with pytest.raises(TypeError):
        Measure()
    draws = spark.range(60).select((F.col("id") % 2).cast("string").alias("node"), F.col("id").cast("int").alias("draw"))
    prior = DirichletPrior(12)
    for measure, most in ((prior, 60), (DirichletProcess(prior, 1.5), 24)):
        rows = {}
        for r in measure.sample(draws).collect():
            rows.setdefault((r["node"], r["draw"]), {})[r["channel"]] = r["p"]
        assert len(rows) == 60 and all(len(v) == 12 and abs(sum(v.values()) - 1) < 1e-9 for v in rows.values())
        kinds = {(node, tuple(sorted(v.items()))) for (node, _), v in rows.items()}
        assert most / 8 <= len(kinds) <= most


def test_linkage_by_its_definition():
    """Mean distances between the members of all groups, worked out anew before each merge."""
    g = np.random.default_rng(4)
    for n in (1, 2, 7, 15):
        x = g.standard_normal((n, 3))
        far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        groups = [[i] for i in range(n)]
        while len(groups) > 1:
            pairs = [(np.mean([far[a, b] for a in p for b in q]), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j]
            _, i, j = min(pairs)
            one, other = sorted((groups[i], groups[j]), key=lambda m: m[0])
            groups = [m for k, m in enumerate(groups) if k not in (i, j)] + [one + other]
        order = plotdata.average_linkage(far)
        assert sorted(order) == list(range(n)) and order == groups[0]


def test_simulated_activities_and_counts(spark):
    """What descends keeps its parent's support and mean; counts have the profile's mean and a dispersion of 2."""
    edges = spark.createDataFrame([(t, f"T{t}", f"T{t}_{i}", 400.0) for t in range(40) for i in range(20)], EDGES)
    e0 = np.array([0.5, 0.3, 0.2, 0.0])
    truth = simulate.simulate(edges, e0, alpha=50.0, lam=300.0, dispersion=2.0, seed=1).collect()
    by = {r["node"]: np.array(r["e"]) for r in truth}
    gaps = [by[r["node"]] - by[r["parent"]] for r in truth if not r["is_root"]]
    assert len(gaps) == 800 and np.abs(np.mean(gaps, axis=0)).max() < 0.01
    assert all(e[3] == 0 and abs(e.sum() - 1) < 1e-9 for e in by.values())
    spread = np.mean([(g**2) / np.maximum(by[r["parent"]] * (1 - by[r["parent"]]), 1e-9) for g, r in zip(gaps, (r for r in truth if not r["is_root"]), strict=True)], axis=0)[:3]
    assert np.allclose(spread, 1 / 51, rtol=0.25)
    n = np.array([r["num_mutations"] for r in truth if not r["is_root"]])
    assert abs(n.mean() / 400 - 1) < 0.08 and abs(n.var() / (400 * (1 + 400 / 2)) - 1) < 0.25
    frame = simulate.simulate(edges, e0, alpha=50.0, lam=300.0, dispersion=2.0, seed=1)
    s = np.random.default_rng(0).dirichlet(np.ones(6), 4)
    found = np.zeros(6)
    for r in simulate.count_matrix(frame, s).groupBy("channel").agg(F.sum("n").alias("n")).collect():
        found[r["channel"]] = r["n"]
    want = sum(r["num_mutations"] * (np.array(r["e"]) @ s) for r in truth)
    assert np.abs(found - want).max() < 6 * np.sqrt(want.max()) and found.sum() == sum(r["num_mutations"] for r in truth)


def test_quantiles_and_narrowest_intervals(spark):
    """Order statistics by ranges: ties that most rows share, nulls, NaN, one row, and no groups at all."""
    g = np.random.default_rng(8)
    by = {"a": g.integers(0, 4, 301).astype(float), "b": np.r_[np.zeros(200), g.random(90)], "c": np.array([2.5]), "d": g.random(64)}
    rows = [(k, float(x)) for k, v in by.items() for x in v] + [("a", None), ("d", float("nan")), ("e", None)]
    frame = spark.createDataFrame(rows, "g string, x double").repartition(6)
    found = vectors.quantiles(frame, ["g"], "x", {"low": 0.05, "mid": 0.5, "top": 1.0}).collect()
    assert {r["g"]: tuple(r)[1:] for r in found} == {k: pytest.approx(tuple(np.quantile(v, (0.05, 0.5, 1.0)))) for k, v in by.items()}
    every = np.concatenate(list(by.values()))
    assert vectors.quantiles(frame, [], "x", {"m": 0.25}).head()[0] == pytest.approx(np.quantile(every, 0.25))
    assert vectors.quantiles(frame.limit(0), ["g"], "x", {"m": 0.5}).count() == 0
    clean = spark.createDataFrame([(k, float(x)) for k, v in by.items() for x in v], "g string, value double")
    for prob in (0.5, 0.97):
        want = {}
        for k, v in by.items():
            v = np.sort(v)
            span = min(int(np.floor(prob * len(v))), len(v) - 1)
            want[k] = min((v[i + span] - v[i], v[i], v[i + span]) for i in range(len(v) - span))[1:]
        assert {r["g"]: (r["lo"], r["hi"]) for r in evaluate.hdi(clean, "g", prob=prob).collect()} == want
    one = evaluate.hdi(clean.drop("g"), [], prob=0.5).head()
    assert one["hi"] - one["lo"] == min(np.sort(every)[i + len(every) // 2] - np.sort(every)[i] for i in range(len(every) - len(every) // 2))


def test_medians_of_columns(spark):
    rows = [("a", 1.0, float("nan")), ("a", 3.0, float("nan")), ("b", 2.0, 5.0), (None, 9.0, 9.0)]
    found = evaluate.medians(spark.createDataFrame(rows, "g string, x double, y double"), "g", ["x", "y"]).collect()
    assert sorted(map(tuple, found)) == [("a", 2.0, None), ("b", 2.0, 5.0)]


def test_heaviest_pieces(spark):
    ids = spark.createDataFrame([(f"n{i}",) for i in range(12)], "node string")
    for alpha in (0.5, 9.0):
        plain = sticks.sticks(ids, 400, alpha).collect()
        want = {n: sorted(((r["weight"], r["k"]) for r in plain if r["node"] == n), reverse=True)[:5] for n in {r["node"] for r in plain}}
        got = {}
        for r in sticks.heaviest(ids, 5, alpha).collect():
            got.setdefault(r["node"], []).append((r["weight"], r["k"]))
        assert {n: [k for _, k in sorted(v, reverse=True)] for n, v in got.items()} == {n: [k for _, k in v] for n, v in want.items()}
