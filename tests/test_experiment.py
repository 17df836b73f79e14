import numpy as np
import pytest

from treeweft.plans import experiment
from treeweft.sources import files, netcdf


def test_generate_and_fit(spark, tmp_path):
    config = {
        "experiment_name": "small",
        "simulation": {
            "seed": 7, "results_dir": str(tmp_path / "data"), "alpha": "15", "alpha_0": 10, "lam": 900, "nb_dispersion": "none",
            "activity_sparsity": "1/3", "signature_dropout": 0.1,
            "signatures": {"source": "synthesize", "correlation": 0.1, "num_signatures": 3},
            "forest": {"num_trees": 3, "min_leaves": 2, "max_leaves": 3, "min_branch_length": 500, "max_branch_length": 900},
        },
    }
    out = experiment.generate(spark, config)
    report = files.read_report(spark, f"{out}/ground_truth_params.json").head()
    assert report["true_K"] == 2 and report["nb_dispersion"] is None and report["dataset_summary"]["n_tumours"] == 3
    truth = {r["node"]: np.array(r[1:], dtype=float) for r in spark.read.csv(f"{out}/true_activities.csv", header=True).collect()}
    assert all(abs(v.sum() - 1) < 1e-9 for v in truth.values())
    config["inference"] = {
        "data": {"count_matrix": f"{out}/mutation_count_matrix.csv", "newick_string": f"{out}/newick_string.nwk", "fixed_signatures": f"{out}/fixed_signatures.csv"},
        "priors": {"sigma_prior": "LogNorm", "sigma_prior_parm": {"mu": 0, "sigma": "1/2"}, "sigma_0": 2.0},
        "draws": 60, "tune": 80, "chains": 2, "target_accept": 0.8, "results_dir": str(tmp_path / "results"),
    }
    found = experiment.fit(spark, config)
    draws = files.read_draws(spark, f"{found}/trace.parquet", "e")
    means = {(r["node"], r["k"]): r["m"] for r in draws.groupBy("node", "k").agg({"value": "avg"}).withColumnRenamed("avg(value)", "m").collect()}
    gaps = [abs(means[n, k] - e[k]) for n, e in truth.items() for k in range(3)]
    assert np.mean(gaps) < 0.15
    assert spark.read.csv(f"{found}/inference_summary.csv", header=True).count() == len(means) + 1

    names = ("newick_string", "count_matrix", "true_activities", "ground_truth_params", "fixed_signatures", "inferred_signatures")
    paths = ("newick_string.nwk", "mutation_count_matrix.csv", "true_activities.csv", "ground_truth_params.json", "fixed_signatures.csv", "fixed_signatures.csv")
    config["inference"]["data"] = {n: f"{out}/{p}" for n, p in zip(names, paths, strict=True)}
    tables = experiment.evaluate_run(spark, config)

    def read(name):
        return [r.asDict() for r in spark.read.csv(f"{tables}/{name}.csv", header=True, inferSchema=True).collect()]

    seen = {r["node"] for r in files.read_counts(spark, f"{out}/mutation_count_matrix.csv").collect()}
    recovery = {r["node"]: r for r in read("recovery")}
    assert set(recovery) == seen
    for n, r in recovery.items():
        mean = np.array([means[n, k] for k in range(3)])
        assert abs(r["mae"] - np.abs(mean - truth[n]).mean()) < 1e-9
        assert abs(r["cosine_similarity"] - mean @ truth[n] / np.linalg.norm(mean) / np.linalg.norm(truth[n])) < 1e-6
    depth = {r["node"]: r["depth"] for r in read("activities")}
    parents = {r["child"]: r["parent"] for r in spark.read.csv(f"{out}/tree_edges.csv", header=True).collect()}

    def steps(n):
        return 1 + steps(parents[n]) if n in parents else 0

    assert depth == {n: steps(n) for n in seen}
    assert {(r["node"], r["signature"]) for r in read("depth_stats")} == {(n, k) for n in seen for k in range(3)}
    assert {r["depth"] for r in read("depth_medians")} == set(depth.values()) and read("convergence")[0]["n"] == 3 * len(seen)
    assert len(read("correlations")) == 3 * len(seen) and read("correlation_summary")[0]["n"] == 3 * len(seen)
    assert read("alpha")[0]["true_alpha"] == 15 and len(read("strongest_correlations")) == min(10, 3 * len(seen))
    assert all(r["cosine_similarity"] > 1 - 1e-9 and r["true_signature"] == f"True_Sig_{r['matched_inferred_idx']}" for r in read("signatures"))
    del config["inference"]["data"]["true_activities"], config["inference"]["data"]["ground_truth_params"]
    assert experiment.evaluate_run(spark, config) == tables
    trace = netcdf.read_draws(spark, f"file://{found}/trace.nc")
    assert trace.count() == files.read_draws(spark, f"{found}/trace.parquet").count()
    assert trace.filter("var = 'sigma'").select("chain", "draw", "value").exceptAll(files.read_draws(spark, f"{found}/trace.parquet", "sigma").select("chain", "draw", "value")).isEmpty()


def test_what_a_source_needs(spark):
    for held in ({"source": "synthesize", "path": "x"}, {"source": "load", "num_signatures": 3}):
        with pytest.raises(ValueError, match="is missing"):
            experiment.signature_matrix(spark, {"signatures": held})


def test_unknown_source(spark):
    with pytest.raises(ValueError):
        experiment.signature_matrix(spark, {"signatures": {"source": "guess"}})
