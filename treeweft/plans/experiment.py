"""Experiments from a YAML configuration: simulate data into files, fit the model with fixed signatures, evaluate a run.

    python -m treeweft.plans.experiment generate --config c.yaml
    python -m treeweft.plans.experiment fit --config c.yaml
    python -m treeweft.plans.experiment evaluate --config c.yaml

Matrices, edges and Newick text are written as folders of CSV or text, draws as Parquet by variable and as NetCDF by chain.
Numbers in the configuration may be fractions such as "1/96".
"""

from __future__ import annotations

import argparse
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeweft.operators import assign, diagnostics, evaluate, infer, simulate, sticks, tree
from treeweft.plans.lineage import settled
from treeweft.sources import files, netcdf, newick

CHANNELS = files.CHANNELS
# the parameters of each prior, in the order in which its density takes them (fixed names of the configuration)
PRIOR_PARAMETERS = {"LogNorm": ("mu", "sigma"), "Norm": ("mu", "sigma"), "HalfNorm": ("sigma",), "Exp": ("lam",), "Gamma": ("alpha", "beta"), "Beta": ("alpha", "beta"), "Fixed": ("value",)}


def number(value) -> float:
    return float(Fraction(str(value)))


def optional(value) -> float | None:
    return None if value is None or str(value).lower() == "none" else number(value)


def matrix(wide: DataFrame, index: str) -> tuple[list[str], np.ndarray]:
    """A signature matrix, some tens of rows, on the driver."""
    rows = wide.collect()
    names = [c for c in wide.columns if c != index]
    return [r[index] for r in rows], np.array([[r[c] for c in names] for r in rows], dtype=float)


def signature_matrix(spark: SparkSession, sim: dict) -> np.ndarray:
    """The signatures that ``sim`` names by its source: those of a file, whatever number it names, or so many made ones."""
    source = sim["signatures"]["source"]
    needed = {"load": "path", "synthesize": "num_signatures"}.get(source)
    if needed and sim["signatures"].get(needed) is None:
        raise ValueError(f"provide a path to load signatures from, or num_signatures to make: {needed} is missing")
    if source == "load":
        found = matrix(files.read_signatures(spark, sim["signatures"]["path"]), "name")[1]
    elif source == "synthesize":
        size = int(sim["signatures"]["num_signatures"])
        rows = sticks.synthesise(spark.range(size).select(F.col("id").cast("int").alias("k")), number(sim["signatures"].get("correlation") or 0)).collect()
        found = np.zeros((size, CHANNELS))
        for r in rows:
            found[r["k"], r["channel"]] = r["p"]
    else:
        raise ValueError(f"signatures are loaded or synthesized, not {source!r}")
    simulate.check_signatures(found)
    return found


def generate(spark: SparkSession, config: dict) -> str:
    """Simulate a cohort and write it; returns the folder."""
    sim = config["simulation"]
    out = str(files.make_output_dir(sim.get("results_dir", "results"), config["experiment_name"]).resolve())
    seed, forest = int(sim["seed"]), sim["forest"]
    bounds = {k: int(forest[k]) for k in ("min_branch_length", "max_branch_length") if k in forest}
    edges = simulate.random_forest(
        spark, int(forest["num_trees"]), int(forest["min_leaves"]), int(forest["max_leaves"]), seed,
        bounds.get("min_branch_length", 100), bounds.get("max_branch_length", 3000),
    )
    files.write_newick(newick.text_rows(edges), f"{out}/newick_string.nwk")
    s = signature_matrix(spark, sim)
    size, alpha, sparsity = len(s), number(sim["alpha"]), number(sim.get("activity_sparsity", 0))
    dropout, alpha_0 = number(sim.get("signature_dropout", 0)), number(sim.get("alpha_0", 1))
    e0 = simulate.baseline(size, alpha_0, sparsity, seed)
    truth = simulate.simulate(edges, e0, alpha, number(sim["lam"]), optional(sim.get("nb_dispersion")), dropout, seed)
    truth.write.mode("overwrite").parquet(f"{out}/nodes.parquet")
    truth = spark.read.parquet(f"{out}/nodes.parquet")
    names = [f"Channel_{c}" for c in range(CHANNELS)]
    rows = [(f"Signature_{k}", *map(float, p)) for k, p in enumerate(s)]
    files.write_matrix(spark.createDataFrame(rows, ["", *names]).coalesce(1), f"{out}/fixed_signatures.csv")
    counts = simulate.count_matrix(truth, s, seed)
    wide = files.to_matrix(counts, "node", "channel", "n", list(enumerate(names)), F.lit(0).cast("bigint"))
    files.write_matrix(wide, f"{out}/mutation_count_matrix.csv")
    activities = truth.select("node", *[F.col("e")[k].alias(f"Signature_{k}") for k in range(size)])
    files.write_matrix(activities, f"{out}/true_activities.csv")
    files.write_matrix(edges.select("tumour", "parent", "child"), f"{out}/tree_edges.csv")
    active = np.flatnonzero(e0).tolist()
    made = simulate.summary(truth, size, len(active), alpha)
    report = {
        "seed": seed, "alpha": alpha, "alpha_0": alpha_0, "lam": number(sim["lam"]), "num_signatures": size,
        "true_K": len(active), "activity_sparsity": sparsity, "signature_dropout": dropout,
        "signature_source": sim["signatures"]["source"], **{f"forest_{k}": int(v) for k, v in forest.items()},
    }
    extra = [
        F.lit(optional(sim.get("nb_dispersion"))).cast("double").alias("nb_dispersion"),
        F.array(*map(F.lit, active)).cast("array<bigint>").alias("active_signature_indices"),
    ]
    files.write_report(
        made.select(*[F.lit(v).alias(k) for k, v in report.items()], *extra, F.struct(*made.columns).alias("dataset_summary")),
        f"{out}/ground_truth_params.json",
    )
    return out


def tree_model(spark: SparkSession, config: dict) -> infer.TreeModel:
    """The model of one cohort, which lies in each sampling task as a whole."""
    inf = config["inference"]
    data, priors = inf["data"], inf["priors"]
    edges = newick.parse_parts(files.read_newick(spark, data["newick_string"]), "value", files.LINE_ORDER)
    tree.check_forest(edges)
    placed = tree.depths(edges).join(tree.nodes(edges), ["tumour", "node"]).orderBy("depth", "node").collect()
    seen, x = matrix(files.read_counts(spark, data["count_matrix"]), "node")
    _, s = matrix(files.read_signatures(spark, data["fixed_signatures"]), "name")
    at = {r["node"]: i for i, r in enumerate(placed)}
    counts = np.zeros((len(placed), CHANNELS))
    for node, row in zip(seen, x, strict=True):
        if node in at:
            counts[at[node]] = row
    name = priors["sigma_prior"]
    infer.prior(name)
    numbers = [number(priors["sigma_prior_parm"][p]) for p in PRIOR_PARAMETERS[name]]
    parents = [-1 if r["parent"] is None else at[r["parent"]] for r in placed]
    return infer.TreeModel([r["node"] for r in placed], parents, counts, s, (name, *numbers), number(priors.get("sigma_0", 1)))


def fit(spark: SparkSession, config: dict) -> str:
    """Sample the posterior and write its draws and their summary; returns the folder."""
    inf = config["inference"]
    out = str(files.make_output_dir(inf.get("results_dir", "results"), config["experiment_name"]).resolve())
    draws = infer.fit(
        spark, tree_model(spark, config), int(inf.get("draws", 1000)), int(inf.get("tune", 1000)), int(inf.get("chains", 4)),
        number(inf.get("target_accept", 0.95)), int(inf.get("max_treedepth", 10)), int(inf.get("seed", 42)),
    )
    files.write_draws(draws, f"{out}/trace.parquet")
    netcdf.write_draws(files.read_draws(spark, f"{out}/trace.parquet"), f"file://{out}/trace.nc")
    found = diagnostics.summary(files.read_draws(spark, f"{out}/trace.parquet"), ("var", "node", "k"))
    found.write.mode("overwrite").csv(f"{out}/inference_summary.csv", header=True)
    return out


def evaluate_run(spark: SparkSession, config: dict) -> str:
    """What the draws of a fitted run say, against the truth if it is known, from files alone; returns the folder of tables.

    The run's folder has the draws; ``inference.data`` names the Newick text and counts, and may name ``true_activities``,
    ``ground_truth_params``, and ``inferred_signatures`` beside the true ``fixed_signatures``. Tables that need what isn't named are not written. A node
    counts if it has mutations; nodes without truth are left out of what needs it, and it is an error if none is left.
    """
    inf = config["inference"]
    data, run = inf["data"], str(files.make_output_dir(inf.get("results_dir", "results"), config["experiment_name"]).resolve())
    out = f"{run}/evaluation"

    def write(name: str, table: DataFrame) -> None:
        table.write.mode("overwrite").csv(f"{out}/{name}.csv", header=True)

    edges = newick.parse_parts(files.read_newick(spark, data["newick_string"]), "value", files.LINE_ORDER)
    depth = settled(tree.depths(edges))
    counts = files.from_matrix(files.read_counts(spark, data["count_matrix"]), "node", "channel", "n", "Channel_")
    seen = settled(counts.groupBy("node").agg(F.sum("n").alias("n")).filter("n > 0").select("node"))
    draws = files.read_draws(spark, f"{run}/trace.parquet", "e").select("chain", "draw", "node", "k", "value")
    draws = draws.join(seen, "node", "left_semi")
    sigma = files.read_draws(spark, f"{run}/trace.parquet", "sigma").select("chain", "draw", "value")
    stats = settled(diagnostics.summary(draws, ("node", "k")).join(depth.select("node", "depth"), "node"))
    write("depth_stats", stats.select("node", "depth", F.col("k").alias("signature"), "mean", "sd", "ess_bulk", "ess_tail", "r_hat"))
    write("depth_medians", evaluate.medians(stats, "depth", ["mean", "sd", "ess_bulk", "ess_tail", "r_hat"]))
    write("convergence", evaluate.gates(stats))
    related = settled(evaluate.global_correlations(draws, sigma))
    write("correlations", related.select("node", "signature", F.col("correlation").alias("correlation_with_alpha"), "mean_activity"))
    write("correlation_summary", evaluate.correlation_summary(related))
    write("strongest_correlations", evaluate.strongest(related))
    if "ground_truth_params" in data:
        alpha = files.read_report(spark, data["ground_truth_params"]).head()["alpha"]
        write("alpha", evaluate.compare_global(sigma, float(alpha)))
    pairs = size = None
    if "true_activities" in data:
        truth = files.read_activities(spark, data["true_activities"])
        means = stats.select("node", "k", F.col("mean").alias("inferred_e"))
        size = truth.agg(F.max("k")).head()[0] + 1
        pairs = settled(truth.join(means, ["node", "k"]).select("node", "k", "true_e", "inferred_e"))
        if pairs.isEmpty():
            raise ValueError("no node has both draws and a true activity")
    if "inferred_signatures" in data and "fixed_signatures" in data:
        sides = []
        for name in ("inferred_signatures", "fixed_signatures"):
            wide = files.read_signatures(spark, data[name])
            numbered = wide.withColumn("k", F.regexp_extract("name", "([0-9]+)$", 1).cast("int"))
            long = files.from_matrix(numbered.drop("name"), "k", "channel", "p", "Channel_")
            sides.append(settled(long))
        matched = settled(assign.align(*sides))
        write("signatures", evaluate.compare_signatures(*sides, matched))
        pairs = None if pairs is None else evaluate.realigned(pairs, matched)
    if pairs is not None:
        write("recovery", evaluate.recovery(pairs, size))
        write("activities", evaluate.compare_activities(pairs, depth, size))
    return out


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("task", choices=("generate", "fit", "evaluate"))
    parser.add_argument("--config", required=True)
    chosen = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"treeweft-{chosen.task}").getOrCreate()
    print({"generate": generate, "fit": fit, "evaluate": evaluate_run}[chosen.task](spark, files.load_config(chosen.config)))


if __name__ == "__main__":
    main()
