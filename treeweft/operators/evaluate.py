"""How well activities and signatures are recovered, and what the draws say."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeweft.functions.vectors import cosine, mean_abs_error, pearson, quantiles, running
from treeweft.operators.diagnostics import narrowest
from treeweft.plans.lineage import settled

#: Samples of a key that are sorted in one array.
ARRAY = 1 << 16
GATE_R_HAT, GATE_ESS, STRONG, NEAR_ZERO = 1.01, 100, 0.3, 0.01


def recovered(size: int) -> list[Column]:
    return [mean_abs_error("true_e", "inferred_e", size).alias("mae"), cosine("true_e", "inferred_e").alias("cosine_similarity")]


def spread(size: int) -> list[Column]:
    """true_k0.., inferred_k0..: a sum for each component and side."""
    return [
        F.coalesce(F.sum(F.when(F.col("k") == k, F.col(f"{side}_e"))), F.lit(0.0)).alias(f"{side}_k{k}")
        for side in ("true", "inferred")
        for k in range(size)
    ]


def recovery(pairs: DataFrame, size: int, by=("node",)) -> DataFrame:
    """(*by, mae, cosine_similarity) of (node, k, true_e, inferred_e); absent components count as zeros."""
    return pairs.groupBy(*by).agg(*recovered(size))


def wide(pairs: DataFrame, size: int) -> DataFrame:
    """(node, true_k0.., inferred_k0..)"""
    return pairs.groupBy("node").agg(*spread(size))


def compare_activities(pairs: DataFrame, found_depths: DataFrame, size: int) -> DataFrame:
    """recovery and wide activities, in one aggregate, with each node's depth, null where it has none."""
    both = pairs.groupBy("node").agg(*recovered(size), *spread(size))
    return both.join(found_depths.select("node", "depth"), "node", "left")


def realigned(pairs: DataFrame, assignment: DataFrame) -> DataFrame:
    """(node, k, true_e, inferred_e) with inferred components in the true ones' numbers; those without a partner go.

    The assignment has a row for each signature, some tens.
    """
    partner = F.broadcast(assignment.select("true_k", "matched"))
    rows = pairs.join(partner, F.col("k") == F.col("matched"), "left")
    own = F.struct(F.col("k"), F.col("true_e"), F.lit(0.0).alias("inferred_e"))
    other = F.struct(F.col("true_k").alias("k"), F.lit(0.0).alias("true_e"), F.col("inferred_e"))
    both = rows.select("node", F.inline(F.array(own, other))).filter("k is not null")
    return both.groupBy("node", "k").agg(F.sum("true_e").alias("true_e"), F.sum("inferred_e").alias("inferred_e"))


def node_posterior(draws: DataFrame, node: str) -> DataFrame:
    """(chain, draw, k, value) of one node; KeyError if it has no draws."""
    found = draws.filter(F.col("node") == node).select("chain", "draw", "k", "value")
    if not found.head(1):
        raise KeyError(node)
    return found


def posterior_means(draws: DataFrame) -> DataFrame:
    return draws.groupBy("node", "k").agg(F.avg("value").alias("mean"))


def global_correlations(draws: DataFrame, global_draws: DataFrame) -> DataFrame:
    """(node, signature, correlation, mean_activity): each component's draws against the global parameter's."""
    one = global_draws.select("chain", "draw", F.col("value").alias("g"))
    both = draws.join(one, ["chain", "draw"])
    return both.groupBy("node", F.col("k").alias("signature")).agg(
        pearson("value", "g").alias("correlation"), F.avg("value").alias("mean_activity")
    )


def near_zero(mean: str) -> Column:
    return F.when(F.col(mean) < NEAR_ZERO, "near-zero").otherwise("active")


def correlation_summary(correlations: DataFrame) -> DataFrame:
    size = F.abs("correlation")
    strong = F.count_if(size > STRONG)
    return correlations.agg(
        F.count("*").alias("n"),
        strong.alias("n_strong"),
        F.try_divide(100.0 * strong, F.count("*")).alias("pct_strong"),
        F.avg(size).alias("mean_abs"),
        F.max(size).alias("max_abs"),
    )


def strongest(correlations: DataFrame, n: int = 10) -> DataFrame:
    return correlations.orderBy(F.abs("correlation").desc_nulls_last(), "node", "signature").limit(n)


def gates(stats: DataFrame) -> DataFrame:
    """How many parameters miss the convergence gates."""
    n = F.count("*")
    bad, low = F.count_if(F.col("r_hat") > GATE_R_HAT), F.count_if(F.col("ess_bulk") < GATE_ESS)
    return stats.agg(
        n.alias("n"),
        bad.alias("n_bad_r_hat"),
        F.try_divide(100.0 * bad, n).alias("pct_bad_r_hat"),
        low.alias("n_low_ess"),
        F.try_divide(100.0 * low, n).alias("pct_low_ess"),
    )


def medians(stats: DataFrame, by, columns) -> DataFrame:
    """Medians by group. Rows without a group are left out, NaN doesn't count; a column without any value in a group is null."""
    keys = [by] if isinstance(by, str) else list(by)
    for k in keys:
        stats = stats.filter(F.col(k).isNotNull())
    long = stats.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns])).alias("m"))
    found = quantiles(long.select(*keys, "m._c", "m._v"), [*keys, "_c"], "_v", {"_m": 0.5})
    wide = [F.max(F.when(F.col("_c") == c, F.col("_m"))).alias(f"median_{c}") for c in columns]
    return stats.select(*keys).distinct().join(found, keys, "left").groupBy(*keys).agg(*wide)


def hdi(samples: DataFrame, by, value: str = "value", prob: float = 0.97) -> DataFrame:
    """(*by, lo, hi): of the intervals of floor(prob*n)+1 sorted samples the narrowest, the lowest on ties.

    The samples of a key are sorted as an array, up to ``ARRAY`` of them. Of a key with more they are dealt by ranges, so that they may
    be more than a task holds; whether there is one is counted first.
    """
    by = [by] if isinstance(by, str) else list(by)
    rows = samples.select(*by, F.col(value).alias("_x"))
    if not by:
        return hdi_by_ranges(rows, by, prob)
    large = settled(rows.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > ARRAY))
    if large.isEmpty():
        return hdi_by_arrays(rows, by, prob)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    small, other = (rows.alias("l").join(large.alias("r"), same, how) for how in ("left_anti", "left_semi"))
    return hdi_by_arrays(small, by, prob).unionByName(hdi_by_ranges(other, by, prob))


def hdi_by_arrays(rows: DataFrame, by: list[str], prob: float) -> DataFrame:
    """hdi() of (*by, _x), a sorted array a key; nulls come first. Keys with nulls give nothing, as keys that are joined."""
    lists = rows.filter(~reduce(or_, [F.col(c).isNull() for c in by])).groupBy(*by).agg(F.count("*").alias("_n"), F.sort_array(F.collect_list("_x")).alias("_v"))
    nulls = F.array_repeat(F.lit(None).cast(rows.schema["_x"].dataType), (F.col("_n") - F.size("_v")).cast("int"))
    ends = lists.select(*by, F.when(F.size("_v") == F.col("_n"), F.col("_v")).otherwise(F.concat(nulls, "_v")).alias("_v"))
    return ends.select(*by, narrowest("_v", prob).alias("b")).select(*by, "b.lo", "b.hi")


def hdi_by_ranges(rows: DataFrame, by: list[str], prob: float) -> DataFrame:
    """hdi() of (*by, _x): samples are numbered by ranges, equal ones in any order, and each meets the one so many places further on."""
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    rows = running(rows, by, ["_x", "_tie"], {"_i": F.lit(1)}).drop("_tie")
    sizes = rows.groupBy(*by).agg(F.max("_i").alias("_n"))
    sizes = sizes.select(*by, F.least(F.floor(F.col("_n") * prob), F.col("_n") - 1).alias("_span"))
    ends = (rows.join(sizes, by) if by else rows.crossJoin(sizes)).select(*by, F.col("_x").alias("hi"), (F.col("_i") - F.col("_span")).alias("_i"))
    both = rows.join(ends, [*by, "_i"]).select(*by, F.col("_x").alias("lo"), "hi")
    best = F.min(F.struct((F.col("hi") - F.col("lo")).alias("w"), "lo", "hi"))
    if not by:
        return both.agg(best.alias("b")).select("b.lo", "b.hi")
    return both.groupBy(*by).agg(best.alias("b")).select(*by, "b.lo", "b.hi")


def compare_global(global_draws: DataFrame, true_value: float, prob: float = 0.97) -> DataFrame:
    """One row: true_alpha, posterior_mean, posterior_sd (of the population), hdi_3%, hdi_97%, true_in_hdi."""
    rows = global_draws.withColumn("_g", F.lit(0))
    ends = hdi(rows, "_g", "value", prob)
    stats = rows.groupBy("_g").agg(F.avg("value").alias("posterior_mean"), F.stddev_pop("value").alias("posterior_sd"))
    true = F.lit(float(true_value))
    return stats.join(ends, "_g").select(
        true.alias("true_alpha"), "posterior_mean", "posterior_sd", F.col("lo").alias("hdi_3%"), F.col("hi").alias("hdi_97%"),
        true.between(F.col("lo"), F.col("hi")).alias("true_in_hdi"),
    )


def compare_signatures(inferred: DataFrame, true: DataFrame, assignment: DataFrame) -> DataFrame:
    """(true_signature, matched_inferred_idx, cosine_similarity, mae) for the pairs (true_k, matched)."""
    left = true.select(F.col("k").alias("true_k"), "channel", F.col("p").alias("tp"))
    right = inferred.select(F.col("k").alias("matched"), "channel", F.col("p").alias("ip"))
    both = left.join(assignment.select("true_k", "matched"), "true_k").join(right, ["matched", "channel"])
    return both.groupBy(F.concat(F.lit("True_Sig_"), "true_k").alias("true_signature"), F.col("matched").alias("matched_inferred_idx")).agg(
        cosine("tp", "ip").alias("cosine_similarity"), mean_abs_error("tp", "ip").alias("mae")
    )
