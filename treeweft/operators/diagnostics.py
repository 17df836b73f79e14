"""Convergence of chains: split and rank-normalised R-hat, effective sample sizes (Vehtari et al. 2021)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeweft.functions.arrays import bound
from treeweft.functions.normal import normal_quantile


def split_r_hat(draws: DataFrame, by) -> DataFrame:
    """(*by, r_hat) of halved chains, without rank normalisation: built-in aggregates only.

    A chain of odd length loses its middle draw. Constant draws give null.
    """
    by = list(by)
    order = Window.partitionBy(*by, "chain").orderBy("draw")
    rows = draws.withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(*by, "chain")))
    half = F.floor(F.col("_n") / 2)
    side = F.when(F.col("_i") <= half, 0).when(F.col("_i") > F.col("_n") - half, 1)
    rows = rows.withColumn("_half", side).filter("_half is not null")
    parts = rows.groupBy(*by, "chain", "_half").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    within, n = F.avg("v"), F.max("n")
    inside = F.try_divide((n - 1) / n * within + F.var_samp("m"), within)
    return parts.groupBy(*by).agg(F.sqrt(inside).alias("r_hat"))


def of_sorted(values: Column, q: float) -> Column:
    """A quantile of a sorted array, between two values by their distances."""
    at = (F.size(values) - 1) * F.lit(q)
    low, high = (F.get(values, x.cast("int")) for x in (F.floor(at), F.ceil(at)))
    return low + (high - low) * (at - F.floor(at))


def narrowest(values, prob: float) -> Column:
    """(w, lo, hi): of the intervals of floor(prob*n)+1 of a sorted array the narrowest, the lowest on ties."""
    n = F.size(values)
    span = F.least(F.floor(n * prob).cast("int"), n - 1)
    ends = F.zip_with(F.slice(values, F.lit(1), n - span), F.slice(values, span + 1, n - span), lambda a, b: F.struct((b - a).alias("w"), a.alias("lo"), b.alias("hi")))
    return F.array_min(ends)


def total_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def split_chains(rows: Column) -> Column:
    """The halves of the chains, an array each, in an array of (chain, draw, value) in this order. A chain of odd length loses its
    middle draw."""

    def each(first: Column, end: Column) -> Column:
        half = ((end - first) / 2).cast("int")
        return F.transform(F.array(first, end - half), lambda a: F.transform(F.slice(rows, a + 1, half), lambda r: r["value"]))

    places = F.sequence(F.lit(0), F.size(rows) - 1)
    firsts = F.filter(places, lambda i: (i == 0) | (F.get(rows, i)["chain"] != F.get(rows, i - 1)["chain"]))
    return bound(firsts, lambda f: F.flatten(F.zip_with(f, F.concat(F.slice(f, F.lit(2), F.size(f)), F.array(F.size(rows))), each)))


def average_ranks(values: Column) -> Column:
    """The rank of each value of an array, from 1; equal ones share the mean of theirs."""
    n = F.size(values)

    def ranks(order: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(order, i)["x"] != F.get(order, i - 1)["x"]))
        ends = bound(firsts, lambda f: F.zip_with(f, F.concat(F.slice(f, F.lit(2), F.size(f)), F.array(n)), lambda a, b: F.array_repeat((a + 1 + b) / 2, b - a)))
        placed = F.zip_with(order, F.flatten(ends), lambda o, r: F.struct(o["i"], r.alias("r")))
        return F.transform(F.sort_array(placed), lambda o: o["r"])

    return bound(F.sort_array(F.transform(values, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), ranks)


def rank_scores(values: Column) -> Column:
    """Normal scores of the ranks."""
    return bound(average_ranks(values), lambda ranks: F.transform(ranks, lambda r: bound((r - 0.375) / (F.size(ranks) + 0.25), normal_quantile)))


def effective_size(chains: Column, within: Column, between: Column) -> Column:
    """Of centred chains of equal length. Correlations are worked out by pairs of lags, up to the first that isn't positive."""
    n = F.size(F.get(chains, F.lit(0)))
    total = F.size(chains) * n

    def rho(t: Column) -> Column:
        def moved(y: Column) -> Column:
            return total_of(F.zip_with(F.slice(y, F.lit(1), n - t), F.slice(y, t + 1, n - t), lambda a, b: a * b))

        summed = F.aggregate(chains, F.lit(0.0), lambda s, y: s + moved(y))
        return F.when(t == 0, 1.0).otherwise(1 - (within - summed / total) / (within * (n - 1) / n + between))

    def step(s: Column, p: Column) -> Column:
        def grown(pair: Column) -> Column:
            least = F.least(s["least"], pair)
            return F.struct((s["sum"] + F.when(pair > 0, least).otherwise(0.0)).alias("sum"), least.alias("least"), (pair <= 0).alias("over"))

        return F.when(s["over"], s).otherwise(bound(rho(2 * p) + rho(2 * p + 1), grown))

    # the sum of the running minimum of pairs
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"), F.lit(False).alias("over"))
    found = F.aggregate(F.sequence(F.lit(0), (n / 2).cast("int") - 1), start, step, lambda s: s["sum"])
    return total / F.greatest(-1 + 2 * found, 1 / F.log10(total.cast("double")))


def convergence(values: Column, m: Column, n: Column, size: bool = True) -> Column:
    """(ess, r_hat) of ``m`` chains of ``n`` values, one after another in an array; without ``size`` ess is null."""
    chains = F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.slice(values, j * n + 1, n))
    centred = F.transform(chains, lambda x: bound(total_of(x) / n, lambda mean: F.struct(mean.alias("m"), F.transform(x, lambda v: v - mean).alias("y"))))

    def found(parts: Column) -> Column:
        spreads = F.transform(parts, lambda c: F.try_divide(total_of(F.transform(c["y"], lambda y: y * y)), n - 1))
        means = F.transform(parts, lambda c: c["m"])
        apart = bound(total_of(means) / m, lambda mean: total_of(F.transform(means, lambda x: (x - mean) * (x - mean))))
        both = F.struct((total_of(spreads) / m).alias("within"), F.coalesce(F.try_divide(apart, m - 1), F.lit(0.0)).alias("between"))

        def last(s: Column) -> Column:
            within, between = s["within"], s["between"]
            flat = (n < 4) | (F.array_max(values) - F.array_min(values) < 1e-300)
            ess = F.when(flat, (m * n).cast("double")).otherwise(effective_size(F.transform(parts, lambda c: c["y"]), within, between))
            r_hat = F.when(within > 0, F.sqrt((n - 1) / n + between / within)).otherwise(F.lit(float("nan")))
            return F.struct((ess if size else F.lit(None).cast("double")).alias("ess"), r_hat.alias("r_hat"))

        return bound(both, last)

    return bound(centred, found)


def diagnosed(rows: Column, mean: Column, low: Column, high: Column) -> Column:
    """A struct of the sizes and R-hat of an array of (chain, draw, value), of two draws a chain at least."""

    def of_halves(halves: Column) -> Column:
        m, n = F.size(halves), F.size(F.get(halves, F.lit(0)))

        def of_values(x: Column) -> Column:
            middle = of_sorted_once(F.sort_array(x), 0.5)
            kinds = {
                "raw": x, "square": F.transform(x, lambda v: (v - mean) * (v - mean)), "low": F.transform(x, lambda v: (v <= low).cast("double")),
                "high": F.transform(x, lambda v: (v <= high).cast("double")), "z": rank_scores(x),
                "folded": rank_scores(bound(middle, lambda mid: F.transform(x, lambda v: F.abs(v - mid)))),
            }
            with_size, without = (partial(convergence, m=m, n=n, size=size) for size in (True, False))
            each = [bound(v, lambda values: with_size(values)).alias(k) for k, v in kinds.items() if k != "folded"]
            each.append(bound(kinds["folded"], lambda values: without(values)).alias("folded"))
            return F.struct(*each)

        return bound(F.flatten(halves), of_values)

    return bound(split_chains(rows), of_halves)


def of_sorted_once(values: Column, q: float) -> Column:
    return bound(values, lambda v: of_sorted(v, q))


def summary(draws: DataFrame, by=("node", "k"), prob: float = 0.94) -> DataFrame:
    """(*by, mean, sd, hdi_lo, hdi_hi, mcse_mean, mcse_sd, ess_bulk, ess_tail, r_hat): one row for each parameter, by expressions over
    one aggregate. Nulls in ``by`` are values like others. Chains have equal lengths; one parameter's draws are sorted in one
    array (``evaluate.hdi`` and ``vectors.quantiles`` are for more than that holds)."""
    names, taken = list(by), F.col("value").cast("double")
    rows = F.sort_array(F.collect_list(F.struct("chain", "draw", taken.alias("value")))).alias("_r")
    every = draws.groupBy(*names).agg(F.avg(taken).alias("mean"), F.stddev_samp(taken).alias("sd"), F.sort_array(F.collect_list(taken)).alias("_v"), rows)
    # before the diagnostics, as a condition on them would have them worked out twice
    every = every.filter(F.size(F.array_distinct(F.transform("_r", lambda r: r["chain"]))) < F.size("_r"))
    low, high = (of_sorted(F.col("_v"), q).alias(n) for q, n in ((0.05, "_low"), (0.95, "_high")))
    points = F.struct(low, high, narrowest("_v", prob).alias("n"))
    found = bound(points, lambda p: F.struct(p["n"].alias("n"), diagnosed(F.col("_r"), F.col("mean"), p["_low"], p["_high"]).alias("d")))
    found = every.select(*names, "mean", "sd", found.alias("_f"))

    def known(kind: str) -> Column:
        x = F.col(f"_f.d.{kind}.r_hat")
        return F.when(~F.isnan(x), x)

    def size(kind: str) -> Column:
        return F.col(f"_f.d.{kind}.ess")

    return found.select(
        *names, "mean", F.coalesce("sd", F.lit(float("nan"))).alias("sd"), F.col("_f.n.lo").alias("hdi_lo"),
        F.col("_f.n.hi").alias("hdi_hi"), (F.col("sd") / F.sqrt(size("raw"))).alias("mcse_mean"), (F.col("sd") / F.sqrt(2 * size("square"))).alias("mcse_sd"),
        size("z").alias("ess_bulk"), F.least(size("low"), size("high")).alias("ess_tail"),
        F.coalesce(F.greatest(known("z"), known("folded")), F.lit(float("nan"))).alias("r_hat"),
    )
