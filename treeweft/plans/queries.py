"""The library's queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeweft.functions import arrays, rng, tables, vectors
from treeweft.operators import assign, diagnostics, evaluate, plotdata, sticks, tree
from treeweft.operators.simulate import grown_forest
from treeweft.plans import domain as D
from treeweft.plans import mcmc_sql
from treeweft.plans.lineage import settled, shared_root
from treeweft.sources import files, netcdf, newick

K, CHANNELS = D.K, D.CHANNELS
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
PIECES, ALPHA = 20, 2.0


def query(sql: str | None = None, more: str = "", recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = D.sql(sql, more, recursive)
        return f

    return add


def r6(c, name: str | None = None):
    """Rounded, so that the order of a sum does not show."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def components(value: str, ks, some=None) -> Column:
    """Over a group of one row a component: the values as an array, in slots of fixed size that need no sort; nulls for those
    not in ``some``."""
    return F.array(*[F.max(F.when(F.col("k") == k, F.col(value))) if some is None or k in some else F.lit(None).cast("double") for k in ks])


def ids(spark: SparkSession, n: int, name: str) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias(name))


# ---- trees

DEPTHS = """
depths AS (
  SELECT DISTINCT tumour, parent AS node, 0 AS depth FROM edges e WHERE parent NOT IN (SELECT child FROM edges)
  UNION ALL
  SELECT e.tumour, e.child, d.depth + 1 FROM depths d JOIN edges e ON e.parent = d.node AND e.tumour = d.tumour
)"""


@query("SELECT * FROM depths", DEPTHS, True)
def node_depth(spark, d):
    return tree.depths(D.edges(spark, d))


@query("SELECT DISTINCT tumour, parent AS node FROM edges WHERE parent NOT IN (SELECT child FROM edges)")
def roots(spark, d):
    return tree.roots(D.edges(spark, d))


@query("SELECT depth, count(*) OVER (PARTITION BY depth) AS n_nodes, node FROM depths", DEPTHS, True)
def nodes_by_depth(spark, d):
    return tree.by_depth(tree.depths(D.edges(spark, d)))


@query("SELECT node, (row_number() OVER (ORDER BY depth, node))::INT AS position FROM depths", DEPTHS, True)
def topological_order(spark, d):
    return tree.topological(tree.depths(D.edges(spark, d))).select("node", "position")


GROWN = """grown AS (
  SELECT t::INT AS tumour, 0 AS step, (3 + floor(unif('leaves|42|' || t) * 3))::INT AS size, [0] AS leaves, 1 AS made, -1 AS split FROM (SELECT s_suppkey AS t FROM supplier)
  UNION ALL
  SELECT tumour, step + 1, size, list_concat(list_concat(leaves[1:i], leaves[i + 2:]), [made, made + 1]), made + 2, leaves[i + 1]
  FROM (SELECT *, floor(unif('split|42|' || tumour || '|' || step) * len(leaves))::INT AS i FROM grown WHERE len(leaves) < size)
), labels_ AS (
  SELECT tumour, 'T' || (tumour + 1) || '_' || (split + 1) AS parent, 'T' || (tumour + 1) || '_' || (c + 1) AS child
  FROM (SELECT tumour, split, unnest([made - 2, made - 1]) AS c FROM grown WHERE step > 0)
)"""


@query("SELECT tumour, parent, child, (100 + floor(unif('branch|42|' || child) * 2901))::DOUBLE AS length FROM labels_", GROWN, True)
def random_trees(spark, d):
    """A tree a supplier."""
    return grown_forest(D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), 3, 5, 42)


@query("SELECT max(depth) AS max_depth FROM depths", DEPTHS, True)
def max_depth(spark, d):
    return tree.depths(D.edges(spark, d)).agg(F.max("depth").alias("max_depth"))


@query("SELECT tumour, parent, child, round(length, 6) AS length FROM edges")
def edge_list(spark, d):
    return D.edges(spark, d).filter("parent is not null").select("tumour", "parent", "child", r6("length"))


@query("SELECT child, count(*) AS in_degree FROM edges GROUP BY child")
def in_degree(spark, d):
    return tree.in_degrees(D.edges(spark, d))


CLOSURE = f"""{DEPTHS}, closure AS (
  SELECT tumour, node AS anc, node FROM depths
  UNION ALL
  SELECT c.tumour, e.parent, c.node FROM closure c JOIN edges e ON e.child = c.anc AND e.tumour = c.tumour
), paths AS (
  SELECT tumour, node, depth, [node] AS path FROM depths WHERE depth = 0
  UNION ALL
  SELECT e.tumour, e.child, p.depth + 1, list_append(path, e.child) FROM paths p JOIN edges e ON e.parent = p.node AND e.tumour = p.tumour
), placed AS (
  SELECT tumour, node, depth, size, row_number() OVER (PARTITION BY tumour ORDER BY path) - 1 AS entry
  FROM paths JOIN (SELECT tumour, anc AS node, count(*) AS size FROM closure GROUP BY ALL) USING (tumour, node)
)"""


@query("SELECT c.node, c.anc AS root, d.depth FROM closure c JOIN depths d ON d.node = c.node WHERE d.depth > 0 AND c.anc IN (SELECT node FROM depths WHERE depth = 0)", CLOSURE, True)
def node_roots(spark, d):
    return tree.to_roots(D.edges(spark, d)).select("node", "root", "depth")


@query("SELECT tumour, node, depth, size, entry, entry + size - 1 AS exit FROM placed", CLOSURE, True)
def tree_intervals(spark, d):
    return tree.intervals(D.edges(spark, d)).select("tumour", "node", "depth", "size", "entry", "exit")


@query("SELECT anc AS node, coalesce(sum(n), 0)::BIGINT AS mutations FROM closure c LEFT JOIN counts USING (node) GROUP BY anc", CLOSURE, True)
def subtree_totals(spark, d):
    """Mutations of a node and all below it."""
    placed = tree.intervals(D.edges(spark, d))
    own = D.counts(spark, d).groupBy("node").agg(F.sum("n").alias("mutations"))
    return tree.within(placed, placed.join(own, "node"), "mutations").select("node", "mutations")


@query("""SELECT z.node, z.k, count(a.node) AS n_violations FROM zeros z JOIN closure c ON c.anc = z.node
LEFT JOIN activities a ON a.node = c.node AND a.k = z.k AND a.true_e > 0 GROUP BY z.node, z.k""",
       f"""{CLOSURE}, zeros AS (SELECT node, k::INT AS k FROM inner_nodes, range(10) t(k) WHERE unif('off|' || node || '|' || k) < 0.2)""", True)
def inheritance(spark, d):
    """What is off in a node has to be off in all below it: for each, how many nodes break that."""
    off = D.inner_nodes(spark, d).select("node", F.explode(F.sequence(F.lit(0), F.lit(K - 1))).alias("k"))
    off = off.filter(rng.uniform("off", F.col("node"), F.col("k")) < 0.2)
    placed = tree.intervals(D.edges(spark, d)).select("tumour", "node", "entry", "exit")
    on = D.activities(spark, d).filter("true_e > 0").select("node", "k", F.lit(1).alias("n_violations"))
    return tree.within(placed.join(off, "node"), placed.join(on, "node"), "n_violations", "k").select("node", "k", "n_violations")


@query("SELECT tumour, parent, child, round(length, 6) AS length FROM edges")
def newick_round_trip(spark, d):
    text = newick.text_rows(D.edges(spark, d))
    return newick.parse_parts(text, "text", ["tumour", "position"], "tumour").select("tumour", "parent", "child", r6("length"))


@query("SELECT tumour, parent, child, round(length, 6) AS length FROM edges")
def newick_table_function(spark, d):
    tables.register(spark)
    newick.text_rows(D.edges(spark, d)).createOrReplaceTempView("treeweft_newick")
    return spark.sql("SELECT tumour, parent, child, round(length, 6) AS length FROM newick_edges(TABLE(treeweft_newick))")


@query("""SELECT child, any_value(parent) AS parent FROM (SELECT * FROM edges WHERE tumour <= 2 UNION ALL SELECT * FROM edges WHERE tumour >= 2) GROUP BY child""")
def forest_union(spark, d):
    e = D.edges(spark, d)
    return tree.union(e.filter("tumour <= 2"), e.filter("tumour >= 2")).select("child", "parent")


@query("""
SELECT (SELECT count(DISTINCT tumour) FROM edges) AS n_tumours, (SELECT count(*) FROM allnodes) AS n_nodes_total,
       count_if(m > 0)::BIGINT AS n_nodes_observed, round(avg(m), 6) AS mean_mutations, min(m)::BIGINT AS min_mutations, max(m)::BIGINT AS max_mutations
FROM (SELECT a.node, coalesce(sum(n), 0) AS m FROM allnodes a LEFT JOIN counts c ON a.node = c.node GROUP BY a.node)
""", "allnodes AS (SELECT parent AS node FROM edges UNION SELECT child FROM edges)")
def forest_summary(spark, d):
    from treeweft.operators.simulate import summary

    total = D.counts(spark, d).groupBy(F.col("node").alias("_n")).agg(F.sum("n").alias("m"))
    every = tree.nodes(D.edges(spark, d)).join(total, F.col("node") == F.col("_n"), "left")
    truth = every.select("tumour", F.coalesce("m", F.lit(0)).alias("num_mutations"))
    found = summary(truth, K, K, 1.0)
    return found.select("n_tumours", "n_nodes_total", "n_nodes_observed", r6("mean_mutations"), "min_mutations", "max_mutations")


# ---- vectors and matrices


@query("SELECT node, channel, n::DOUBLE / (sum(n) OVER (PARTITION BY node))::DOUBLE AS share FROM counts")
def row_normalise(spark, d):
    return plotdata.relative_profiles(D.counts(spark, d))


@query("SELECT k, count(*) AS n_channels, round(sum(p), 6) AS total, count_if(p < 0)::BIGINT AS n_negative, abs(sum(p) - 1) <= 1e-6 AS sums_to_one FROM signatures GROUP BY k")
def signature_validation(spark, d):
    s = D.signatures(spark, d).groupBy("k")
    return s.agg(F.count("*").alias("n_channels"), r6(F.sum("p"), "total"), F.count_if(F.col("p") < 0).alias("n_negative"), (F.abs(F.sum("p") - 1) <= 1e-6).alias("sums_to_one"))


@query("SELECT node, channel, round(sum(true_e * p), 6) AS q FROM activities JOIN signatures USING (k) GROUP BY node, channel")
def expected_profile(spark, d):
    found = vectors.product(D.activities(spark, d), D.signatures(spark, d), "k", ["node", "channel"], "true_e", "p", "q")
    return found.select("node", "channel", r6("q"))


@query("""SELECT a.k AS a, b.k AS b, round(sum(a.p / (a.n + 1e-12::DOUBLE) * (b.p / (b.n + 1e-12::DOUBLE))), 6) AS cosine
FROM s a JOIN s b ON a.channel = b.channel AND a.odd = 1 AND b.odd = 0 GROUP BY ALL""",
       "s AS (SELECT *, sqrt(sum(p * p) OVER (PARTITION BY odd, k)) AS n FROM vecsig)")
def cosine_matrix(spark, d):
    found = vectors.cosine_matrix(D.vector_signatures(spark, d, 1), D.vector_signatures(spark, d, 0))
    return found.select("a", "b", r6("cosine"))


@query("""SELECT node, rank, k, round(true_e, 6) AS true_e FROM (
SELECT *, (row_number() OVER (PARTITION BY node ORDER BY true_e DESC, k DESC))::INT AS rank FROM activities) WHERE rank <= 3""")
def top_signatures(spark, d):
    return vectors.top_k(D.activities(spark, d), "node", "true_e", "k", 3).select("node", "rank", "k", r6("true_e"))


@query("SELECT node, " + ", ".join(f"round(coalesce(sum({s}_e) FILTER (WHERE k = {k}), 0), 6) AS {s}_k{k}" for s in ("true", "inferred") for k in range(K)) + " FROM activities GROUP BY node")
def wide_activities(spark, d):
    found = evaluate.wide(D.activities(spark, d), K)
    return found.select("node", *[r6(c) for c in found.columns if c != "node"])


@query("SELECT node, " + ", ".join(f"coalesce(sum(n) FILTER (WHERE channel = {c}), 0)::BIGINT AS Channel_{c}" for c in range(CHANNELS)) + " FROM counts GROUP BY node")
def count_matrix(spark, d):
    return files.to_matrix(D.lines(spark, d), "node", "channel", "quantity", [(c, f"Channel_{c}") for c in range(CHANNELS)], F.lit(0).cast("bigint"))


@query("SELECT node, channel, n FROM counts WHERE n > 0")
def unpivoted_counts(spark, d):
    return files.from_matrix(count_matrix(spark, d), "node", "channel", "n", "Channel_").filter("n > 0")


@query("""SELECT node, draw, k, round(exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY node, draw), 6) AS e FROM (
SELECT *, max(x) OVER (PARTITION BY node, draw) AS m FROM (
SELECT node, chain * 1000 + draw AS draw, k, CASE WHEN k = 9 THEN 0 ELSE ln(value) END AS x FROM draws))""")
def softmax_draws(spark, d):
    rows = D.draws(spark, d).filter(F.col("k") < K - 1).groupBy("node", (F.col("chain") * 1000 + F.col("draw")).alias("draw"))
    rows = rows.agg(components("value", range(K - 1)).alias("value"))
    rows = rows.withColumn("eta", F.transform("value", F.ln))
    return rows.select("node", "draw", F.posexplode(arrays.softmax_last_zero("eta")).alias("k", "e")).select("node", "draw", "k", r6("e"))


@query("SELECT k, list_extract(list(p ORDER BY channel), 1)::DOUBLE IS NOT NULL AS has_first, round(list_sum(list_transform(list(p ORDER BY channel), lambda x: x * x)), 6) AS sq FROM signatures GROUP BY k")
def packed_rows(spark, d):
    rows = D.signatures(spark, d).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "p"))), lambda s: s["p"]).alias("v"))
    return rows.select("k", F.get("v", F.lit(0)).isNotNull().alias("has_first"), r6(arrays.dot("v", "v"), "sq"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 4.0::DOUBLE, 0) AS quarter, l_quantity::DOUBLE / 96 AS share FROM lineitem")
def half_even_and_fractions(spark, d):
    share = arrays.fraction(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("/96")))
    keys = ("l_orderkey", "l_linenumber", "l_partkey")
    return D.table(spark, d, "lineitem").select(*keys, F.bround(F.col("l_quantity") / 4.0, 0).alias("quarter"), share.alias("share"))


# ---- filters and joins


@query("SELECT c.node, sum(n)::BIGINT AS total FROM counts c WHERE c.node IN (SELECT child FROM edges) GROUP BY c.node HAVING sum(n) > 0")
def observed_nodes(spark, d):
    inside = D.edges(spark, d).select(F.col("child").alias("node"))
    return D.counts(spark, d).join(inside, "node", "left_semi").groupBy("node").agg(F.sum("n").alias("total")).filter("total > 0")


@query("SELECT DISTINCT e.child AS node FROM edges e LEFT JOIN counts c ON e.child = c.node WHERE c.node IS NULL")
def zero_nodes(spark, d):
    return D.edges(spark, d).select(F.col("child").alias("node")).join(D.counts(spark, d), "node", "left_anti").distinct()


@query("SELECT c.child AS node, c.parent, p.parent AS grandparent FROM edges c LEFT JOIN edges p ON p.child = c.parent AND p.tumour = c.tumour")
def parents_of_parents(spark, d):
    e = D.edges(spark, d)
    up = e.select(F.col("tumour").alias("t"), F.col("child").alias("c"), F.col("parent").alias("grandparent"))
    return e.join(up, (F.col("t") == F.col("tumour")) & (F.col("c") == F.col("parent")), "left").select(F.col("child").alias("node"), "parent", "grandparent")


@query("SELECT prefix, min(child) AS node FROM (SELECT child, substr(child, 1, 2) AS prefix FROM edges WHERE child LIKE 'C1%' OR child LIKE 'C2%' OR child LIKE 'C3%') GROUP BY prefix")
def first_by_prefix(spark, d):
    rows = D.edges(spark, d).select("child", F.substring("child", 1, 2).alias("prefix"))
    rows = rows.filter(F.startswith("child", F.lit("C1")) | F.startswith("child", F.lit("C2")) | F.startswith("child", F.lit("C3")))
    first = F.row_number().over(Window.partitionBy("prefix").orderBy("child"))
    return rows.withColumn("r", first).filter("r = 1").select("prefix", F.col("child").alias("node"))


@query("SELECT node, k, true_e > 0 AS active, CASE WHEN true_e < 0.01 THEN 'near-zero' ELSE 'active' END AS label FROM activities")
def near_zero_flags(spark, d):
    return D.activities(spark, d).select("node", "k", (F.col("true_e") > 0).alias("active"), evaluate.near_zero("true_e").alias("label"))


@query("SELECT DISTINCT node FROM activities INTERSECT SELECT child FROM edges")
def common_nodes(spark, d):
    return D.activities(spark, d).select("node").intersect(D.edges(spark, d).select("child"))


# ---- evaluation

RECOVERY = """recovery AS (
  SELECT node, sum(abs(true_e - inferred_e)) / 10 AS mae,
         sum(true_e * inferred_e) / (sqrt(sum(true_e * true_e)) * sqrt(sum(inferred_e * inferred_e)) + 1e-12::DOUBLE) AS cosine_similarity
  FROM activities GROUP BY node
)"""


@query("SELECT node, round(mae, 6) AS mae, round(cosine_similarity, 6) AS cosine_similarity FROM recovery", RECOVERY)
def activity_recovery(spark, d):
    return evaluate.recovery(D.activities(spark, d), K).select("node", r6("mae"), r6("cosine_similarity"))


WIDE = ", ".join(f"round(coalesce(sum({s}_e) FILTER (WHERE k = {k}), 0), 6) AS {s}_k{k}" for s in ("true", "inferred") for k in range(K))


@query("SELECT r.node, depth, round(mae, 6) AS mae, round(cosine_similarity, 6) AS cosine_similarity, w.* EXCLUDE (node) FROM recovery r JOIN w USING (node) LEFT JOIN depths d ON d.node = r.node",
       f"{DEPTHS}, {RECOVERY}, w AS (SELECT node, {WIDE} FROM activities GROUP BY node)", True)
def compare_activities(spark, d):
    found = evaluate.compare_activities(D.activities(spark, d), tree.depths(D.edges(spark, d)), K)
    return found.select("node", "depth", *[r6(c) for c in found.columns if c not in ("node", "depth")])


CORR = """corr AS (
  SELECT node, d.k AS signature, covar_pop(d.value, s.value) / nullif(stddev_pop(d.value) * stddev_pop(s.value), 0) AS correlation,
         avg(d.value) AS mean_activity
  FROM draws d JOIN sigma s USING (chain, draw) GROUP BY node, d.k
)"""


def correlations(spark, d) -> DataFrame:
    return evaluate.global_correlations(D.draws(spark, d), D.global_draws(spark, d))


@query("SELECT node, signature, round(correlation, 6) AS correlation_with_alpha, round(mean_activity, 6) AS mean_activity FROM corr", CORR)
def alpha_correlations(spark, d):
    return correlations(spark, d).select("node", "signature", r6("correlation", "correlation_with_alpha"), r6("mean_activity"))


@query("""SELECT count(*) AS n, count_if(abs(correlation) > 0.3)::BIGINT AS n_strong, round(100.0::DOUBLE * count_if(abs(correlation) > 0.3) / count(*), 6) AS pct_strong,
round(avg(abs(correlation)), 6) AS mean_abs, round(max(abs(correlation)), 6) AS max_abs FROM corr""", CORR)
def correlation_summary(spark, d):
    found = evaluate.correlation_summary(correlations(spark, d))
    return found.select("n", "n_strong", r6("pct_strong"), r6("mean_abs"), r6("max_abs"))


@query("SELECT node, signature, round(correlation, 6) AS correlation FROM corr ORDER BY abs(correlation) DESC NULLS LAST, node, signature LIMIT 10", CORR)
def strongest_correlations(spark, d):
    return evaluate.strongest(correlations(spark, d)).select("node", "signature", r6("correlation"))


@query("SELECT CASE WHEN mean_activity < 0.01 THEN 'near-zero' ELSE 'active' END AS activity, count(*) AS n, round(avg(abs(correlation)), 6) AS mean_abs FROM corr GROUP BY 1", CORR)
def correlation_by_activity(spark, d):
    rows = correlations(spark, d).withColumn("activity", evaluate.near_zero("mean_activity"))
    return rows.groupBy("activity").agg(F.count("*").alias("n"), r6(F.avg(F.abs("correlation")), "mean_abs"))


@query("SELECT node, k, round(avg(value), 6) AS mean FROM draws GROUP BY node, k")
def posterior_means(spark, d):
    return evaluate.posterior_means(D.draws(spark, d)).select("node", "k", r6("mean"))


HDI = """sorted AS (
  SELECT node, k, value, row_number() OVER (PARTITION BY node, k ORDER BY value) AS i, count(*) OVER (PARTITION BY node, k) AS n FROM draws
), spans AS (
  SELECT a.node, a.k, a.value AS lo, b.value AS hi
  FROM sorted a JOIN sorted b ON a.node = b.node AND a.k = b.k AND b.i = a.i + least(floor(a.n * PROB), a.n - 1)
), hdi AS (
  SELECT node, k, lo, hi FROM spans QUALIFY row_number() OVER (PARTITION BY node, k ORDER BY hi - lo, lo) = 1
)"""


@query("SELECT node, k, round(lo, 6) AS lo, round(hi, 6) AS hi FROM hdi", HDI.replace("PROB", "0.97::DOUBLE"))
def hdi_97(spark, d):
    return evaluate.hdi(D.draws(spark, d), ["node", "k"], "value", 0.97).select("node", "k", r6("lo"), r6("hi"))


@query("SELECT node, k, round(lo, 6) AS lo, round(hi, 6) AS hi FROM hdi", HDI.replace("PROB", "0.94::DOUBLE"))
def hdi_94(spark, d):
    return evaluate.hdi(D.draws(spark, d), ["node", "k"], "value", 0.94).select("node", "k", r6("lo"), r6("hi"))


@query("""SELECT 1.0::DOUBLE AS true_alpha, round(m, 6) AS posterior_mean, round(s, 6) AS posterior_sd, round(lo, 6) AS "hdi_3%", round(hi, 6) AS "hdi_97%", lo <= 1 AND hi >= 1 AS true_in_hdi
FROM (SELECT avg(value) AS m, stddev_pop(value) AS s FROM sigma), (SELECT a.value AS lo, b.value AS hi FROM o a JOIN o b ON b.i = a.i + a.span ORDER BY hi - lo, lo LIMIT 1)""",
       "o AS (SELECT value, row_number() OVER (ORDER BY value) AS i, least(floor(0.97::DOUBLE * count(*) OVER ()), count(*) OVER () - 1) AS span FROM sigma)")
def compare_alpha(spark, d):
    found = evaluate.compare_global(D.global_draws(spark, d), 1.0, 0.97)
    return found.select("true_alpha", r6("posterior_mean"), r6("posterior_sd"), r6("`hdi_3%`", "hdi_3%"), r6("`hdi_97%`", "hdi_97%"), "true_in_hdi")


RHAT = """halves AS (
  SELECT node, k, chain, CASE WHEN draw < 25 THEN 0 ELSE 1 END AS half, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM draws GROUP BY ALL
), rhat AS (
  SELECT node, k, sqrt(((max(n) - 1)::DOUBLE / max(n) * avg(v) + var_samp(m)) / nullif(avg(v), 0)) AS r_hat FROM halves GROUP BY node, k
)"""
MCMC = mcmc_sql.diagnostics(D.CHAINS, D.DRAWS).strip()


SIZES = ("mean", "sd", "ess_bulk", "ess_tail", "r_hat")


def depth_stats_rows(spark, d) -> DataFrame:
    """Each parameter's summary with its node's depth, worked out once."""
    return settled(diagnostics.summary(D.draws(spark, d), ("node", "k")).join(D.inner_nodes(spark, d), "node"))


@query("SELECT node, k, round(r_hat, 6) AS r_hat FROM rhat", RHAT)
def split_r_hat(spark, d):
    return diagnostics.split_r_hat(D.draws(spark, d), ["node", "k"]).select("node", "k", r6("r_hat"))


@query("SELECT node, k, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "sd", "hdi_lo", "hdi_hi", "mcse_mean", "mcse_sd", "ess_bulk", "ess_tail", "r_hat")) + " FROM mc", MCMC)
def mcmc_summary(spark, d):
    found = diagnostics.summary(D.draws(spark, d), ("node", "k"))
    return found.select("node", "k", *[r6(c) for c in found.columns if c not in ("node", "k")])


@query("SELECT node, depth, k AS signature, " + ", ".join(f"round({c}, 6) AS {c}" for c in SIZES) + " FROM stats", MCMC)
def depth_stats(spark, d):
    return depth_stats_rows(spark, d).select("node", "depth", F.col("k").alias("signature"), *map(r6, SIZES))


@query("SELECT depth, " + ", ".join(f"round(median({c}), 6) AS median_{c}" for c in SIZES[1:]) + " FROM stats GROUP BY depth", MCMC)
def depth_medians(spark, d):
    found = evaluate.medians(depth_stats_rows(spark, d), "depth", SIZES[1:])
    return found.select("depth", *[r6(f"median_{c}") for c in SIZES[1:]])


@query("""SELECT count(*) AS n, count_if(r_hat > 1.01)::BIGINT AS n_bad_r_hat, round(100.0::DOUBLE * count_if(r_hat > 1.01) / count(*), 6) AS pct_bad_r_hat,
count_if(ess_bulk < 100)::BIGINT AS n_low_ess, round(100.0::DOUBLE * count_if(ess_bulk < 100) / count(*), 6) AS pct_low_ess FROM stats""", MCMC)
def convergence_gates(spark, d):
    found = evaluate.gates(depth_stats_rows(spark, d))
    return found.select("n", "n_bad_r_hat", r6("pct_bad_r_hat"), "n_low_ess", r6("pct_low_ess"))


# the best assignment of all labels: of the ways to take the same inferred labels (a mask) only the best goes on
BEST = """s AS (SELECT *, sqrt(sum(p * p) OVER (PARTITION BY odd, k)) AS n FROM vecsig), cosm AS (
  SELECT a.k AS a, b.k AS b, sum(a.p / (a.n + 1e-12::DOUBLE) * (b.p / (b.n + 1e-12::DOUBLE))) AS c
  FROM s a JOIN s b ON a.channel = b.channel AND a.odd = 1 AND b.odd = 0 GROUP BY ALL
), tries AS (
  SELECT 0 AS b, 0 AS mask, 0.0::DOUBLE AS total, []::INT[] AS picks
  UNION ALL
  SELECT b + 1, mask, max(total), arg_max(picks, total) FROM (
    SELECT t.b, t.mask | (1 << m.a) AS mask, t.total + m.c AS total, list_append(t.picks, m.a) AS picks
    FROM tries t JOIN cosm m ON m.b = t.b AND (t.mask & (1 << m.a)) = 0) GROUP BY b, mask
), best AS (SELECT picks FROM tries ORDER BY b DESC, total DESC LIMIT 1), pairs AS (
  SELECT unnest(range(0, len(picks)))::INT AS true_k, unnest(picks)::INT AS matched FROM best
)"""


def aligned(spark, d):
    inferred, true = D.vector_signatures(spark, d, 1), D.vector_signatures(spark, d, 0)
    return inferred, true, assign.align(inferred, true)


@query("SELECT true_k, matched, round(c, 6) AS cosine FROM pairs JOIN cosm ON a = matched AND b = true_k", BEST, True)
def align_signatures(spark, d):
    return aligned(spark, d)[2].select("true_k", "matched", r6("cosine"))


@query("""SELECT 'True_Sig_' || true_k AS true_signature, matched AS matched_inferred_idx, round(avg(abs(t.p - i.p)), 6) AS mae,
round(sum(t.p * i.p) / (sqrt(sum(t.p * t.p)) * sqrt(sum(i.p * i.p)) + 1e-12::DOUBLE), 6) AS cosine_similarity
FROM pairs JOIN vecsig t ON t.odd = 0 AND t.k = true_k JOIN vecsig i ON i.odd = 1 AND i.k = matched AND i.channel = t.channel GROUP BY true_k, matched""", BEST, True)
def compare_signatures(spark, d):
    found = evaluate.compare_signatures(*aligned(spark, d))
    return found.select("true_signature", "matched_inferred_idx", r6("mae"), r6("cosine_similarity"))


UNKNOWN = f"""{DEPTHS}, {BEST}, both_ AS (
  SELECT a.node, true_k AS k, coalesce(t.true_e, 0) AS true_e, coalesce(i.inferred_e, 0) AS inferred_e
  FROM (SELECT DISTINCT node FROM activities) a CROSS JOIN pairs LEFT JOIN activities t ON t.node = a.node AND t.k = true_k
  LEFT JOIN activities i ON i.node = a.node AND i.k = matched
), found AS (
  SELECT node, sum(abs(true_e - inferred_e)) / 10 AS mae,
         sum(true_e * inferred_e) / (sqrt(sum(true_e * true_e)) * sqrt(sum(inferred_e * inferred_e)) + 1e-12::DOUBLE) AS cosine_similarity, {WIDE}
  FROM both_ GROUP BY node
)"""


@query("SELECT f.node, depth, round(mae, 6) AS mae, round(cosine_similarity, 6) AS cosine_similarity, f.* EXCLUDE (node, mae, cosine_similarity) FROM found f LEFT JOIN depths d ON d.node = f.node", UNKNOWN, True)
def compare_activities_unknown(spark, d):
    pairs = evaluate.realigned(D.activities(spark, d), aligned(spark, d)[2])
    found = evaluate.compare_activities(pairs, tree.depths(D.edges(spark, d)), K)
    return found.select("node", "depth", *[r6(c) for c in found.columns if c not in ("node", "depth")])


# ---- random draws by key

STICKS = """v AS (
  SELECT node, k::INT AS k, 1.0 - pow(1.0 - unif('stick|' || node || '|' || k), 1.0::DOUBLE / 2.0) AS v FROM inner_nodes, range(128) t(k)
), w AS (
  SELECT node, k, v, exp(coalesce(sum(ln(1 - v)) OVER (PARTITION BY node ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rest FROM v
), deep AS (
  SELECT node, k, v * rest AS weight, rest, rest * (1 - v) AS rest_after FROM w
), sticks AS (
  SELECT node, k, weight, sum(weight) OVER (PARTITION BY node ORDER BY k) AS hi FROM deep WHERE k < 20
), picks AS (
  SELECT q.node, q.draw, k FROM (SELECT node, draw::INT AS draw, unif('pick|' || node || '|' || draw) AS u FROM inner_nodes, range(30) t(draw)) q
  JOIN deep s ON s.node = q.node AND 1 - q.u <= s.rest AND 1 - q.u > s.rest_after
)"""


@query("SELECT node, k, round(weight, 6) AS weight, round(hi - weight, 6) AS cum_lo, round(hi, 6) AS cum_hi FROM sticks", STICKS)
def stick_breaking(spark, d):
    found = sticks.sticks(D.inner_nodes(spark, d).select("node"), PIECES, ALPHA)
    return found.select("node", "k", r6("weight"), r6("cum_lo"), r6("cum_hi"))


@query("SELECT * FROM picks", STICKS)
def atom_select(spark, d):
    return sticks.sample(D.inner_nodes(spark, d).select("node"), 30, ALPHA)


def _level(depth: int) -> str:
    """Requests at the nodes of one depth, and the pieces that they fall into."""
    below = f"UNION SELECT parent, 'atom|' || node || '|' || k FROM p{depth + 1}" if depth < 2 else ""
    return f"""q{depth} AS (
  SELECT node, key, unif('tree|' || node || '|' || key) AS u FROM (
    SELECT node, 'draw|' || draw AS key FROM every, range(3) t(draw) WHERE depth = {depth} {below})
), p{depth} AS (
  SELECT q.node, e.parent, q.key, s.k FROM q{depth} q JOIN every e ON e.node = q.node
  JOIN pieces s ON s.node = q.node AND 1 - q.u <= s.rest AND 1 - q.u > s.rest_after
)"""


def _answer(depth: int) -> str:
    if not depth:
        return "a0 AS (SELECT node, key, node AS root, k FROM p0)"
    return f"""a{depth} AS (
  SELECT p.node, p.key, a.root, a.k FROM p{depth} p JOIN a{depth - 1} a ON a.node = p.parent AND a.key = 'atom|' || p.node || '|' || p.k)"""


HIERARCHY = f"""{DEPTHS}, every AS (
  SELECT d.node, d.depth, e.parent FROM depths d LEFT JOIN edges e ON e.child = d.node
), pieces AS (
  SELECT node, k, exp(coalesce(sum(ln(1 - v)) OVER (PARTITION BY node ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rest,
         rest * (1 - v) AS rest_after
  FROM (SELECT node, k::INT AS k, 1.0 - pow(1.0 - unif('tree-stick|' || node || '|' || k), 1.0::DOUBLE / 2.0) AS v FROM every, range(64) t(k))
), {", ".join(map(_level, (2, 1, 0)))}, {", ".join(map(_answer, (0, 1, 2)))}, answers AS (
  SELECT node, substr(key, 6)::INT AS draw, root, k FROM (SELECT * FROM a0 UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2) WHERE key LIKE 'draw|%'
)"""


def hierarchy(spark, d):
    e = D.edges(spark, d)
    forest = tree.nodes(e).join(tree.depths(e), ["tumour", "node"])
    asked = forest.select("node", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("draw"))
    return sticks.tree_draws(forest.select("node", "parent", "depth"), asked, ALPHA)


# the 64 pieces of a stick are a bound of the SQL; the library breaks as many as it needs
@query("SELECT * FROM answers", HIERARCHY, True)
def hierarchical_draws(spark, d):
    """Three draws of each node of the forest, as atoms of the roots."""
    return hierarchy(spark, d)


@query("""SELECT parent, count(*) AS n_draws, count(DISTINCT (root, k)) AS n_atoms, max(c)::BIGINT AS most_siblings
FROM (SELECT e.parent, a.*, count(DISTINCT a.node) OVER (PARTITION BY e.parent, root, k) AS c FROM answers a JOIN edges e ON e.child = a.node) GROUP BY parent""", HIERARCHY, True)  # fmt: skip
def shared_atoms(spark, d):
    """How few atoms the draws of siblings are, and how many siblings have one in common."""
    up = D.edges(spark, d).select("parent", F.col("child").alias("node"))
    found = hierarchy(spark, d).join(up, "node").groupBy("parent", "root", "k")
    found = found.agg(F.count("*").alias("n"), F.count_distinct("node").alias("c"))
    return found.groupBy("parent").agg(F.sum("n").alias("n_draws"), F.count("*").alias("n_atoms"), F.max("c").alias("most_siblings"))


DIR1 = """g AS (SELECT (i // 96)::INT AS k, (i % 96)::INT AS channel, -ln(unif('atom|' || (i // 96) || '|' || (i % 96))) AS g FROM range(20 * 96) t(i)),
atoms AS (SELECT k, channel, g / sum(g) OVER (PARTITION BY k) AS p FROM g)"""
DEEP = DIR1.replace("20 * 96", "128 * 96")
PARTS = """cells_ AS (SELECT p_partkey AS k, c::INT AS channel FROM part, range(96) t(c)), g AS (SELECT k, channel, -ln(unif('atom|' || k || '|' || channel)) AS g FROM cells_),
atoms AS (SELECT k, channel, g / sum(g) OVER (PARTITION BY k) AS p FROM g)"""


def parts(spark, d):
    """A component a part."""
    return D.table(spark, d, "part").select(F.col("p_partkey").alias("k"))


@query("SELECT k, channel, round(p, 6) AS p FROM atoms", PARTS)
def dirichlet_one(spark, d):
    return sticks.atoms(parts(spark, d), CHANNELS).select("k", "channel", r6("p"))


@query("""SELECT k, channel, round(g / sum(g) OVER (PARTITION BY k), 6) AS p FROM (SELECT k, channel,
-ln(unif('half|' || k || '|' || channel || '|size')) * pow(cos(2 * pi() * unif('half|' || k || '|' || channel || '|turn')), 2) AS g FROM cells_)""", PARTS)
def dirichlet_half(spark, d):
    return sticks.atoms(parts(spark, d), CHANNELS, "half", 0.5).select("k", "channel", r6("p"))


@query("""SELECT q.node, q.draw, q.k, channel FROM (SELECT *, unif('channel|' || node || '|' || draw || '|' || k) AS u FROM picks) q
JOIN (SELECT *, sum(p) OVER (PARTITION BY k ORDER BY channel) AS h FROM atoms) a ON a.k = q.k AND q.u >= h - p AND q.u < h""", f"{STICKS}, {DEEP}")
def sampled_channels(spark, d):
    picks = atom_select(spark, d)
    return sticks.sample_channel(sticks.atoms(picks.select("k").distinct(), CHANNELS), picks)


@query("""SELECT k, channel, round(m / sum(m) OVER (PARTITION BY k), 6) AS p FROM (
SELECT o.k, o.channel, pow(0.3 * b.p + 0.7 * o.p, 1.5) AS m FROM o JOIN b USING (channel))""",
       """o AS (SELECT k, channel, g / sum(g) OVER (PARTITION BY k) AS p FROM (SELECT p_partkey AS k, c::INT AS channel, -ln(unif('own|' || p_partkey || '|' || c)) AS g FROM part, range(96) t(c))),
b AS (SELECT channel, g / sum(g) OVER () AS p FROM (SELECT i::INT AS channel, -ln(unif('base|0|' || i)) AS g FROM range(96) t(i)))""")  # fmt: skip
def synthetic_signatures(spark, d):
    return sticks.synthesise(parts(spark, d), 0.3).select("k", "channel", r6("p"))


SIZES_ = "SELECT k, row_number() OVER (ORDER BY unif('mask|' || k), k) > round_even(0.4::DOUBLE * count(*) OVER (), 0) AS active FROM (SELECT DISTINCT p_size AS k FROM part)"


def part_sizes(spark, d):
    return D.table(spark, d, "part").select(F.col("p_size").alias("k")).distinct()


@query(SIZES_)
def zero_subset(spark, d):
    """Sizes of parts as components: a bounded set."""
    return sticks.zero_subset(part_sizes(spark, d), 0.4)


@query(f"SELECT count_if(active)::BIGINT AS true_K FROM ({SIZES_})")
def active_count(spark, d):
    return sticks.zero_subset(part_sizes(spark, d), 0.4).agg(F.count_if("active").alias("true_K"))


@query("""SELECT node, k, round(e, 6) AS e, CASE WHEN n <= 1 THEN e > 0 WHEN l = 0 THEN e > 0 AND r = 1 ELSE s END AS kept FROM (
SELECT *, count_if(e > 0) OVER (PARTITION BY node) AS n, count_if(s) OVER (PARTITION BY node) AS l,
row_number() OVER (PARTITION BY node ORDER BY e > 0 DESC, unif('revive|' || node || '|' || k), k) AS r
FROM (SELECT node, k, true_e AS e, true_e > 0 AND unif('drop|' || node || '|' || k) >= 0.6::DOUBLE AS s FROM activities))""")
def dropout(spark, d):
    return sticks.dropout(D.activities(spark, d).select("node", "k", F.col("true_e").alias("e")), 0.6).select("node", "k", r6("e"), "kept")


@query("SELECT child, (100 + floor(unif('branch|' || child) * 2901))::BIGINT AS length FROM edges")
def branch_lengths(spark, d):
    return D.edges(spark, d).select("child", rng.uniform_int(100, 3000, "branch", F.col("child")).alias("length"))


# ---- tables behind figures


PANELS = " UNION ALL ".join(f"SELECT '{c}' AS panel, depth, {c} AS x FROM stats" for c in SIZES[1:])


@query("""SELECT panel, depth, round(q1, 6) AS q1, round(m, 6) AS median, round(q3, 6) AS q3, round(min(x) FILTER (WHERE ok), 6) AS whisker_lo,
round(max(x) FILTER (WHERE ok), 6) AS whisker_hi, count_if(NOT ok)::BIGINT AS n_outliers FROM (
SELECT s.*, q1, m, q3, x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM panels s JOIN (
SELECT panel, depth, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) AS q3 FROM panels GROUP BY panel, depth) USING (panel, depth)) GROUP BY panel, depth, q1, m, q3""",
       f"{MCMC}, panels AS ({PANELS})")
def box_stats(spark, d):
    panels = depth_stats_rows(spark, d).unpivot("depth", list(SIZES[1:]), "panel", "x")
    found = plotdata.box(panels, ["panel", "depth"], "x")
    return found.select("panel", "depth", *[r6(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")], "n_outliers")


@query("SELECT CASE WHEN mean < 0.01 THEN 'near-zero' ELSE 'active' END AS activity, depth, round(median(r_hat), 6) AS median_r_hat FROM stats GROUP BY ALL", MCMC)
def zero_vs_active(spark, d):
    rows = depth_stats_rows(spark, d).withColumn("activity", evaluate.near_zero("mean"))
    return evaluate.medians(rows, ["activity", "depth"], ["r_hat"]).select("activity", "depth", r6("median_r_hat"))


def hist_sql(rows: str, value: str, bins: int, density: bool = False) -> str:
    height = "coalesce(c, 0) / (n * w)" if density else "coalesce(c, 0)"
    return f"""SELECT i::INT AS bin, round(a + i * w, 6) AS lo, round(a + (i + 1) * w, 6) AS hi, {'round(' + height + ', 6)' if density else height} AS height
FROM (SELECT min({value}) AS a, (max({value}) - min({value})) / {bins} AS w, count(*) AS n FROM {rows}) e CROSS JOIN range({bins}) t(i)
LEFT JOIN (SELECT least(floor(({value} - a) / w), {bins - 1})::INT AS b, count(*) AS c FROM {rows}, (SELECT min({value}) AS a, (max({value}) - min({value})) / {bins} AS w FROM {rows}) GROUP BY 1) ON b = i"""


def rounded_bins(found: DataFrame, density: bool = False) -> DataFrame:
    return found.select("bin", r6("lo"), r6("hi"), r6("height") if density else "height")


@query(hist_sql("corr", "correlation", 50), CORR)
def correlation_histogram(spark, d):
    return rounded_bins(plotdata.histogram(correlations(spark, d), "correlation", 50))


@query(hist_sql("recovery", "mae", 30), RECOVERY)
def mae_histogram(spark, d):
    return rounded_bins(plotdata.histogram(evaluate.recovery(D.activities(spark, d), K), "mae", 30))


@query(hist_sql("recovery", "cosine_similarity", 30), RECOVERY)
def cosine_histogram(spark, d):
    return rounded_bins(plotdata.histogram(evaluate.recovery(D.activities(spark, d), K), "cosine_similarity", 30))


@query(hist_sql("sigma", "value", 60, True))
def alpha_density(spark, d):
    return rounded_bins(plotdata.histogram(D.global_draws(spark, d), "value", 60, True), True)


@query("SELECT round(greatest(max(true_e), max(inferred_e)) * 1.05, 6) AS axis_limit FROM activities")
def scatter_limit(spark, d):
    return plotdata.axis_limit(D.activities(spark, d), "true_e", "inferred_e", 1.05).select(r6("axis_limit"))


@query("SELECT node, k, round(true_e, 6) AS true_e, round(inferred_e, 6) AS inferred_e, (row_number() OVER (PARTITION BY k ORDER BY depth, node))::INT AS position FROM activities JOIN depths USING (node)", DEPTHS, True)
def activity_heatmap(spark, d):
    rows = D.activities(spark, d).join(tree.depths(D.edges(spark, d)).select("node", "depth"), "node")
    placed = vectors.positions(rows, "k", ["depth", "node"])
    return placed.select("node", "k", r6("true_e"), r6("inferred_e"), "position")


@query("SELECT 'Signature_' || k AS signature, 'Channel_' || channel AS channel, round(p, 6) AS p FROM signatures")
def signature_heatmap(spark, d):
    return D.signatures(spark, d).select(F.concat(F.lit("Signature_"), "k").alias("signature"), F.concat(F.lit("Channel_"), "channel").alias("channel"), r6("p"))


@query("SELECT channel, round(p, 6) AS p FROM signatures WHERE k = 3")
def signature_bar(spark, d):
    return D.signatures(spark, d).filter("k = 3").select("channel", r6("p"))


@query("""SELECT node, rank, t.k, channel, round(p, 6) AS p FROM (SELECT * FROM (
SELECT *, (row_number() OVER (PARTITION BY node ORDER BY true_e DESC, k DESC))::INT AS rank FROM activities) WHERE rank <= 3 AND node IN ('C1', 'C2', 'C4', 'C7')) t JOIN signatures USING (k)""")
def node_signatures(spark, d):
    top = vectors.top_k(D.activities(spark, d).filter("node in ('C1', 'C2', 'C4', 'C7')"), "node", "true_e", "k", 3)
    return top.join(D.signatures(spark, d), "k").select("node", "rank", "k", "channel", r6("p"))


@query("SELECT s.node, s.k, channel, round(weight, 6) AS weight, round(p, 6) AS p FROM (SELECT * FROM deep QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, k DESC) <= 3) s JOIN atoms USING (k)", f"{STICKS}, {DEEP}")
def stick_signatures(spark, d):
    """The three heaviest of all pieces of each node; the SQL looks at the first 128."""
    top = sticks.heaviest(D.inner_nodes(spark, d).select("node"), 3, ALPHA)
    return top.join(sticks.atoms(top.select("k").distinct(), CHANNELS), "k").select("node", "k", "channel", r6("weight"), r6("p"))


@query()
def clustered_counts(spark, d):
    up = D.edges(spark, d).select(F.col("child").alias("node"), F.col("parent").alias("patient"))
    return plotdata.cluster_rows(plotdata.relative_profiles(D.counts(spark, d)).join(up, "node"), "patient")


@query("SELECT a, b, round(c, 6) AS cosine, p.matched IS NOT NULL AS is_match FROM cosm LEFT JOIN pairs p ON p.true_k = b AND p.matched = a", BEST, True)
def cosine_heatmap(spark, d):
    inferred, true, pairs = aligned(spark, d)
    hit = pairs.select(F.col("true_k").alias("b"), F.col("matched").alias("a"), F.lit(True).alias("hit"))
    both = vectors.cosine_matrix(inferred, true).join(hit, ["a", "b"], "left")
    return both.select("a", "b", r6("cosine"), F.coalesce("hit", F.lit(False)).alias("is_match"))


@query("SELECT true_k, matched, t.channel, round(t.p, 6) AS true_p, round(i.p, 6) AS inferred_p FROM pairs JOIN vecsig t ON t.odd = 0 AND t.k = true_k JOIN vecsig i ON i.odd = 1 AND i.k = matched AND i.channel = t.channel", BEST, True)
def comparison_grid(spark, d):
    inferred, true, pairs = aligned(spark, d)
    left = true.select(F.col("k").alias("true_k"), "channel", r6("p", "true_p"))
    right = inferred.select(F.col("k").alias("matched"), "channel", r6("p", "inferred_p"))
    return left.join(pairs.select("true_k", "matched"), "true_k").join(right, ["matched", "channel"])


# ---- files: written to the shared folder and read back


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/treeweft-files/{name}-{uuid.uuid4().hex}"


@query("SELECT node, channel, n FROM counts WHERE n > 0")
def count_matrix_file(spark, d):
    files.write_matrix(count_matrix(spark, d), path := scratch(spark, "mutation_count_matrix.csv"))
    return files.from_matrix(files.read_counts(spark, path), "node", "channel", "n", "Channel_").filter("n > 0")


@query("SELECT 'Signature_' || k AS name, channel, round(p, 6) AS p FROM signatures WHERE p > 0")
def signature_file(spark, d):
    files.write_inferred_signatures(D.signatures(spark, d), path := scratch(spark, "signatures.csv"))
    found = files.from_matrix(files.read_signatures(spark, path), "name", "channel", "p", "Channel_").filter("p > 0")
    return found.select("name", "channel", r6("p"))


@query("SELECT node, k, round(true_e, 6) AS true_e FROM activities WHERE true_e > 0")
def activity_file(spark, d):
    names = [(k, f"Signature_{k}") for k in range(K)]
    wide = files.to_matrix(D.activities(spark, d), "node", "k", "true_e", names, F.lit(0.0))
    files.write_matrix(wide, path := scratch(spark, "true_activities.csv"))
    return files.read_activities(spark, path).filter("true_e > 0").select("node", "k", r6("true_e"))


@query("SELECT tumour, parent, child FROM edges")
def edge_file(spark, d):
    files.write_matrix(D.edges(spark, d).select("tumour", "parent", "child"), path := scratch(spark, "tree_edges.csv"))
    return spark.read.schema("tumour int, parent string, child string").csv(path, header=True)


@query("SELECT parent, child, round(length, 6) AS length FROM edges")
def newick_file(spark, d):
    files.write_newick(newick.text_rows(D.edges(spark, d)), path := scratch(spark, "newick_string.nwk"))
    return newick.parse_parts(files.read_newick(spark, path), "value", files.LINE_ORDER).select("parent", "child", r6("length"))


@query("""SELECT 'sigma' AS var, chain, draw, NULL::VARCHAR AS node, NULL::INT AS k, round(value, 6) AS value FROM sigma
UNION ALL SELECT 'e', chain, draw, node, k, round(value, 6) FROM draws""")
def draws_file(spark, d):
    own = D.global_draws(spark, d).select(F.lit("sigma").alias("var"), "chain", "draw", F.lit(None).cast("string").alias("node"), F.lit(None).cast("int").alias("k"), "value")
    nodes_ = D.draws(spark, d).select(F.lit("e").alias("var"), "chain", "draw", "node", "k", "value")
    files.write_draws(own.unionByName(nodes_), path := scratch(spark, "trace.parquet"))
    return files.read_draws(spark, path).select("var", "chain", "draw", "node", "k", r6("value"))


@query("SELECT 'e' AS var, chain, draw, node, k, round(value, 6) AS value FROM draws")
def draws_netcdf(spark, d):
    netcdf.write_draws(D.draws(spark, d).withColumn("var", F.lit("e")), path := scratch(spark, "trace.nc"))
    return netcdf.read_draws(spark, path, "e").select("var", "chain", "draw", "node", "k", r6("value"))


@query("""SELECT (SELECT count(DISTINCT tumour) FROM edges) AS n_tumours, (SELECT count(*) FROM edges) AS n_edges, NULL::DOUBLE AS nb_dispersion,
(SELECT round(sum(length), 4) FROM edges) AS total_length""")
def report_file(spark, d):
    found = D.edges(spark, d).agg(F.count_distinct("tumour").alias("n_tumours"), F.count("*").alias("n_edges"), F.lit(None).cast("double").alias("nb_dispersion"), F.round(F.sum("length"), 4).alias("total_length"))
    files.write_report(found, path := scratch(spark, "ground_truth_params.json"))
    return files.read_report(spark, path).select("n_tumours", "n_edges", F.col("nb_dispersion").cast("double").alias("nb_dispersion"), "total_length")


@query(f"""SELECT 42 AS seed, NULL::VARCHAR AS nb_dispersion, (SELECT count(*) FROM sizes_ WHERE active) AS "true_K",
(SELECT string_agg(k::VARCHAR, ',' ORDER BY k) FROM sizes_ WHERE active) AS active_indices,
(SELECT count(DISTINCT tumour) FROM edges) AS n_tumours, (SELECT count(*) FROM (SELECT parent FROM edges UNION SELECT child FROM edges)) AS n_nodes_total,
(SELECT sum(n)::BIGINT FROM counts) AS n_mutations""", f"sizes_ AS ({SIZES_})")
def params_file(spark, d):
    """A report with an array and a nested record, written as JSON and read back."""
    active = sticks.zero_subset(part_sizes(spark, d), 0.4).filter("active").agg(F.array_sort(F.collect_list("k")).alias("active_signature_indices"))
    e = D.edges(spark, d)
    nodes_ = tree.nodes(e).agg(F.count_distinct("tumour").alias("n_tumours"), F.count("*").alias("n_nodes_total"))
    made = nodes_.join(D.counts(spark, d).agg(F.sum("n").alias("n_mutations")))  # one row each
    report = active.join(made).select(
        F.lit(42).alias("seed"), F.lit(None).cast("string").alias("nb_dispersion"), F.size("active_signature_indices").alias("true_K"),
        "active_signature_indices", F.struct("n_tumours", "n_nodes_total", "n_mutations").alias("dataset_summary"),
    )
    files.write_report(report, path := scratch(spark, "ground_truth_params.json"))
    found = files.read_report(spark, path)
    indices = F.array_join(F.col("active_signature_indices").cast("array<string>"), ",").alias("active_indices")
    return found.select("seed", F.col("nb_dispersion").cast("string").alias("nb_dispersion"), "true_K", indices, "dataset_summary.*")


@query("""SELECT tumour, arg_min(node, entry) AS node, min(entry) AS entry FROM placed WHERE node IN (SELECT node FROM activities) GROUP BY tumour""", CLOSURE, True)
def first_in_walk(spark, d):
    """The first node of each tree, by its place in the walk, that has activities."""
    placed = tree.intervals(D.edges(spark, d)).join(D.activities(spark, d).select("node").distinct(), "node", "left_semi")
    return placed.groupBy("tumour").agg(F.min(F.struct("entry", "node")).alias("m")).select("tumour", "m.node", "m.entry")


# ---- nodes and components one by one


@query("SELECT chain, draw, k, round(value, 6) AS value FROM draws WHERE node = 'N3'")
def node_posterior(spark, d):
    return evaluate.node_posterior(D.draws(spark, d), "N3").select("chain", "draw", "k", r6("value"))


@query("SELECT node, chain, draw, round(max(value) FILTER (WHERE k = 7), 6) AS first, round(max(value) FILTER (WHERE k = 2), 6) AS second FROM draws GROUP BY node, chain, draw")
def gathered_draws(spark, d):
    wanted = (7, 2)
    rows = D.draws(spark, d).withColumn("value", F.when(F.col("k").isin(*wanted), F.col("value")))  # others are not worked out
    rows = rows.groupBy("node", "chain", "draw").agg(components("value", range(max(wanted) + 1), wanted).alias("x"))
    rows = rows.withColumn("v", arrays.gather("x", F.array(*map(F.lit, wanted))))
    return rows.select("node", "chain", "draw", r6(F.col("v")[0], "first"), r6(F.col("v")[1], "second"))


@query("SELECT o_orderkey, CASE WHEN lower(o_orderpriority) <> '5-low' THEN o_orderpriority END AS priority FROM orders")
def text_to_null(spark, d):
    low = F.when(F.lower("o_orderpriority") == "5-low", F.lit("NONE")).otherwise(F.col("o_orderpriority"))
    return D.table(spark, d, "orders").select("o_orderkey", arrays.none_to_null(low).alias("priority"))


# ---- keyed counts

ARRIVALS = """means AS (
  SELECT child AS node, (5 + length / 500) * (-ln(unif('gamma|' || child || '|0')) - ln(unif('gamma|' || child || '|1'))) / 2 AS mean FROM edges
), arrivals AS (
  SELECT node, i, mean, sum(-ln(unif('arrival|' || node || '|' || i))) OVER (PARTITION BY node ORDER BY i) AS t FROM means, range(512) t(i)
), totals AS (
  SELECT node, count_if(t <= mean)::BIGINT AS n FROM arrivals GROUP BY node
)"""
MUTATIONS = f"""{ARRIVALS}, sums AS (
  SELECT k, channel, sum(p) OVER (PARTITION BY k ORDER BY channel) AS hi, p FROM signatures
), mutations AS (
  SELECT node, i, (ascii(substr(node, length(node), 1)) - 48)::INT AS k, unif('mutation|' || node || '|' || i) AS u FROM totals, range(512) t(i) WHERE i < n
)"""


def node_means(spark, d) -> DataFrame:
    """(node, mean): 5 more than the branch length over 500, with the spread of a dispersion of 2."""
    mean = F.lit(5.0) + F.col("length") / 500
    return D.edges(spark, d).select(F.col("child").alias("node"), (mean * rng.gamma_whole(2, "gamma", F.col("child")) / 2).alias("mean"))


@query("SELECT node, n FROM totals", ARRIVALS)
def negative_binomial_counts(spark, d):
    return sticks.poisson(node_means(spark, d)).select("node", "n")


@query("SELECT m.node, s.channel, count(*) AS n FROM mutations m JOIN sums s ON s.k = m.k AND m.u >= s.hi - s.p AND m.u < s.hi GROUP BY ALL", MUTATIONS)
def multinomial_counts(spark, d):
    """Each node's mutations from the signature that its last digit names."""
    totals = sticks.poisson(node_means(spark, d)).withColumn("k", F.substring("node", -1, 1).cast("int"))
    return sticks.multinomial(totals, D.signatures(spark, d))


# ---- kernels


@query()
def simulated_counts(spark, d):
    """Counts of a tree a supplier, with the parts' signatures."""
    import numpy as np

    from treeweft.operators.simulate import baseline, count_matrix, simulate

    s = np.zeros((K, CHANNELS))
    for r in D.signatures(spark, d).collect():  # K x CHANNELS cells at most
        s[r["k"], r["channel"]] = r["p"]
    forest = random_trees(spark, d)
    return count_matrix(simulate(forest, baseline(K, 10.0, 0.4, 42), alpha=15.0, dropout=0.1), s)
