"""The domain's tables, derived from the order tables.

A forest of one tree a region (region, nation, customer); mutation counts, two versions of activities and a signature
matrix from order lines; and keyed posterior draws for the inner nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeweft.functions.rng import uniform
from treeweft.functions.vectors import normalise

CHANNELS = 96
K = 10
CHAINS, DRAWS = 4, 50
#: Nodes whose draws one task makes; each has K x CHAINS x DRAWS of them.
PART_NODES = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tumour, parent, child, length)"""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    top = nation.select(
        F.col("n_regionkey").alias("tumour"),
        F.concat(F.lit("R"), "n_regionkey").alias("parent"),
        F.concat(F.lit("N"), "n_nationkey").alias("child"),
        F.lit(1.0).alias("length"),
    )
    low = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("tumour"),
        F.concat(F.lit("N"), "c_nationkey").alias("parent"),
        F.concat(F.lit("C"), "c_custkey").alias("child"),
        F.abs("c_acctbal").alias("length"),
    )
    return top.unionByName(low)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, channel, l_partkey, quantity, price) of every order line."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return item.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("C"), "o_custkey").alias("node"),
        (F.col("l_partkey") % CHANNELS).cast("int").alias("channel"),
        "l_partkey",
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
    )


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, channel, n)"""
    return lines(spark, sf_dir).groupBy("node", "channel").agg(F.sum("quantity").alias("n"))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, channel, p): rows sum to 1; absent cells are 0."""
    part = table(spark, sf_dir, "part").groupBy(
        (F.col("p_size") % K).cast("int").alias("k"), (F.col("p_partkey") % CHANNELS).cast("int").alias("channel")
    )
    return normalise(part.agg(F.sum("p_retailprice").alias("s")), "k", "s", "p").drop("s")


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, k, true_e, inferred_e): shares of each component by price and by quantity."""
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % K).cast("int").alias("k"))
    sums = lines(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("node", "k")
    sums = sums.agg(F.sum("price").alias("price"), F.sum("quantity").alias("quantity"))
    return normalise(normalise(sums, "node", "price", "true_e"), "node", "quantity", "inferred_e").drop("price", "quantity")


def vector_signatures(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    """(k, channel, p) by label from embeddings with odd or even ids: mean magnitude, rows sum to 1."""
    rows = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 2 == odd)
    cells = rows.select(F.col("label").alias("k"), F.posexplode("embedding").alias("channel", "x"))
    means = cells.groupBy("k", "channel").agg(F.avg(F.abs(F.col("x").cast("double"))).alias("m"))
    return normalise(means, "k", "m", "p").drop("m")


def inner_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, depth) of regions, nations and suppliers: the parameters that are drawn from, more on larger tables."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    top = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("node"), F.lit(0).alias("depth"))
    middle = nation.select(F.concat(F.lit("N"), "n_nationkey").alias("node"), F.lit(1).alias("depth"))
    return top.unionByName(middle).unionByName(supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("node"), F.lit(2).alias("depth")))


def chains(spark: SparkSession) -> DataFrame:
    both = spark.range(CHAINS * DRAWS)
    return both.select((F.col("id") % CHAINS).cast("int").alias("chain"), F.floor(F.col("id") / CHAINS).cast("int").alias("draw"))


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chain, draw, node, k, value): of each node and component, CHAINS x DRAWS draws.

    Cells are dealt to tasks before their draws are made, as their tables are a file of a task each. All draws of a node lie in one
    task, so that groups within nodes need no shuffle.
    """
    nodes = inner_nodes(spark, sf_dir).select("node")
    parts = max(spark.sparkContext.defaultParallelism, -(-nodes.count() // PART_NODES))
    cells = nodes.crossJoin(F.broadcast(spark.range(K).select(F.col("id").cast("int").alias("k"))))
    # a level of the component's own, worked out once, before the shuffle, and noise around it
    cells = cells.withColumn("_level", uniform("level", F.col("node"), F.col("k"))).repartition(parts, "node")
    level, rows = F.col("_level"), cells.crossJoin(F.broadcast(chains(spark)))
    noise = uniform("draw", F.col("node"), F.col("k"), F.col("chain"), F.col("draw"))
    return rows.select("node", "k", "chain", "draw", (level * level * level * (F.lit(0.5) + noise)).alias("value"))


def global_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chain, draw, value) of the global parameter, a draw an order."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((key % CHAINS).cast("int").alias("chain"), F.floor(key / CHAINS).cast("int").alias("draw"))
    return rows.withColumn("value", F.lit(0.5) + uniform("sigma", F.col("chain"), F.col("draw")))


CTES = r"""
edges AS (
  SELECT n_regionkey AS tumour, 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child, 1.0::DOUBLE AS length FROM nation
  UNION ALL
  SELECT n_regionkey, 'N' || c_nationkey, 'C' || c_custkey, abs(c_acctbal) FROM customer JOIN nation ON c_nationkey = n_nationkey
), lines AS (
  SELECT 'C' || o_custkey AS node, (l_partkey % 96)::INT AS channel, l_partkey, l_quantity::BIGINT AS quantity, l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), counts AS (
  SELECT node, channel, sum(quantity)::BIGINT AS n FROM lines GROUP BY ALL
), sig0 AS (
  SELECT (p_size % 10)::INT AS k, (p_partkey % 96)::INT AS channel, sum(p_retailprice) AS s FROM part GROUP BY ALL
), signatures AS (
  SELECT k, channel, s / sum(s) OVER (PARTITION BY k) AS p FROM sig0
), act0 AS (
  SELECT node, (p_size % 10)::INT AS k, sum(price) AS price, sum(quantity) AS quantity
  FROM lines JOIN part ON l_partkey = p_partkey GROUP BY ALL
), activities AS (
  SELECT node, k, price / sum(price) OVER (PARTITION BY node) AS true_e,
         quantity::DOUBLE / (sum(quantity) OVER (PARTITION BY node))::DOUBLE AS inferred_e
  FROM act0
), cells AS (
  SELECT vec_id % 2 AS odd, label AS k, unnest(range(0, len(embedding)))::INT AS channel, unnest(embedding) AS x FROM embeddings
), vecm AS (
  SELECT odd, k, channel, avg(abs(x::DOUBLE)) AS m FROM cells GROUP BY ALL
), vecsig AS (
  SELECT odd, k, channel, m / sum(m) OVER (PARTITION BY odd, k) AS p FROM vecm
), inner_nodes AS (
  SELECT 'R' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT 'N' || n_nationkey, 1 FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 2 FROM supplier
), chains AS (
  SELECT (i % 4)::INT AS chain, (i // 4)::INT AS draw FROM range(200) t(i)
), draws AS (
  SELECT chain, draw, node, k::INT AS k,
         pow3(unif('level|' || node || '|' || k)) * (0.5 + unif('draw|' || node || '|' || k || '|' || chain || '|' || draw)) AS value
  FROM inner_nodes, range(10) t(k), chains
), sigma AS (
  SELECT chain, draw, 0.5 + unif('sigma|' || chain || '|' || draw) AS value
  FROM (SELECT (o_orderkey % 4)::INT AS chain, (o_orderkey // 4)::INT AS draw FROM orders)
)
"""


def sql(body: str, more: str = "", recursive: bool = False) -> str:
    """DuckDB SQL over the domain's tables; unif(key) and pow3(x) stand for their formulas."""
    text = f"WITH {'RECURSIVE ' if recursive else ''}{CTES.strip()}{', ' + more.strip() if more else ''}\n{body.strip()}"
    return expand(text)


def expand(text: str) -> str:
    for name, make in (
        ("unif(", lambda x: f"((('0x' || substr(md5({x}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"),
        ("pow3(", lambda x: f"({x}) * ({x}) * ({x})"),
    ):
        while (at := text.rfind(name)) >= 0:
            depth, end = 1, at + len(name)
            while depth:
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                end += 1
            text = text[:at] + make(text[at + len(name) : end - 1]) + text[end:]
    return text
