"""Sums over vectors held as rows (id, component, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeweft.plans.lineage import settled

EPS = 1e-12


def cosine(a, b) -> Column:
    """Over a group: the dot product over the product of norms plus EPS."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    norms = F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))
    return F.sum(a * b) / (norms + F.lit(EPS))


def mean_abs_error(a, b, size: int | None = None) -> Column:
    """Over a group: the mean distance, or their sum over ``size`` where absent components are zeros."""
    gap = F.abs(F.col(a) - F.col(b))
    return F.avg(gap) if size is None else F.sum(gap) / F.lit(size)


def normalise(rows: DataFrame, by, value: str, out: str) -> DataFrame:
    """Add ``out``: the value's share of its vector's sum; null where that is 0."""
    by = [by] if isinstance(by, str) else by
    return rows.withColumn(out, F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*by))))


def product(left: DataFrame, right: DataFrame, on: str, by, a: str, b: str, out: str) -> DataFrame:
    """Matrix product: the sum of a*b over the shared index ``on``, for each ``by``."""
    return left.join(right, on).groupBy(*by).agg(F.sum(F.col(a) * F.col(b)).alias(out))


def row_norms(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))


def cosine_matrix(a: DataFrame, b: DataFrame, on: str = "channel", value: str = "p") -> DataFrame:
    """(a, b, cosine) for all pairs of rows of two matrices (k, on, value); each norm gets EPS by itself."""
    def unit(m: DataFrame, name: str) -> DataFrame:
        over = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy("k")))
        return m.select(F.col("k").alias(name), on, (F.col(value) / (over + F.lit(EPS))).alias(f"u_{name}"))

    both = unit(a, "a").join(unit(b, "b"), on)
    return both.groupBy("a", "b").agg(F.sum(F.col("u_a") * F.col("u_b")).alias("cosine"))


def pearson(a, b) -> Column:
    """Over a group; null where either side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def top_k(rows: DataFrame, by, value: str, tie: str, k: int) -> DataFrame:
    """The k largest values of each group with their rank; of equal values the larger ``tie`` first."""
    order = Window.partitionBy(by).orderBy(F.col(value).desc(), F.col(tie).desc())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each name in ``sums``, the sum of its column over the row and those before it in its group.

    A group may hold most rows, or all of them (``by`` empty): rows are dealt by ranges of (*by, *order) and summed within each
    range, and a table of a row for each range and group tells what comes before. Ties in ``order`` go in any order.
    """
    dealt = rows.repartitionByRange(*[F.col(c) for c in [*by, *order]]).withColumn("_p", F.spark_partition_id())
    placed = settled(dealt.select("*", *[c.cast("long").alias(f"_v_{n}") for n, c in sums.items()]))
    parts = placed.groupBy(*by, "_p").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*by, "_p", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums])
    upto = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = placed.select("*", *[F.sum(f"_v_{n}").over(upto).alias(f"_h_{n}") for n in sums])
    both = here.join(starts, [*by, "_p"])
    return both.select(*rows.columns, *[(F.col(f"_h_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])


def positions(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` with ``position``, from 1, of each row among those with its ``by``, which may be most of them."""
    found = running(rows, [by], order, {"position": F.lit(1)})
    return found.withColumn("position", F.col("position").cast("int"))


def quantiles(rows: DataFrame, by: list[str], value: str, names: dict[str, float]) -> DataFrame:
    """(*by, *names): exact quantiles of each group, between two values by their distances; nulls and NaN don't count.

    Equal values are one row with their number before they are put in order, and the order is by ranges: neither a
    group nor a value that most rows have is held by one task.
    """
    counted = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, F.col(value).cast("double").alias("_x"))
    counted = settled(counted.agg(F.count("*").alias("_n")))
    upto = running(counted, by, ["_x"], {"_upto": F.col("_n")})
    found = upto.join(counted.groupBy(*by).agg(F.sum("_n").alias("_all")), by) if by else upto.crossJoin(counted.agg(F.sum("_n").alias("_all")))
    parts = []
    for i, q in enumerate(names.values()):
        at = (F.col("_all") - 1) * F.lit(float(q))
        for side, rank in (("l", F.floor(at)), ("h", F.ceil(at))):
            here = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
            parts.append(F.max(F.when(here, F.col("_x"))).alias(f"_{side}{i}"))
        parts.append(F.max(at - F.floor(at)).alias(f"_w{i}"))
    ends = found.groupBy(*by).agg(*parts)
    return ends.select(*by, *[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_w{i}")).alias(n) for i, n in enumerate(names)])
