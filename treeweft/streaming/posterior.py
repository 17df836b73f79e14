"""Running posterior moments while draws arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRAWS = "chain int, draw int, node string, k int, value double"


def arriving_draws(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the draws in the Parquet files that come into a folder."""
    return spark.readStream.schema(DRAWS).parquet(path)


def running_moments(draws: DataFrame) -> DataFrame:
    """(node, k, n, mean, sd) of all draws so far; for the update or complete output mode."""
    return draws.groupBy("node", "k").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
