"""Cutting the lineage of tables that loops build up."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors see.

    Only a session in local mode that names none gets a folder of its own; elsewhere that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("on a cluster spark.checkpoint.dir names a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="treeweft-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared folder."""
    spark = df.sparkSession
    root = shared_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint()
