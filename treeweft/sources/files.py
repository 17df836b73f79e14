"""Matrices, forests and reports as files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANNELS = 96


def matrix_schema(names: list[str], index: str = "node", kind: T.DataType | None = None) -> T.StructType:
    return T.StructType([T.StructField(index, T.StringType()), *[T.StructField(n, kind or T.DoubleType()) for n in names]])


def read_matrix(spark: SparkSession, path: str, index: str, prefix: str, size: int, kind: T.DataType | None = None) -> DataFrame:
    """A CSV whose first column is the index and whose others are <prefix>0.. by place; ValueError on other widths."""
    width = len(spark.read.csv(path).columns)
    if width != size + 1:
        raise ValueError(f"{path}: {size} columns are wanted, there are {width - 1}")
    names = [f"{prefix}{i}" for i in range(size)]
    return spark.read.schema(matrix_schema(names, index, kind)).option("enforceSchema", True).csv(path, header=True)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return read_matrix(spark, path, "node", "Channel_", CHANNELS, T.LongType())


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    found = read_matrix(spark, path, "name", "Channel_", CHANNELS)
    check_signature_rows(found)
    return found


def read_activities(spark: SparkSession, path: str) -> DataFrame:
    """(node, k, true_e) of a CSV with the columns node and Signature_0.., as many as it has."""
    width = len(spark.read.csv(path).columns)
    if width < 2:
        raise ValueError(f"{path}: there is no activity")
    wide = read_matrix(spark, path, "node", "Signature_", width - 1)
    return from_matrix(wide, "node", "k", "true_e", "Signature_")


def write_inferred_signatures(rows: DataFrame, path: str) -> None:
    """inferred_signatures.csv of (k, channel, p): a row Signature_<k> for each, columns Channel_0..; absent cells are 0."""
    names = [(c, f"Channel_{c}") for c in range(CHANNELS)]
    wide = to_matrix(rows.withColumn("", F.concat(F.lit("Signature_"), "k")), "", "channel", "p", names, F.lit(0.0))
    write_matrix(wide, path)


def check_signature_rows(wide: DataFrame) -> None:
    """ValueError for rows that do not sum to 1, or else have negative entries."""
    names = [c for c in wide.columns if c.startswith("Channel_")]
    total = sum((F.col(c) for c in names), F.lit(0.0))
    bad = wide.agg(F.count_if(F.abs(total - 1) > 1e-6).alias("s"), F.count_if(F.least(*names) < 0).alias("n")).head()
    if bad["s"]:
        raise ValueError("a signature does not sum to 1")
    if bad["n"]:
        raise ValueError("a signature has a negative entry")


def to_matrix(rows: DataFrame, index: str, column: str, value: str, names: list[tuple[int, str]], empty) -> DataFrame:
    """Wide form of (index, column, value), with one aggregate for each named column."""
    cells = [F.coalesce(F.sum(F.when(F.col(column) == c, F.col(value))), empty).alias(n) for c, n in names]
    return rows.groupBy(index).agg(*cells)


def from_matrix(wide: DataFrame, index: str, column: str, value: str, prefix: str) -> DataFrame:
    """Long form: (index, column, value); the column's number is what follows the prefix."""
    names = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.unpivot(index, names, "_name", value)
    return long.select(index, F.substring("_name", len(prefix) + 1, 9).cast("int").alias(column), value)


def write_matrix(wide: DataFrame, path: str) -> None:
    wide.write.mode("overwrite").csv(path, header=True)


def write_newick(parts: DataFrame, path: str) -> None:
    """Parts of Newick text (tumour, position, text), a line each, in order within and between the files of a folder."""
    ordered = parts.repartitionByRange("tumour", "position").sortWithinPartitions("tumour", "position")
    ordered.select("text").write.mode("overwrite").text(path)


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, value): lines of Newick text, to be read in order of the first three."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    return lines.select("file", "block", F.monotonically_increasing_id().alias("line"), "value")


LINE_ORDER = ["file", "block", "line"]


def write_report(report: DataFrame, path: str) -> None:
    """One file: a report is one row."""
    report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=False)


def write_draws(draws: DataFrame, path: str) -> None:
    """Parquet, a folder for each variable, so that reading one leaves the others alone."""
    draws.write.mode("overwrite").partitionBy("var").parquet(path)


def read_draws(spark: SparkSession, path: str, var: str | None = None) -> DataFrame:
    found = spark.read.parquet(path)
    return found if var is None else found.filter(F.col("var") == var)


def make_output_dir(base: str = "results", name: str = "experiment") -> Path:
    path = Path(base) / name
    path.mkdir(parents=True, exist_ok=True)
    return path


def load_config(path: str) -> dict:
    """A YAML file; FileNotFoundError if it is missing."""
    import yaml

    if not Path(path).exists():
        raise FileNotFoundError(path)
    return yaml.safe_load(Path(path).read_text())
