"""Helpers that all corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[str] = []
#: Rows and bytes of an Arrow batch.
BATCH_ROWS = 4096
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir.

    Only a session in local mode that names none gets one of its own; elsewhere that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("on a cluster spark.checkpoint.dir names a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="treeweft-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/treeweft/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def made_paths() -> list[str]:
    """The paths given out so far and not removed."""
    return list(_MADE)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove what was written there, once no plan that is still to run reads it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        where = hadoop(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _MADE.remove(path)


def stored(df: DataFrame, name: str, compression: str = "zstd", parts: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The plan that follows starts from files that survive the loss of an executor, and nothing before
    them is computed twice. Rows lie in a folder for each value of ``parts``.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", compression).partitionBy(*parts).parquet(path)
    # shuffle files of plans that are done go when the driver's JVM collects them, which may be much later
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, so that a worker holds few of the very long texts at once.

    All operators want the same bounds, whichever of them ran last: a batch ends with the text that makes it full.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes, or less where they end."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def give_back() -> None:
    """Return free memory to the system: a worker outlives its tasks, and the next one runs beside what it would keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(work):
    """``work`` of a mapInArrow, whose worker gives its free memory back when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def parts_of(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column``, a text each at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
            yield batch.slice(a, b - a)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_text(name: str = "text"):
    """The text, or the empty text in place of a null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
