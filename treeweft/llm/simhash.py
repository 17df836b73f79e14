"""Near-duplicates by SimHash, found by multi-index hashing.

Equal fingerprints are one node, whatever the number of their documents. A fingerprint is cut into two segments of
32 bits. Of two fingerprints that differ in at most three bits, one segment differs in at most one; so each
fingerprint is filed under both segments, and looks up each segment and all values one bit away. The full distance
of what it meets is then counted. Of two segments that differ in one bit only the one with the 0 looks up the
other, and equal segments meet in one order, so each segment finds a pair once.

Null texts are empty; texts without a word have the fingerprint zero. Rows with null ids take part; a component
of such rows alone has a null id. Repeated rows fall together. An empty table gives an empty result. Only the id
and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeweft.llm.common import small_batches, stored, whole_text
from treeweft.llm.components import components
from treeweft.llm.fingerprint import signed, simhash

RADIUS = 3
WORDS = 3


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(_id, fp): the 64-bit fingerprint, as a signed number, of each row's whole text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    schema = T.StructType([rows.schema["_id"], T.StructField("fp", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([signed(simhash(t, words)) for t in batch["_text"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["_id"], found], schema.names)

    return rows.mapInArrow(work, schema)


def close_pairs(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of the fingerprints in ``distinct`` that differ in at most ``radius`` bits, 3 at most."""
    if not 0 <= radius <= 3:
        raise ValueError("two segments with balls of one bit reach radius 3")
    segments = F.array(
        F.struct(F.lit(0).alias("segment"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key")),
        F.struct(F.lit(1).alias("segment"), F.shiftrightunsigned("fp", 32).alias("key")),
    )
    filed = distinct.select("fp", F.inline(segments))
    ball = F.expr(
        "concat(array(key), transform(filter(sequence(0, 31), i -> shiftright(key, i) & 1 = 0), i -> key | shiftleft(1L, i)))"
    )
    asked = filed.select(F.col("fp").alias("q"), F.col("segment").alias("s"), F.col("key").alias("own"), F.explode(ball).alias("k"))
    near = (F.col("own") != F.col("k")) | (F.col("q") < F.col("fp"))
    exact = F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= radius
    met = asked.join(filed, (F.col("s") == F.col("segment")) & (F.col("k") == F.col("key")) & near & exact)
    return met.select(F.least("q", "fp").alias("a"), F.greatest("q", "fp").alias("b")).filter("a <> b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """(id, fingerprint, component_id) for every row; the component's id is its smallest document id."""
    marked = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("_id").alias("first")), "distinct-fingerprints")
    labels = components(close_pairs(distinct.select("fp"), radius))
    labelled = distinct.join(labels, distinct["fp"] == labels["node"], "left")
    labelled = labelled.select("fp", "first", F.coalesce("label", "fp").alias("label"))
    heads = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    named = labelled.join(heads, "label").select(F.col("fp").alias("_fp"), "component_id")
    rows = marked.join(named, marked["fp"] == named["_fp"])
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.select(F.col("_id").alias(id_col), digits.alias("fingerprint"), "component_id")


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller id.

    Rows of one id are one document: they stay or go together. Rows with null ids stay if their component has no
    other.
    """
    found = near_duplicates(docs, id_col, text_col, words, radius)
    gone = ~F.col(id_col).eqNullSafe(F.col("component_id"))
    drop = stored(found.filter(gone).select(F.col(id_col).alias("_gone")).distinct(), "gone")
    return docs.join(drop, docs[id_col].eqNullSafe(drop["_gone"]), "left_anti")
