"""The corpus pipeline: quality, lines, near-duplicates, mixture, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeweft.llm.common import made_paths, remove, shared_path
from treeweft.llm.lines import dedup_lines
from treeweft.llm.mixing import mixed
from treeweft.llm.near import keep_first_near
from treeweft.llm.packing import pack
from treeweft.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the line field rejects."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier document has; n_chars follows the text, and documents left without any go."""
    left = dedup_lines(docs, drop_emptied=True)
    return left.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else left


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    return keep_first_near(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: not at all, once or twice."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, dealt into sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", packing),
]

# the stages fit a model, compare lines approximately and tokenize: SQL expresses none of these
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each keeps is written, and read again by the next. What a stage wrote on its
    way goes when its result is there, and so does the result before it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        before = made_paths()
        kept = stage(spark, docs, sf_dir)
        path = shared_path(spark, f"stage-{name}")
        kept.write.parquet(path)
        docs = spark.read.parquet(path)
        remove(spark, [p for p in made_paths() if p != path and (p not in before or p == last)])
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
