"""The queries that apply each corpus operator to the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeweft.llm.audit import AUDIT_SQL, interactions
from treeweft.llm.collocations import COLLOCATIONS_SQL, collocations
from treeweft.llm.common import documents
from treeweft.llm.hnsw import build_index, search_index
from treeweft.llm.huffman import read_ids, write_ids
from treeweft.llm.lines import dedup_lines
from treeweft.llm.mixing import MIX_SQL, mix
from treeweft.llm.packing import pack
from treeweft.llm.quality import REJECT_BELOW, fit_quality, fold_of, with_score
from treeweft.llm.simhash import near_duplicates
from treeweft.llm.substrings import dedup_substrings, digest
from treeweft.llm.tiff import media_digest, to_media
from treeweft.llm.token_count import token_counts
from treeweft.llm.windows import pack_windows


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), vocabulary())


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(spark, write_ids(documents(spark, sf_dir), vocabulary()), ids=False)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search_index(build_index(vectors), vectors.filter("vec_id % 50 = 0"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op5_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(to_media(documents(spark, sf_dir)))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(dedup_substrings(documents(spark, sf_dir)))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    left = dedup_lines(docs, counts=True)
    return left.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2("text", 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = (fold_of("doc_id") == 0).alias("held_out")
    predicted = (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted")
    return with_score(docs, model).select("doc_id", held_out, "score", predicted)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def op12_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_windows(documents(spark, sf_dir), vocabulary())


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_token_count": op1_token_count,
    "op2_token_ids": op2_token_ids,
    "op3_nearest": op3_nearest,
    "op4_simhash": op4_simhash,
    "op5_media_tiff": op5_media_tiff,
    "op6_substrings": op6_substrings,
    "op7_line_dedup": op7_line_dedup,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_collocations": op11_collocations,
    "op12_windows": op12_windows,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {
    "op9_mixing": MIX_SQL,
    "op11_collocations": COLLOCATIONS_SQL,
    "op13_filter_audit": AUDIT_SQL,
}
