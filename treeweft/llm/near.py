"""SimHash near-duplicates at a similarity: documents whose sets of five-word shingles have a Jaccard similarity of at
least four fifths.

Documents with equal sets are one node, whatever their number. Candidates are close SimHash fingerprints of the same
shingles, found by multi-index hashing (see simhash.py), and, as its balls reach a tenth of the pairs near 0.8 only
(those differ in ten bits on average), documents that share a bucket: all ``ROWS`` minima of one of ``BANDS`` bands
agree, which a pair of similarity 0.8 misses with a chance of 7 in a million and a closer one with less. Candidates are
decided on the whole sets, by counting.

Components are what is asked for. So a bucket's members first meet its head only, the one that shares most buckets
with others. What is then in one component needs no further look; of all other pairs, those go on to be decided whose
sketches differ in at most ``DIFFER`` of ``SKETCH`` bits. Each bit differs with half the chance of an odd minimum: a
pair of similarity 0.8 differs in 205 bits on average, with a deviation of 13.6, so that one in a billion is lost.

Null texts are empty; texts without a word have the empty set, which is like itself only. Rows with null ids take
part; a component of such rows alone has a null id. Repeated rows fall together. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest, xxh64_intdigest

from treeweft.llm.common import small_batches, stored, trimmed, whole_text
from treeweft.llm.components import components
from treeweft.llm.fingerprint import SEED, fingerprint, shingle_hashes, signed
from treeweft.llm.simhash import close_pairs

WORDS = 5
BANDS, ROWS = 30, 5
SKETCH, DIFFER = 2048, 286
LONGS = SKETCH // 64
#: Hashes times minima that are worked on at once.
AT_ONCE = 1 << 16


def permutations(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and terms of maps x -> a x + b of 32-bit numbers onto themselves."""
    random = np.random.default_rng(seed)
    return random.integers(0, 1 << 32, size, dtype=np.uint32) | np.uint32(1), random.integers(0, 1 << 32, size, dtype=np.uint32)


OF_BANDS, OF_SKETCH = permutations(SEED, BANDS * ROWS), permutations(SEED + 1, SKETCH)
_ODD = np.uint32(0x9E3779B1)


def minima(found: np.ndarray, maps: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of the hashes' upper halves under each of the maps."""
    times, plus = maps
    least = np.full(len(times), np.iinfo(np.uint32).max, dtype=np.uint32)
    upper = (found >> np.uint64(32)).astype(np.uint32)[:, None]
    step = AT_ONCE // len(times)
    table = np.empty((min(step, len(upper)), len(times)), dtype=np.uint32)
    for i in range(0, len(upper), step):
        part = upper[i : i + step]
        here = np.multiply(part, times, out=table[: len(part)])
        here += plus
        np.minimum(least, here.min(axis=0), out=least)
    return least


def buckets(found: np.ndarray) -> list[int]:
    """A signed number for each band of the set's minima."""
    rows = minima(found, OF_BANDS).reshape(BANDS, ROWS)
    return [signed(xxh64_intdigest(row.tobytes(), band)) for band, row in enumerate(rows)]


def sketch(found: np.ndarray) -> np.ndarray:
    """A bit of each of the set's other minima, as LONGS numbers."""
    return np.packbits(minima(found, OF_SKETCH) * _ODD >> np.uint32(31) != 0).view("<i8")


def sketches(rows: DataFrame, words: int) -> DataFrame:
    """(_id, key, n, fp, buckets): of each row's set a digest, its size, fingerprint and buckets."""
    more = "key binary, n int, fp bigint, buckets array<bigint>"
    schema = T.StructType([rows.schema["_id"], *T.StructType.fromDDL(more)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [shingle_hashes(t, words) for t in batch["_text"].to_pylist()]
            sets = [np.unique(x) for x in every]
            keys = pa.array([xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            sizes = pa.array([len(x) for x in sets], pa.int32())
            prints = pa.array([signed(fingerprint(x)) for x in every], pa.int64())
            filed = pa.array([buckets(x) if len(x) else [] for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["_id"], keys, sizes, prints, filed], schema.names)

    return rows.mapInArrow(trimmed(work), schema)


def whole_sets(rows: DataFrame, words: int) -> DataFrame:
    """(key, hashes, sketch): each set once."""
    names = ["key", "hashes", "sketch"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words)) for t in batch["_text"].to_pylist()]
            keys = pa.array([xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            held = pa.array([x.view("<i8") for x in sets], pa.list_(pa.int64()))
            drawn = pa.array([sketch(x) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, held, drawn], names)

    kind = "key binary, hashes array<bigint>, sketch array<bigint>"
    return rows.select("_text").mapInArrow(trimmed(work), kind).dropDuplicates(["key"])


def sizes_allow(n: str, m: str):
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of keys whose sets have a similarity of at least four fifths."""
    one = sets.select(F.col("key").alias("a"), F.col("hashes").alias("x"))
    other = sets.select(F.col("key").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(one, "a").join(other, "b")
    # common / (|x| + |y| - common) >= 4 / 5
    enough = 9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))
    return both.filter(enough).select("a", "b")


def in_order(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b), the smaller first, each once."""
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def close_prints(distinct: DataFrame) -> DataFrame:
    """(a, b): keys with equal or close fingerprints; of those with equal ones each with the smallest only."""
    heads = distinct.groupBy("fp").agg(F.min("key").alias("head"), F.count("*").alias("n"))
    one, other = (heads.select(F.col("fp").alias(f"_{c}"), F.col("head").alias(c)) for c in "ab")
    close = close_pairs(heads.select("fp")).withColumnsRenamed({"a": "_a", "b": "_b"}).distinct()
    close = close.join(one, "_a").join(other, "_b").select("a", "b")
    equal = distinct.join(heads.filter("n > 1"), "fp").select(F.col("head").alias("a"), F.col("key").alias("b"))
    return close.unionByName(equal)


def near_edges(rows: DataFrame, distinct: DataFrame, words: int) -> DataFrame:
    """(a, b): edges between similar sets of ``distinct`` that have the components of all of them."""
    distinct = distinct.filter("n > 0")
    filed = distinct.select("key", "n", F.explode("buckets").alias("bucket"))
    shared = filed.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    busy = stored(filed.join(shared, "bucket"), "buckets")
    weight = busy.groupBy("key").agg(F.sum("members").alias("weight"))
    heads = busy.join(weight, "key").groupBy("bucket").agg(F.max(F.struct("weight", "key", "n")).alias("head"))
    star = busy.join(heads, "bucket").filter(sizes_allow("head.n", "n"))
    star = star.select(F.col("head.key").alias("a"), F.col("key").alias("b"))
    first = stored(in_order(star.unionByName(close_prints(distinct))), "near-candidates")
    met = busy.select("key").unionByName(first.select(F.explode(F.array("a", "b")).alias("key"))).distinct()
    wanted = distinct.join(met, "key", "left_semi").select(F.col("first").alias("_first")).distinct()
    texts = rows.join(wanted, rows["_id"].eqNullSafe(wanted["_first"]), "left_semi")
    sets = stored(whole_sets(texts, words), "sets")
    found = stored(alike(first, sets), "near-head")
    labels = components(found)
    member = busy.join(labels, busy["key"] == labels["node"], "left").select("bucket", "key", "n", F.coalesce("label", "key").alias("label"))
    mixed = member.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
    rest = member.join(mixed, "bucket", "left_semi").join(sets.select("key", "sketch"), "key")
    rest = stored(rest.select("bucket", "key", "n", "label", *[F.col("sketch")[i].alias(f"s{i}") for i in range(LONGS)]), "mixed-buckets")
    one = rest.select("bucket", *[F.col(c).alias(f"_{c}") for c in rest.columns if c != "bucket"])
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"_s{i}"))) for i in range(LONGS)])
    met = one.join(rest, "bucket").filter((F.col("_label") < F.col("label")) & sizes_allow("_n", "n") & (differ <= DIFFER))
    pairs = in_order(met.select(F.col("_key").alias("a"), F.col("key").alias("b")))
    return found.unionByName(alike(pairs, sets))


def keep_first_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` without those whose component of near copies has a smaller id.

    Rows of one id are one document: they stay or go together. Rows with null ids stay if their component has no
    other.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(docs[id_col].alias("_id"), whole_text(text_col).alias("_text"))
    marked = stored(sketches(texts, words), "sketches")
    some = [F.first(c).alias(c) for c in ("n", "buckets")]  # the same in all rows of a key
    # the fingerprint counts repeats, which may differ
    distinct = stored(marked.groupBy("key").agg(F.min("_id").alias("first"), F.min("fp").alias("fp"), *some), "distinct-sets")
    labels = components(near_edges(texts, distinct, words))
    labelled = distinct.join(labels, distinct["key"] == labels["node"], "left")
    labelled = labelled.select("key", "first", F.coalesce("label", "key").alias("label"))
    heads = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    named = labelled.join(heads, "label").select(F.col("key").alias("_key"), "component_id")
    rows = marked.select("_id", "key").join(named, F.col("key") == F.col("_key"))
    drop = rows.filter(~F.col("_id").eqNullSafe(F.col("component_id"))).select(F.col("_id").alias("_gone")).distinct()
    return docs.join(drop, docs[id_col].eqNullSafe(drop["_gone"]), "left_anti")
