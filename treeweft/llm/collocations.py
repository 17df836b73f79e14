"""Collocations: phrases of a language whose words are found together far more often than by chance.

1. Every phrase of 1 to ``max_n`` words becomes a row (language, phrase, times) and is counted by a hash aggregate. A phrase that is
   there ``least`` times has parts that are, so that longer phrases are only exploded where all their words, and all
   their pairs of words, can be that frequent. Words are counted first, then hashes of pairs of frequent words, and then phrases.
   What is frequent is told by bit tables of fixed size, which may let others through, to be counted and dropped, and never hold one
   back; two pairs of one hash have at least as many together as each alone. Rows are added up within an Arrow batch
   first, and by Spark within a task before they are shuffled.
2. Each cut of a candidate joins the counts of its first part and of its rest; both are frequent, as the candidate is. Scores are
   worked out in Decimal of 38 digits, and the lowest-scoring cut counts.
3. A candidate goes if an extension by one word holds ``subsumed`` percent of its occurrences: any longer phrase that does lies
   behind such an extension, as counts only fall with length. That is an anti-join.
4. A window ranks what is left in each language, after each task has kept its own first ``most``.

A null text is empty, and a null language is ``und``. Texts are cut into pieces at punctuation and line ends, words at spaces
and tabs; phrases lie within pieces. Repeated rows count each. Ties go to more occurrences, then to the phrase that is first in
byte order. Languages without a candidate, and an empty table, give no row. Only the text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeweft.llm.chunks import AT_ONCE_BYTES
from treeweft.llm.common import gathered, small_batches, stored, whole_text
from treeweft.llm.lines import BASE, bit_places, key_table, mix

MAX_N = 5
LEAST = 100
MOST = 2000
SUBSUMED = 100
SALTS = 64
#: Buckets of hashes of pairs, and words of the corpus for which there is one more.
LEAST_BUCKETS = 64
BUCKET_WORDS = 1 << 20
#: Bytes of the table of languages up to which every task gets it.
BROADCAST_BYTES = 8 << 20
#: A-Z to a-z, tab to space, and what ends a piece to a line feed.
PLAIN = bytes.maketrans(
    bytes(range(ord("A"), ord("Z") + 1)) + b"\t.,;:!?\x0b\x0c\r", bytes(range(ord("a"), ord("z") + 1)) + b" " + b"\n" * 9
)
ROWS = T.StructType(
    [T.StructField("lang", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("phrase", T.StringType()), T.StructField("a", T.LongType())]
)


class Words:
    """The words of some texts of one language as numbers, with what breaks phrases between them as -1."""

    def __init__(self, texts: list[str]):
        data = "\n".join(texts).encode("utf-8", "surrogatepass").translate(PLAIN).replace(b"\n", b" \n ")
        tokens = pc.split_pattern(pa.array([data], pa.large_binary()), b" ").values.dictionary_encode()
        ids = tokens.indices.to_numpy().astype(np.int64)
        empty = pc.index(tokens.dictionary, pa.scalar(b"", pa.large_binary())).as_py()
        stop = pc.index(tokens.dictionary, pa.scalar(b"\n", pa.large_binary())).as_py()
        ids = ids[ids != empty]
        ids[ids == stop] = -1
        self.ids, self.words = ids, tokens.dictionary

    def counts(self) -> tuple[pa.Array, np.ndarray]:
        """Each word and how often it is there."""
        n = np.bincount(self.ids[self.ids >= 0], minlength=len(self.words))
        at = np.flatnonzero(n)
        return self.words.take(pa.array(at)), n[at]

    def only(self, good: np.ndarray) -> None:
        """Break phrases at all words but those marked in ``good``, by number."""
        self.ids = np.where((self.ids >= 0) & good[self.ids], self.ids, -1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places at which a pair of words begins, the number of each one's pair, and a place of each pair."""
        at = np.flatnonzero((self.ids[:-1] >= 0) & (self.ids[1:] >= 0))
        _, first, number = np.unique(self.ids[at] << 32 | self.ids[at + 1], return_index=True, return_inverse=True)
        return at, number, at[first]

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The k words from each place on, with spaces between them."""
        words = [self.words.take(pa.array(self.ids[at + i])) for i in range(k)]
        return pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary()))


def word_keys(lang: str, words: pa.Array) -> np.ndarray:
    """What Spark's xxhash64(lang, phrase) gives."""
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42)
    return np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in words.to_pylist()), dtype=np.uint64, count=len(words))


def pair_keys(first: np.ndarray, second: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket and a number of 32 bits for each pair of words, by their keys."""
    h = mix(first * BASE + second)
    return ((h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64), (h >> np.uint64(32)).astype(np.uint32)


def table_keys(bucket, number: np.ndarray) -> np.ndarray:
    return mix(np.asarray(bucket).astype(np.uint64) << np.uint64(32) | number.astype(np.uint64))


def planes(x: np.ndarray) -> bytes:
    """Numbers of 32 bits, a byte of all after the other, so that those that are small compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def let_through(table: bytes, keys: np.ndarray) -> np.ndarray:
    bits, good = np.frombuffer(table, dtype=np.uint8), np.ones(len(keys), dtype=bool)
    for place in bit_places(keys):
        good &= (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
    return good


def longer(words: Words, at: np.ndarray, number: np.ndarray, good: np.ndarray, max_n: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(k, phrases, times) for all k from 3 on, of phrases whose pairs are all marked in ``good``."""
    # the number of the frequent pair that begins at a place, or -1
    pair = np.full(len(words.ids) + max_n, -1, dtype=np.int64)
    pair[at] = np.where(good[number], number, -1)
    here, known = np.flatnonzero(pair >= 0), pair[pair >= 0]
    for k in range(3, max_n + 1):
        go_on = pair[here + k - 2] >= 0
        here, known = here[go_on], known[go_on]
        _, first, known, times = np.unique(
            known << 32 | pair[here + k - 2], return_index=True, return_inverse=True, return_counts=True
        )
        yield k, words.phrases(here[first], k), times


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    for batch in gathered(batches, AT_ONCE_BYTES):
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            yield lang, Words(texts)


def phrase_batch(lang: str, k: int, phrases: pa.Array, times: np.ndarray) -> pa.RecordBatch:
    langs = pa.array([lang]).take(pa.array(np.zeros(len(times), dtype=np.int64)))
    text = phrases.cast(pa.large_string(), safe=False).cast(pa.string())
    return pa.RecordBatch.from_arrays([langs, pa.array(np.full(len(times), k, dtype=np.int32)), text, pa.array(times.astype(np.int64))], ROWS.names)


def word_rows(rows: DataFrame) -> DataFrame:
    """(lang, k, phrase, a) of single words, each once for each batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in by_language(batches):
            yield phrase_batch(lang, 1, *words.counts())

    return rows.mapInArrow(work, ROWS)


def frequent_pairs(rows: DataFrame, words_table, buckets: int, least: int) -> DataFrame:
    """(key) of the hashes that pairs of frequent words have ``least`` times.

    A batch's numbers are sorted and become one row for each bucket, which hold their distances and times. There are as
    many buckets as keep those of one small.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in by_language(batches):
            keys = word_keys(lang, words.words)
            words.only(let_through(words_table.value, keys))
            at, number, first = words.pairs()
            bucket, low = pair_keys(keys[words.ids[first]], keys[words.ids[first + 1]], buckets)
            times = np.minimum(np.bincount(number, minlength=len(first)), 0xFFFFFFFF)
            order = np.lexsort((low, bucket))
            bucket, low, times = bucket[order], low[order], times[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else bucket
            ends = np.r_[cuts[1:], len(bucket)]
            gaps = [planes(np.diff(low[a:b], prepend=np.uint32(0))) for a, b in zip(cuts, ends, strict=False)]
            held = [planes(times[a:b]) for a, b in zip(cuts, ends, strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(gaps, pa.binary()), pa.array(held, pa.binary())], ["bucket", "gaps", "times"])

    def add(key, table: pa.Table) -> pa.Table:
        low = np.concatenate([np.cumsum(from_planes(x), dtype=np.uint32) for x in table["gaps"].to_pylist()])
        times = np.concatenate([from_planes(x) for x in table["times"].to_pylist()])
        numbers, at = np.unique(low, return_inverse=True)
        often = numbers[np.bincount(at, weights=times) >= least]
        return pa.table({"key": pa.array(table_keys(key[0].as_py(), often).view(np.int64))})

    counted = rows.mapInArrow(count, "bucket long, gaps binary, times binary")
    return counted.groupBy("bucket").applyInArrow(lambda k, t: add(k, t), "key long")


def phrase_rows(rows: DataFrame, words_table, pairs_table, buckets: int, max_n: int) -> DataFrame:
    """(lang, k, phrase, a) of all phrases of 2 words and more whose pairs the tables let through, each once for each batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in by_language(batches):
            keys = word_keys(lang, words.words)
            words.only(let_through(words_table.value, keys))
            at, number, first = words.pairs()
            pairs = pair_keys(keys[words.ids[first]], keys[words.ids[first + 1]], buckets)
            good = let_through(pairs_table.value, table_keys(*pairs))
            yield phrase_batch(lang, 2, words.phrases(first[good], 2), np.bincount(number, minlength=len(first))[good])
            for k, phrases, times in longer(words, at, number, good, max_n):
                yield phrase_batch(lang, k, phrases, times)

    return rows.mapInArrow(work, ROWS)


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "k", "phrase").agg(F.sum("a").alias("a"))


def phrase_counts(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_n: int = MAX_N, least: int = LEAST
) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, a) of all phrases that are there ``least`` times, and (lang, n) of all words."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))
    words = stored(summed(word_rows(rows)), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = words.filter(F.col("a") >= least)
    words_table = spark.sparkContext.broadcast(key_table(frequent.select(F.xxhash64("lang", "phrase").alias("key"))))
    buckets = LEAST_BUCKETS + (totals.agg(F.sum("n")).head()[0] or 0) // BUCKET_WORDS
    keys = stored(frequent_pairs(rows, words_table, buckets, least), "pairs")
    pairs_table = spark.sparkContext.broadcast(key_table(keys))
    phrases = summed(phrase_rows(rows, words_table, pairs_table, buckets, max_n)).filter(F.col("a") >= least)
    return frequent.unionByName(stored(phrases, "phrases")), totals


def with_totals(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """``rows`` with the n of their language. Few languages go to all tasks, so that no row moves; with more, as one may hold most
    rows, each row meets one of SALTS copies of its language's total."""
    size = totals.agg(F.count("*").alias("c"), F.sum(F.octet_length("lang")).alias("b")).head()
    if 32 * size["c"] + (size["b"] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(totals), "lang")
    copies = totals.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).join(copies, ["lang", "_salt"]).drop("_salt")


def score_of(a: F.Column, n: F.Column, l: F.Column, r: F.Column) -> F.Column:  # noqa: E741
    """floor(1000 a n / (l r)) with products of up to 38 digits; the quotient is at most 1000 n."""
    a, n, l, r = (c.cast("decimal(18,0)") for c in (a, n, l, r))  # noqa: E741
    over = (a * F.lit(1000).cast("decimal(4,0)") * n).cast("decimal(38,0)")
    return F.call_function("div", over, (l * r).cast("decimal(38,0)"))


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, k, phrase, a, l, r, n, score) of all candidates, by their lowest-scoring cuts."""
    candidates = with_totals(counts.filter("k >= 2"), totals)
    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = candidates.select("*", cut).select(
        "*",
        F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("head"),
        F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("tail"),
    )
    heads = counts.select(F.col("lang").alias("_hl"), F.col("phrase").alias("head"), F.col("a").alias("l"))
    tails = counts.select(F.col("lang").alias("_tl"), F.col("phrase").alias("tail"), F.col("a").alias("r"))
    both = cuts.join(heads, (F.col("lang") == F.col("_hl")) & (cuts["head"] == heads["head"])).drop("_hl", "head")
    both = both.join(tails, (F.col("lang") == F.col("_tl")) & (both["tail"] == tails["tail"])).drop("_tl", "tail")
    both = both.withColumn("score", score_of(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    lowest = F.min(F.struct("score", "cut", "l", "r")).alias("m")
    return both.groupBy("lang", "k", "phrase", "a", "n").agg(lowest).select("lang", "k", "phrase", "a", "m.l", "m.r", "n", "m.score")


def without_subsumed(candidates: DataFrame, counts: DataFrame, subsumed: int = SUBSUMED) -> DataFrame:
    """The candidates of which no longer phrase holds ``subsumed`` percent of the occurrences."""
    words = F.split("phrase", " ")
    inner = [F.array_join(F.slice(words, F.lit(at), F.col("k") - 1), " ") for at in (1, 2)]
    longer = counts.filter("k >= 3").select(F.col("lang").alias("_l"), F.explode(F.array(*inner)).alias("_p"), F.col("a").alias("_a"))
    most = longer.groupBy("_l", "_p").agg(F.max("_a").alias("_a"))
    held = (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")) & (F.lit(100) * F.col("_a") >= F.lit(subsumed) * F.col("a"))
    return candidates.join(most, held, "left_anti")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    max_n: int = MAX_N,
    least: int = LEAST,
    most: int = MOST,
    subsumed: int = SUBSUMED,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``most`` collocations of each language."""
    counts, totals = phrase_counts(docs, text_col, lang_col, max_n, least)
    left = without_subsumed(scored(counts, totals), counts, subsumed)
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
WITH w AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), e AS MATERIALIZED (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w
), g AS MATERIALIZED (
  SELECT lang, k, words[i:i + k - 1] AS words, count(*) AS a
  FROM e, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(words) GROUP BY ALL
), t AS MATERIALIZED (
  SELECT lang, sum(a) AS n FROM g WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT * FROM g WHERE k >= 2 AND a >= 100
), f AS MATERIALIZED (
  SELECT * FROM g WHERE a >= 100
), x AS MATERIALIZED (
  SELECT *, words[1:cut] AS head, words[cut + 1:] AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)
), s AS (
  SELECT x.lang, x.k, x.words, x.a, t.n, cut, h.a AS l, r.a AS r,
         (1000::HUGEINT * x.a::HUGEINT * t.n::HUGEINT) // (h.a::HUGEINT * r.a::HUGEINT) AS score
  FROM x JOIN f h ON h.lang = x.lang AND h.words = x.head JOIN f r ON r.lang = x.lang AND r.words = x.tail
  JOIN t ON t.lang = x.lang
), m AS MATERIALIZED (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1
), inner_ AS MATERIALIZED (
  SELECT lang, words[i:i + k - 1] AS words, max(a) AS a
  FROM (SELECT lang, words, a, len(words) AS long, unnest(range(1, len(words) + 1)) AS i FROM c), (SELECT unnest(range(2, 5)) AS k)
  WHERE k < long AND i + k - 1 <= long GROUP BY ALL
)
SELECT m.lang, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, m.a DESC, array_to_string(m.words, ' ')) AS rank,
       array_to_string(m.words, ' ') AS phrase,
       m.a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM m LEFT JOIN inner_ i ON i.lang = m.lang AND i.words = m.words
WHERE i.a IS NULL OR 100 * i.a < 100 * m.a
QUALIFY rank <= 2000
"""
