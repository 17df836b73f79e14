"""How filters interact: what each removes in every order in which they may be applied, and their Shapley values.

1. Each document gets a mask of the filters that it fails. The first four look at its text alone; the fifth asks whether a row
   with a smaller id has the same text, by the texts' SHA-256. Rows are added up by text, part, mask and labels before
   texts meet, so that a text that a third of all rows share is a few rows.
2. A part is reduced to cells: how many of its documents have each mask, and how many of these are good or toxic.
3. The orders are visited by swaps of neighbours (each order differs from the one before in one swap). A step's numbers depend on
   its filter and on which filters came before it, so that a swap changes those of two steps only, which are added up from the
   cells again. What each filter removes is added up on the way, at every order: its Shapley value times the number
   of orders.

A null text is the empty text, and a null part the empty string. A document without words has no word too many or too few
repeated, and fails A alone of the first four. Rows whose id is null have no smaller id and are none themselves: they neither fail
E nor make others fail. Rows of one id and text are not smaller than each other. Several labels of one id: it is good (toxic) if
any of them says so; null labels say nothing. Every part has all orders and steps, zeros included; an empty table has no part. Only
the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeweft.llm.common import small_batches

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 3
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = b"#$%&*|"
#: Bytes of UTF-8 that go on with a character.
INNER = bytes(range(0x80, 0xC0))
#: Parts worked on at once.
PARTS_AT_ONCE = 16
NUMBERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_mask(text: bytes) -> int:
    """The bits of the filters A to D that a text fails, lowest first."""
    words = text.split()  # at the six white-space characters of ASCII
    few = len(words) < MIN_WORDS
    again = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    upper = 100 * (len(text) - len(text.translate(None, CAPITALS))) > UPPER_PERCENT * len(text.translate(None, INNER))
    signs = len(text.translate(None, SIGNS)) < len(text)
    return few | again << 1 | upper << 2 | signs << 3


def with_text_mask(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, mask, h) of every row, h the SHA-256 of its text."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), part.alias("part"), text.alias("text"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("mask", T.IntegerType()), T.StructField("h", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            masks = pa.array(map(text_mask, texts), pa.int32())
            hashes = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["part"], masks, hashes], schema.names)

    return rows.mapInArrow(work, schema)


def cells(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail."""
    rows = with_text_mask(docs, id_col, text_col, part_col)
    said = [F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(as_) for c, as_ in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(*said).filter("good or toxic")
    rows = rows.join(known, rows["id"] == known["_id"], "left")
    rows = rows.select("id", "part", "mask", "h", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    alike = ["h", "part", "mask", "good", "toxic"]
    # rows of an id and all else are one with a count, so that the smallest id comes with how often it is there
    rows = rows.groupBy("id", *alike).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")
    rows = rows.groupBy(*alike).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("none"), first)
    least = F.min("first.id").over(Window.partitionBy("h"))
    spared = F.col("none") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0)
    rows = rows.withColumn("spared", spared)
    last = 1 << len(FILTERS) - 1
    both = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("spared").alias("n")),
        F.struct((F.col("mask") + last).alias("mask"), (F.col("n") - F.col("spared")).alias("n")),
    )
    rows = rows.select("part", "good", "toxic", F.explode(both).alias("c"))
    total = [F.sum("c.n").alias("n"), *[F.sum(F.when(F.col(c), F.col("c.n")).otherwise(0)).alias(c) for c in ("good", "toxic")]]
    return rows.groupBy("part", F.col("c.mask").alias("mask")).agg(*total)


def swaps(n: int) -> list[int]:
    """Places k at which swapping k and k + 1, one after another, visits all orders of n things once.

    The last thing walks through the others, from end to end and back, and between two walks these take one step.
    """
    if n < 2:
        return []
    inner, out, back = [*swaps(n - 1), None], [], True
    for step in inner:
        walk = range(n - 1)
        out += reversed(walk) if back else walk
        if step is not None:
            # the walker stands at the front after walking back, and the others are one place further on then
            out.append(step + back)
        back = not back
    return out


class Walk:
    """The numbers of all orders of the filters, by swaps, from cells (parts, masks, (n, good, toxic))."""

    def __init__(self, table: np.ndarray, filters: int = len(FILTERS)):
        self.table, self.masks, self.filters = table, np.arange(1 << filters), filters
        self.total = table[:, :, 0].sum(axis=1)
        self.unique = [table[:, 1 << f, 0] for f in range(filters)]

    def step(self, f: int, before: int) -> np.ndarray:
        """(parts, (removed, good, toxic, redundant)) of filter f behind those of the mask ``before``."""
        fails = (self.masks >> f & 1) > 0
        gone = (self.masks & before) > 0
        here = self.table[:, fails & ~gone].sum(axis=1)
        return np.concatenate([here, self.table[:, fails & gone, 0].sum(axis=1)[:, None]], axis=1)

    def orders(self) -> Iterator[tuple[list[int], np.ndarray]]:
        """Each order with its steps' numbers (parts, steps, (removed, good, toxic, redundant)), changed in place."""
        order = list(range(self.filters))
        found = np.stack([self.step(f, (1 << f) - 1) for f in order], axis=1)
        yield order, found
        for k in swaps(self.filters):
            before = sum(1 << f for f in order[:k])
            order[k], order[k + 1] = order[k + 1], order[k]
            found[:, k] = self.step(order[k], before)
            found[:, k + 1] = self.step(order[k + 1], before | 1 << order[k])
            yield order, found

    def rows(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The orders, their filters (orders, steps), and NUMBERS (parts, orders, steps, numbers)."""
        names, filters, all_ = [], [], []
        shapley = np.zeros((len(self.table), self.filters), dtype=np.int64)
        for order, found in self.orders():
            names.append("".join(FILTERS[f] for f in order))
            filters.append(list(order))
            all_.append(found.copy())
            shapley[:, order] += found[:, :, 0]
        filters = np.array(filters)
        steps = np.stack(all_, axis=1)
        removed, good, toxic, redundant = np.moveaxis(steps, -1, 0)
        kept = self.total[:, None, None] - np.cumsum(removed, axis=2)
        unique = np.stack(self.unique, axis=1)[:, filters]
        return names, filters, np.stack([kept, removed, redundant, unique, good, toxic, shapley[:, filters]], axis=-1)


def interactions(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)"""
    found = cells(docs, labels, id_col, text_col, part_col)
    # a part has 32 cells at most
    held = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    fields = [T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType())]
    schema = T.StructType([held.schema["part"], *fields, *[T.StructField(c, T.LongType()) for c in NUMBERS]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pairwise([*range(0, len(batch), PARTS_AT_ONCE), len(batch)]):
                some = batch.slice(a, b - a)
                table = np.zeros((len(some), 1 << len(FILTERS), 3), dtype=np.int64)
                for i, row in enumerate(some["cells"].to_pylist()):
                    for c in row:
                        table[i, c["mask"]] = c["n"], c["good"], c["toxic"]
                names, filters, numbers = Walk(table).rows()
                orders, steps = filters.shape
                part = some["part"].take(pa.array(np.repeat(np.arange(len(some)), orders * steps)))
                name = pa.array(np.tile(np.repeat(names, steps), len(some)), pa.string())
                step = pa.array(np.tile(np.arange(1, steps + 1), len(some) * orders), pa.int32())
                columns = [pa.array(c) for c in numbers.reshape(-1, len(NUMBERS)).T]
                yield pa.RecordBatch.from_arrays([part, name, step, *columns], schema.names)

    return held.mapInArrow(work, schema)


AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         len(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, min(doc_id) OVER (PARTITION BY text) AS first
  FROM d
), m AS (
  SELECT w.part, l.good, l.toxic,
         [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * upper > 3 * len(text),
          regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails
  FROM w LEFT JOIN (
    SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
  ) l USING (doc_id)
), c AS (
  SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY part, fails
), f AS (
  SELECT unnest(range(1, 6)) AS i
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS ord FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT ord, i AS step, ord[i] AS filter, ord[1:i - 1] AS before FROM o, f
), x AS (
  SELECT c.part, s.ord, s.step, s.filter, n, good, toxic, fails[filter] AS here,
         list_bool_or(list_transform(before, lambda b: fails[b])) AS gone, len(list_filter(fails, lambda b: b)) AS failed
  FROM c, s
), y AS (
  SELECT part, ord, step, filter, sum(n) AS total,
         coalesce(sum(n) FILTER (here AND NOT coalesce(gone, false)), 0) AS removed,
         coalesce(sum(n) FILTER (here AND gone), 0) AS redundant,
         coalesce(sum(n) FILTER (here AND failed = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (here AND NOT coalesce(gone, false)), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (here AND NOT coalesce(gone, false)), 0) AS toxic_lost
  FROM x GROUP BY part, ord, step, filter
)
SELECT part, list_aggregate(list_transform(ord, lambda i: substr('ABCDE', i, 1)), 'string_agg', '') AS filter_order,
       step::INT AS step,
       (total - sum(removed) OVER (PARTITION BY part, ord ORDER BY step))::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM y
"""
