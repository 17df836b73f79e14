"""Pack tokenized documents into as few fixed-length sequences as large-item matching finds.

A packing depends on lengths alone, and there are at most ``capacity`` of those. So the corpus is reduced to how
many pieces have each length; the packing is found on these counts, as patterns (the lengths that share a
sequence) with how many sequences follow each; and every piece looks up its place by its number among the pieces
of its length. The driver's state is bounded by the capacity, never by the corpus.

* Large pieces (over a third of the capacity, so at most two a sequence): a maximum matching, taking the largest
  first, each with the largest piece that still fits beside it.
* Small pieces, longest first, go into the fullest sequence that has room: best fit on the gaps, and a new
  sequence only where no gap is left.

Null texts are empty documents and hold the end token alone. Rows with equal ids are packed apart, each as a
document of its own. Documents over the capacity are cut; the first piece takes the odd length. Only the id and
text columns are read. An empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeweft.llm.chunks import AT_ONCE_BYTES
from treeweft.llm.common import gathered, small_batches, stored, trimmed, whole_text
from treeweft.llm.token_ids import encode_texts

CAPACITY = 2048


def match_large(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of one or two large lengths with their multiplicity.

    The largest piece takes the largest partner that fits. A partner that fits it fits every smaller piece as
    well, and no two pieces over half the capacity can meet, so the number of pairs is the most possible.
    """
    left = {n: c for n, c in counts.items() if c}
    by_size = sorted(left, reverse=True)
    patterns = []
    for big in by_size:
        for other in by_size:
            if not left[big]:
                break
            if other > big or big + other > capacity or not left[other]:
                continue
            times = left[big] // 2 if other == big else min(left[big], left[other])
            if times:
                patterns.append(((big, other), times))
                left[big] -= times
                left[other] -= times
        if left[big]:
            patterns.append(((big,), left[big]))
            left[big] = 0
    return patterns


def best_fit(patterns: list[tuple[tuple[int, ...], int]], small: dict[int, int], capacity: int):
    """Fill the gaps of the patterns with small lengths, longest first, each into the smallest gap that holds it.

    Sequences with one pattern are filled alike: a gap takes as many pieces of the length at hand as it holds.
    """
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for pattern, times in patterns:
        open_[capacity - sum(pattern)].append((pattern, times))
    for n in sorted(small, reverse=True):
        need = small[n]
        for gap in sorted(g for g in open_ if g >= n):
            while need and open_[gap]:
                pattern, times = open_[gap].pop()
                each = gap // n
                whole = min(times, need // each)
                if whole < times:
                    open_[gap].append((pattern, times - whole))
                if whole:
                    open_[gap - each * n].append((pattern + (n,) * each, whole))
                    need -= whole * each
                elif need:
                    pattern, times = open_[gap].pop()
                    if times > 1:
                        open_[gap].append((pattern, times - 1))
                    open_[gap - need * n].append((pattern + (n,) * need, 1))
                    need = 0
        if need:
            each = capacity // n
            if need // each:
                open_[capacity - each * n].append(((n,) * each, need // each))
            if need % each:
                open_[capacity - need % each * n].append(((n,) * (need % each), 1))
    return [p for found in open_.values() for p in found]


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with multiplicity that hold ``counts[n]`` pieces of each length n."""
    large = {n: c for n, c in counts.items() if 3 * n > capacity}
    small = {n: c for n, c in counts.items() if 3 * n <= capacity and c}
    return best_fit(match_large(large, capacity), small, capacity)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length its runs of places: (first number, first sequence, offset, times), by first number.

    Piece first+i of the length lies at ``offset`` in sequence first_sequence+i.
    """
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    number: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            runs[n].append((number[n], sequence, offset, times))
            number[n] += times
            offset += n
        sequence += times
    return {n: np.array(r, dtype=np.int64) for n, r in runs.items()}


def pieces_of(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, number): number counts a task's pieces of each length."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    longs = ("piece", "start", "length", "ids_crc32", "part", "number")
    schema = T.StructType([rows.schema["_id"], *[T.StructField(c, T.LongType()) for c in longs]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in gathered(batches, AT_ONCE_BYTES):
            encoded, kind = encode_texts(batch["_text"].to_pylist(), path, end)
            owner, out = [], []
            for i, ids in enumerate(encoded):
                wide = np.frombuffer(ids, dtype=kind).astype("<u4")
                edge = len(wide) % capacity or capacity
                cuts = [0, *range(edge, len(wide), capacity), len(wide)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    owner.append(i)
                    out.append((k, a, b - a, zlib.crc32(wide[a:b].tobytes()), part, seen[b - a]))
                    seen[b - a] += 1
            columns = np.array(out, dtype=np.int64).reshape(-1, len(longs))
            arrays = [batch["_id"].take(pa.array(owner, pa.int64())), *[pa.array(c) for c in columns.T]]
            yield pa.RecordBatch.from_arrays(arrays, ["_id", *longs])

    return rows.mapInArrow(trimmed(work), schema)


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end: int = 0,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of ``docs``."""
    pieces = stored(pieces_of(docs, path, id_col, text_col, capacity, end), "pieces")
    # one row for each task and length: where the task's pieces of that length begin among all of that length
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        F.col("part").alias("_part"),
        F.col("length").alias("_length"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"),
    )
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = slots(pack_counts(total, capacity))
    numbered = pieces.join(
        first, (pieces["part"] == first["_part"]) & (pieces["length"] == first["_length"]), "inner"
    ).select("_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("_first")).alias("_number"))
    schema = T.StructType(
        [
            *numbered.drop("_number").schema,
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch["length"].to_numpy(), batch["_number"].to_numpy()
            sequence, offset = np.empty_like(length), np.empty_like(length)
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                table = runs[n]
                at = np.searchsorted(table[:, 0], number[rows], side="right") - 1
                sequence[rows] = table[at, 1] + number[rows] - table[at, 0]
                offset[rows] = table[at, 2]
            kept = [batch[c] for c in ("_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], schema.names)

    placed = numbered.mapInArrow(place, schema).withColumn("piece", F.col("piece").cast("int"))
    return placed.withColumnRenamed("_id", id_col)
