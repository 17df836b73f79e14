"""Pack tokenized documents into windows by best-fit decreasing, and close the gaps that are left.

Documents over the capacity are first cut into full windows; what is left of them, and the shorter documents, are the
pieces to pack. As in ``packing``, only how many pieces have each length matters, so that the packing is found on at most
``capacity`` counts, as patterns (the lengths that share a window) with how many windows follow each, and every piece looks up
its place by its number among the pieces of its length. The driver's state is bounded by the capacity.

* Best-fit decreasing: lengths from the longest on; each piece goes into the open window with the least room that
  holds it, which a segment tree over the room left in windows finds in logarithmic time, and a new window only where none does.
* Closing: a window whose length is a power of two needs no padding. Of the others, the least full are dissolved: their tokens,
  one after another, fill the gaps of the fuller ones, so that a piece is cut where a gap ends. The tokens left over
  are cut into windows whose lengths are powers of two. Nothing is padded then. Without ``close`` no piece is cut, and windows
  are padded.

Null texts are empty documents and hold the end token alone. Rows with equal ids are packed apart, each as a
document of its own. Only the id and text columns are read. An empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeweft.llm.chunks import AT_ONCE_BYTES
from treeweft.llm.common import gathered, small_batches, stored, whole_text
from treeweft.llm.token_ids import encode_texts

CAPACITY = 2048
END = 1
#: Pieces of dissolved windows up to which the rows of those that are cut go to all tasks, some 100 bytes each.
FEW = 50_000


class RoomTree:
    """Open windows by the room that they have left: how many kinds of them under each node of a segment tree."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.open = [0] * (2 * self.leaves)

    def change(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.open[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of ``need`` or more that an open window has."""
        node = self.leaves + need
        if self.open[node]:
            return need
        while node > 1:
            if not node & 1 and self.open[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.leaves:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with multiplicity that hold ``counts[n]`` pieces of each length n.

    Windows with one pattern are one entry. A piece of the same length as the one before goes into the same window while it
    fits, as no other has less room; so a window takes as many at once as it holds.
    """
    tree, held = RoomTree(capacity), defaultdict(list)

    def put(pattern, times):
        room = capacity - sum(pattern)
        held[room].append((pattern, times))
        tree.change(room, 1)

    for n in sorted((n for n, c in counts.items() if c), reverse=True):
        need = counts[n]
        while need:
            room = tree.tightest(n)
            if room is None:
                room, pattern, times = capacity, (), need
            else:
                pattern, times = held[room].pop()
                tree.change(room, -1)
            each = room // n
            whole = min(times, need // each)
            rest = need - whole * each if whole < times else 0
            last = min(rest, each)
            if whole:
                put(pattern + (n,) * each, whole)
            if last:
                put(pattern + (n,) * last, 1)
            if pattern and times - whole - (last > 0):
                put(pattern, times - whole - (last > 0))
            need -= whole * each + last
    return [p for found in held.values() for p in found]


def is_power(n: int) -> bool:
    return n & (n - 1) == 0


@dataclass
class Plan:
    """Where pieces go.

    ``runs[n]``: rows (first number, times, first window, offset, first place, step) of the pieces of length n, by
    first number. Those of a dissolved window have no window (-1), but a place in the stream of such tokens.
    ``gaps``: rows (first place, first window, room, offset, times), by first place: where the stream goes.
    ``dissolved``: how many pieces lie in dissolved windows.
    """

    runs: dict[int, np.ndarray]
    gaps: np.ndarray
    windows: int
    dissolved: int


def planned(patterns: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY, close: bool = True) -> Plan:
    def room_after(entry):
        return capacity - sum(entry[0])

    open_ = [e for e in patterns if close and not is_power(sum(e[0])) and room_after(e)]
    kept = [e for e in patterns if not (close and not is_power(sum(e[0])) and room_after(e))]
    # the fullest stay; as many as the tokens of all fill
    open_.sort(key=lambda e: (room_after(e), e[0]))
    stay = sum(sum(p) * t for p, t in open_) // capacity
    filled, dissolved = [], []
    for pattern, times in open_:
        here = min(times, stay)
        stay -= here
        if here:
            filled.append((pattern, here))
        if times > here:
            dissolved.append((pattern, times - here))
    runs, number = defaultdict(list), defaultdict(int)
    windows = place = 0
    for entries, gone in ((kept, False), (filled, False), (dissolved, True)):
        for pattern, times in entries:
            offset, size = 0, sum(pattern)
            for n in pattern:
                runs[n].append((number[n], times, *((-1, offset, place + offset, size) if gone else (windows, offset, 0, 0))))
                number[n] += times
                offset += n
            if gone:
                place += size * times
            else:
                windows += times
    gaps = []
    first, at = sum(t for _, t in kept), 0
    for pattern, times in filled:
        room = room_after((pattern, times))
        gaps.append((at, first, room, sum(pattern), times))
        at, first = at + room * times, first + times
    rest = place - at
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            gaps.append((at, windows, 1 << bit, 0, 1))
            at, windows = at + (1 << bit), windows + 1
    return Plan(
        {n: np.array(r, dtype=np.int64) for n, r in runs.items()},
        np.array(gaps, dtype=np.int64).reshape(-1, 5),
        windows,
        sum(len(p) * t for p, t in dissolved),
    )


def parts_of(plan: Plan, length: int, number: int) -> list[tuple[int, int, int, int]]:
    """(from, to, window, offset) of the parts of a piece; one, unless it lies in a dissolved window and is cut."""
    table = plan.runs[length]
    first, _, window, offset, place, step = table[np.searchsorted(table[:, 0], number, side="right") - 1].tolist()
    if window >= 0:
        return [(0, length, window + number - first, offset)]
    at, out, done = place + (number - first) * step, [], 0
    while done < length:
        begin, window, room, offset, _ = plan.gaps[np.searchsorted(plan.gaps[:, 0], at, side="right") - 1].tolist()
        which, inside = divmod(at - begin, room)
        size = min(room - inside, length - done)
        out.append((done, done + size, window + which, offset + inside))
        at, done = at + size, done + size
    return out


def pieces_of(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end: int) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, wide, part, at, ids): ``at`` counts a task's pieces of each length,
    ``wide`` is the number of bytes of an id."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    longs = ("start", "length", "ids_crc32", "doc_tokens", "wide", "part", "at")
    fields = [T.StructField(c, T.LongType()) for c in longs]
    schema = T.StructType([rows.schema["_id"], *fields, T.StructField("ids", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in gathered(batches, AT_ONCE_BYTES):
            encoded, kind = encode_texts(batch["_text"].to_pylist(), path, end)
            wide, owner, out, data = kind.itemsize, [], [], []
            for i, ids in enumerate(encoded):
                n = len(ids) // wide
                for a in range(0, n, capacity):
                    b = min(a + capacity, n)
                    owner.append(i)
                    data.append(ids[a * wide : b * wide])
                    out.append((a, b - a, checksum(data[-1], wide), n, wide, part, seen[b - a]))
                    seen[b - a] += 1
            columns = np.array(out, dtype=np.int64).reshape(-1, len(longs))
            arrays = [batch["_id"].take(pa.array(owner, pa.int64())), *[pa.array(c) for c in columns.T]]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(data, pa.binary())], schema.names)

    return rows.mapInArrow(work, schema)


def checksum(ids: bytes, wide: int) -> int:
    return zlib.crc32(np.frombuffer(ids, dtype=f"<u{wide}").astype("<u4").tobytes())


def with_parts(pieces: DataFrame, plan: Plan) -> DataFrame:
    """``pieces`` with ``parts``, an array of (from, to, window, offset), in place of their ``number``."""
    spot = T.StructType([T.StructField(c, T.LongType()) for c in ("begin", "end", "sequence_id", "offset")])
    schema = T.StructType([*pieces.drop("number").schema, T.StructField("parts", T.ArrayType(spot))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(map(parts_of, repeat(plan), batch["length"].to_pylist(), batch["number"].to_pylist()))
            flat = np.array([x for p in found for x in p], dtype=np.int64).reshape(-1, 4)
            ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            structs = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], spot.names)
            kept = batch.drop_columns(["number"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.ListArray.from_arrays(ends, structs)], schema.names)

    return pieces.mapInArrow(work, schema)


def part_rows(pieces: DataFrame, with_ids: bool) -> DataFrame:
    """One row for each of the parts of pieces that come with their ids."""
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    fields = [T.StructField(c, T.LongType()) for c in longs]
    last = [T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else []
    schema = T.StructType([pieces.schema["_id"], *fields, *last])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, out, held = [], [], []
            for i, row in enumerate(batch.to_pylist()):
                wide = row["wide"]
                for p in row["parts"]:
                    ids = row["ids"][p["begin"] * wide : p["end"] * wide]
                    owner.append(i)
                    size = p["end"] - p["begin"]
                    out.append((row["start"] + p["begin"], size, checksum(ids, wide), row["doc_tokens"], p["sequence_id"], p["offset"]))
                    held.append(np.frombuffer(ids, dtype=f"<u{wide}").astype(np.int64))
            columns = np.array(out, dtype=np.int64).reshape(-1, len(longs))
            arrays = [batch["_id"].take(pa.array(owner, pa.int64())), *[pa.array(c) for c in columns.T]]
            extra = [pa.array(held, pa.list_(pa.int64()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([*arrays, *extra], schema.names)

    return pieces.mapInArrow(work, schema)


def pack_windows(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    close: bool = True,
    with_ids: bool = False,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece of every row of ``docs``; on
    request also the ids themselves, as an array."""
    pieces = stored(pieces_of(docs, path, id_col, text_col, capacity, end), "window-pieces")
    light = pieces.drop("ids")
    # one row for each task and length: where the task's pieces of that length begin among all of that length
    counts = light.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        F.col("part").alias("_part"),
        F.col("length").alias("_length"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"),
    )
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = planned(best_fit_decreasing(total, capacity), capacity, close)
    here = (light["part"] == first["_part"]) & (light["length"] == first["_length"])
    numbered = light.join(first, here).withColumn("number", F.col("at") + F.col("_first")).drop("_part", "_length", "_first")
    placed = stored(with_parts(numbered, plan), "window-places")
    # pieces that stay whole are done; only the ids of those that are cut are fetched
    cut = placed if with_ids else placed.filter(F.size("parts") > 1)
    keys = [F.col(c).alias(f"_{c}") for c in ("part", "length", "at")]
    ids = pieces.select(*keys, "ids")
    if plan.dissolved <= FEW and not with_ids:
        cut = F.broadcast(cut)
    same = [cut[c] == ids[f"_{c}"] for c in ("part", "length", "at")]
    found = part_rows(cut.join(ids, same).select(*placed.columns, "ids"), with_ids)
    if not with_ids:
        whole = placed.filter(F.size("parts") == 1).select("*", F.col("parts")[0].alias("p"))
        found = found.unionByName(whole.select(*found.columns[:-2], "p.sequence_id", "p.offset"))
    return found.withColumnRenamed("_id", id_col)
