"""Exact substring deduplication with suffix arrays.

A byte goes if it lies in a 100-byte string that also starts earlier: in a document with a smaller id, or earlier
in the same one. Strings are judged on the input and may overlap; matches do not cross documents.

1. Every window of 100 bytes has an anchor, a 24-byte string that its bytes alone determine (see winnow.py). Equal
   windows have equal anchors, so windows whose anchor occurs once are unique; most of a corpus ends here.
2. The run of windows that share an occurrence of an anchor is a segment. Equal segments are one, with its earliest
   occurrence; all windows of its other occurrences are repeats. Repeated anchors are a bit table while they are
   few enough for its fixed size, and are joined beyond.
3. Distinct segments of one anchor that share the bytes on one of its sides are sorted by their suffixes (suffixes.py). Neighbours that agree in 100
   bytes are equal windows; all but the earliest of them are repeats. Anchors with more than ``MANY`` distinct
   segments are dealt by the bytes left and right of the anchor instead: of two equal windows, one of both agrees.
   With more than ``HUGE`` a group would outgrow what is sorted at once; its windows are told apart by their hashes,
   one by one, so that nothing of it needs to be in one place.
4. The repeats' spans go to their documents, whose kept bytes are put together.

Null texts are empty. Null ids come before others. Rows with one id are in the order of a hash of their texts; rows
with equal id and text are one document and come out alike. Texts under 100 bytes keep everything. An empty table
gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeweft.llm.common import small_batches, stored, whole_text
from treeweft.llm.lines import MOST_KEYS, bit_places, key_table, mix
from treeweft.llm.suffixes import sort_lanes, sort_one
from treeweft.llm.winnow import GRAM, WINDOW, anchors

MANY, HUGE = 64, 1 << 13
HALF = (WINDOW - GRAM) // 2
#: Bytes of segments that are sorted at once, and how many texts of like size make it worth to sort them side by side.
AT_ONCE = 1 << 21
SIDE_BY_SIDE = 48


def text_bytes(batch: pa.RecordBatch) -> list[bytes]:
    return batch["_text"].cast(pa.binary()).to_pylist()


def held(table: bytes, keys: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(table, dtype=np.uint8)
    hit = np.ones(len(keys), dtype=bool)
    for place in bit_places(keys):
        hit &= (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
    return hit


def anchor_hashes(rows: DataFrame) -> DataFrame:
    """(key): the hash of every anchor of every text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(anchors(text_bytes(batch))[1].view(np.int64))], ["key"])

    return rows.select("_text").mapInArrow(work, "key long")


def segment_key(h: np.ndarray, first: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One number for an occurrence of a segment, to look it up in a bit table."""
    return mix(h * np.uint64(3) + mix(ids.astype(np.uint64)) + first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def segments(rows: DataFrame, table=None, data: bool = False, wanted=None) -> DataFrame:
    """(h, sh, _id, _th, first, size) of the segments whose anchor the table holds; of all without a table.

    With ``data`` their bytes come along, and the hashes of the bytes left and right of the anchor. ``wanted`` is a
    table of the occurrences to keep; where ``rows`` have a column _firsts, those that begin at one of its places.
    """
    fields = [T.StructField("h", T.LongType()), T.StructField("sh", T.LongType()), rows.schema["_id"], rows.schema["_th"]]
    schema = T.StructType([*fields, *T._parse_datatype_string("first int, size int")])
    if data:
        schema = T.StructType([*schema, *T._parse_datatype_string("left long, right long, data binary")])
    listed = "_firsts" in rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            texts = text_bytes(batch)
            owner, h, place, first, last = anchors(texts)
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            starts = np.cumsum(sizes) - sizes
            hit = np.ones(len(h), dtype=bool) if table is None else held(table.value, h)
            if wanted is not None:
                keys = batch["_id"].fill_null(-1).to_numpy(zero_copy_only=False)
                hit &= held(wanted.value, segment_key(h, first - starts[owner], keys[owner]))
            if listed:
                places = [np.asarray(x or [], dtype=np.int64) + a for x, a in zip(batch["_firsts"].to_pylist(), starts.tolist(), strict=True)]
                hit &= np.isin(first, np.concatenate(places))
            if not hit.any():
                continue
            owner, h, place, first, last = owner[hit], h[hit], place[hit], first[hit], last[hit]
            raw = b"".join(texts)
            found = [raw[a : b + WINDOW] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            sh = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
            take = pa.array(owner)
            numbers = [(first - starts[owner]).astype(np.int32), (last - first + WINDOW).astype(np.int32)]
            arrays = [pa.array(h.view(np.int64)), pa.array(sh.view(np.int64)), batch["_id"].take(take), batch["_th"].take(take), *map(pa.array, numbers)]
            if data:
                left, right = [], []
                for p, a, b in zip(place.tolist(), first.tolist(), last.tolist(), strict=True):
                    # 0: the segment does not reach that far
                    left.append(xxhash.xxh3_64_intdigest(raw[p - HALF : p + GRAM], 1) if p - HALF >= a else 0)
                    far = p + GRAM + HALF
                    right.append(xxhash.xxh3_64_intdigest(raw[p:far], 2) if far <= b + WINDOW else 0)
                arrays += [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (left, right)]
                arrays.append(pa.array(found, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    kept = ["_id", "_th", "_text", *(["_firsts"] if listed else [])]
    return rows.select(*kept).mapInArrow(work, schema)


def window_spans(texts: DataFrame) -> DataFrame:
    """(_id, _th, begin, end) of the windows of the segments that an earlier one equals, each by its hash."""
    schema = T.StructType([*T._parse_datatype_string("w binary"), texts.schema["_id"], texts.schema["_th"], *T._parse_datatype_string("begin int")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch["data"].to_pylist()
            each = np.fromiter(map(len, data), dtype=np.int64, count=len(data)) - WINDOW + 1
            owner = np.repeat(np.arange(len(data)), each)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
            hashes = [xxhash.xxh3_128_digest(x[i : i + WINDOW]) for x in data for i in range(len(x) - WINDOW + 1)]
            begin = (batch["first"].to_numpy()[owner] + inside).astype(np.int32)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), batch["_id"].take(take), batch["_th"].take(take), pa.array(begin)], schema.names)

    windows = stored(texts.select("_id", "_th", "first", "data").mapInArrow(work, schema), "windows")
    place = F.struct("_id", "_th", "begin")
    firsts = windows.groupBy("w").agg(F.min(place).alias("p"), F.count("*").alias("n")).filter("n > 1").select("w", "p")
    again = windows.join(firsts, "w").filter(place > F.col("p"))
    return again.select("_id", "_th", "begin", (F.col("begin") + WINDOW).alias("end"))


def equal_windows(groups: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, segment, start): the windows of each group's segments that another of its windows equals.

    Segments are numbered through all groups; windows of one run are equal.
    """
    lanes = [np.frombuffer(b"".join(x + b"\0" for x in g), dtype=np.uint8).astype(np.int64) + 1 for g in groups]
    cuts = [np.cumsum([len(x) + 1 for x in g]) for g in groups]
    for lane, ends in zip(lanes, cuts, strict=True):
        lane[ends - 1] = 0
    first = np.cumsum([0, *map(len, groups)])
    by_size = sorted(range(len(lanes)), key=lambda i: len(lanes[i]))
    runs, owners, starts, n = [], [], [], 0

    def scan(lane: np.ndarray, base: np.ndarray, which: np.ndarray, order: np.ndarray) -> None:
        """``which`` and ``base``: for each place of ``lane`` its segment, -1 for none, and where that begins."""
        nonlocal n
        far = np.arange(len(lane)) - base
        order = order[(which[order] >= 0) & (far[order] >= 0)]
        if len(order) < 2:
            return
        text = lane.astype(np.uint8)  # 1..256 and 0: only 256 wraps, and separators are not inside windows
        rows = np.lib.stride_tricks.sliding_window_view(text, WINDOW)
        same = np.zeros(len(order), dtype=bool)
        for i in range(1, len(order), 1 << 16):
            part = slice(i, min(i + (1 << 16), len(order)))
            before = slice(part.start - 1, part.stop - 1)
            same[part] = (rows[order[part]] == rows[order[before]]).all(axis=1)
        run = np.cumsum(~same) + n
        n = int(run[-1])
        more = same | np.r_[same[1:], False]
        runs.append(run[more])
        owners.append(which[order[more]])
        starts.append(far[order[more]])

    def places(i: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place of a lane its segment, or -1 where no window starts, and the segment's beginning."""
        ends = cuts[i]
        begin = np.r_[0, ends[:-1]]
        sizes = ends - begin
        which = np.repeat(np.arange(len(ends)) + first[i], sizes)
        base = np.repeat(begin, sizes)
        inside = np.arange(len(which)) - base
        return np.where(inside + WINDOW < np.repeat(sizes, sizes), which, -1), base

    k = 0
    while k < len(by_size):
        size, stop, total = len(lanes[by_size[k]]), k, 0
        while stop < len(by_size) and len(lanes[by_size[stop]]) <= 2 * size and total < AT_ONCE:
            total += len(lanes[by_size[stop]])
            stop += 1
        part = by_size[k:stop]
        if len(part) >= SIDE_BY_SIDE:
            flat, order = sort_lanes([lanes[i] for i in part])
            sizes = np.array([len(lanes[i]) for i in part])
            shift = np.cumsum(sizes + 1) - sizes
            which, base = np.full(len(flat), -1), np.zeros(len(flat), dtype=np.int64)
            for i, at in zip(part, shift.tolist(), strict=True):
                w, b = places(i)
                which[at : at + len(w)], base[at : at + len(w)] = w, b + at
            # a run never goes from one text to the next: their segments have different anchors or neighbours
            scan(np.maximum(flat, 0), base, which, order[order >= 0])
        else:
            for i in part:
                w, b = places(i)
                scan(lanes[i], b, w, np.array(sort_one(lanes[i].tolist()), dtype=np.int64))
        k = stop
    if not runs:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    return np.concatenate(runs), np.concatenate(owners), np.concatenate(starts)


def repeated_spans(batch: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end): the bytes of the segments' occurrences in ``batch`` that an earlier window repeats.

    Rows with equal (h, sub) lie next to each other.
    """
    kept = np.flatnonzero(may_share(batch))
    if not len(kept):
        return kept, kept, kept
    row, begin, end = sorted_groups(batch.take(pa.array(kept)))
    return kept[row], begin, end


def may_share(batch: pa.Table) -> np.ndarray:
    """Which segments agree with another one of their group in the bytes left or right of the anchor: of two equal
    windows, one of both agrees."""
    h, sub = batch["h"].to_numpy(), batch["sub"].to_numpy()
    found = np.zeros(len(h), dtype=bool)
    for side in ("left", "right"):
        x = batch[side].to_numpy()
        order = np.lexsort((x, sub, h))
        same = (h[order[1:]] == h[order[:-1]]) & (sub[order[1:]] == sub[order[:-1]]) & (x[order[1:]] == x[order[:-1]]) & (x[order[1:]] != 0)
        found[order[1:][same]] = True
        found[order[:-1][same]] = True
    return found


def sorted_groups(batch: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """repeated_spans() by the suffix arrays of the groups."""
    h, sub = batch["h"].to_numpy(), batch["sub"].to_numpy()
    edges = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (sub[1:] != sub[:-1])])
    data = batch["data"].to_pylist()
    groups = [data[a:b] for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(data)], strict=True)]
    run, segment, start = equal_windows(groups)
    if not len(run):  # they agree beside the anchor, but in no whole window
        return run, run, run
    first = batch["first"].to_numpy().astype(np.int64)
    frame = batch.select(["_id", "_th"]).to_pandas()
    # equal windows have one anchor, but two groups of it may lie side by side
    group = (np.cumsum(np.bincount(edges, minlength=len(h))) - 1)[segment]
    ids = frame["_id"].to_numpy(dtype=object)
    null = np.array([x is None or x != x for x in ids])
    ids = np.where(null, 0, ids).astype(np.int64)
    th = frame["_th"].to_numpy()
    at = first[segment] + start
    order = np.lexsort((at, th[segment], ids[segment], ~null[segment], group, run))
    run, group, segment, start, at = run[order], group[order], segment[order], start[order], at[order]
    again = np.r_[False, (run[1:] == run[:-1]) & (group[1:] == group[:-1])]
    segment, at = segment[again], at[again]
    order = np.lexsort((at, segment))
    segment, at = segment[order], at[order]
    if not len(at):
        return segment, at, at
    edge = np.flatnonzero(np.r_[True, (segment[1:] != segment[:-1]) | (at[1:] > at[:-1] + 1)])
    last = np.r_[edge[1:] - 1, len(at) - 1]
    return segment[edge], at[edge], at[last] + WINDOW


def sorted_spans(texts: DataFrame) -> DataFrame:
    """(_id, _th, begin, end) of the repeats among the segments of each (h, sub)."""
    schema = T.StructType([texts.schema["_id"], texts.schema["_th"], *T._parse_datatype_string("begin int, end int")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []

        def spans(table: pa.Table) -> pa.RecordBatch:
            row, begin, end = repeated_spans(table)
            take = pa.array(row)
            keys = [table[c].combine_chunks().take(take) for c in ("_id", "_th")]
            keys = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in keys]
            return pa.RecordBatch.from_arrays([*keys, pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], schema.names)

        for batch in batches:
            if not len(batch):
                continue
            wait.append(batch)
            if sum(b.nbytes for b in wait) < AT_ONCE:
                continue
            table = pa.Table.from_batches(wait)
            h, sub = table["h"].to_numpy(), table["sub"].to_numpy()
            other = np.flatnonzero((h != h[-1]) | (sub != sub[-1]))
            whole = int(other[-1]) + 1 if len(other) else 0  # the last group may go on
            if whole:
                yield spans(table.slice(0, whole))
                wait = table.slice(whole).to_batches()
        if wait:
            yield spans(pa.Table.from_batches(wait))

    return texts.mapInArrow(work, schema)


def first_texts(rows: DataFrame, some: DataFrame, table) -> DataFrame:
    """segments() with data of the first occurrences in ``some``, and how many distinct ones their anchor has."""
    if some.count() <= MOST_KEYS:

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch["_id"].fill_null(-1).to_numpy(zero_copy_only=False)
                key = segment_key(batch["h"].to_numpy().view(np.uint64), batch["first"].to_numpy(), ids)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

        wanted = some.select("h", F.col("p._id").alias("_id"), F.col("p.first").alias("first"))
        places = rows.sparkSession.sparkContext.broadcast(key_table(wanted.mapInArrow(number, "key long")))
        texts = segments(rows, table, True, places)
    else:  # each document gets the list of its own
        lists = some.groupBy(F.col("p._id").alias("_lid"), F.col("p._th").alias("_lth")).agg(F.collect_set("p.first").alias("_firsts"))
        both = rows.join(lists, rows["_id"].eqNullSafe(lists["_lid"]) & (rows["_th"] == lists["_lth"]))
        texts = segments(both.select("_id", "_th", "_text", "_firsts"), None, True)
    texts = texts.dropDuplicates(["h", "sh", "_id", "_th", "first"])
    which = some.select("h", "sh", F.col("p").alias("_p"), "texts")
    return texts.join(which, ["h", "sh"]).filter(F.struct("_id", "_th", "first").eqNullSafe(F.col("_p")))


def repeats(rows: DataFrame) -> DataFrame:
    """(_id, _th, begin, end): spans of repeated bytes, which may overlap."""
    keys = anchor_hashes(rows).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    keys = stored(keys, "anchors")
    if keys.count() <= MOST_KEYS:
        table = rows.sparkSession.sparkContext.broadcast(key_table(keys))
        every = segments(rows, table)
    else:
        table = None
        every = segments(rows).join(keys.withColumnRenamed("key", "h"), "h", "left_semi")
    every = stored(every, "segments")
    place = F.struct("_id", "_th", "first")
    firsts = every.groupBy("h", "sh").agg(F.min(place).alias("p"), F.count("*").alias("n"))
    firsts = stored(firsts, "segment-firsts")
    later = firsts.filter("n > 1").select("h", "sh", "p")
    later = every.join(later, ["h", "sh"]).filter(place > F.col("p"))
    later = stored(later.select("_id", "_th", F.col("first").alias("begin"), (F.col("first") + F.col("size")).alias("end")), "spans")
    # written, so that the join below has two plain sides, of which a hot anchor's can be split
    many = stored(firsts.groupBy("h").agg(F.count("*").alias("texts")).filter("texts > 1"), "anchor-counts")
    some = stored(firsts.select("h", "sh", "p").join(many, "h"), "segment-groups")
    texts = first_texts(rows, some, table)
    huge = some.filter(F.col("texts") > HUGE)
    if not huge.isEmpty():
        texts = stored(texts, "segment-texts")
        later = later.unionByName(window_spans(texts.filter(F.col("texts") > HUGE)))
    texts = texts.filter(F.col("texts") <= HUGE)
    sub = F.when(F.col("texts") > MANY, F.array("left", "right")).otherwise(F.array(F.lit(1).cast("long")))
    texts = texts.select("h", "_id", "_th", "first", "data", "left", "right", F.explode(sub).alias("sub")).filter("sub <> 0")
    # by the anchor and side alone: as many parts as the session deals a shuffle to
    texts = texts.repartition("h", "sub").sortWithinPartitions("h", "sub")
    return later.unionByName(stored(sorted_spans(texts), "sorted-spans"))


def merged(begin: list[int], end: list[int]) -> list[tuple[int, int]]:
    """The union of spans, in order; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(begin, end, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept): the removed runs of each row's text, [begin, end), and its remaining bytes."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), whole_text(text_col).alias("_text"))
    rows = rows.withColumn("_th", F.xxhash64("_text"))
    spans = repeats(rows).groupBy(F.col("_id").alias("_sid"), F.col("_th").alias("_sth"))
    spans = spans.agg(F.collect_list("begin").alias("_begin"), F.collect_list("end").alias("_end"))
    both = rows.join(spans, rows["_id"].eqNullSafe(F.col("_sid")) & (F.col("_th") == F.col("_sth")), "left")
    both = both.select("_id", "_text", "_begin", "_end")
    schema = T.StructType(
        [rows.schema["_id"], *T._parse_datatype_string("n_bytes long, spans array<struct<begin: int, end: int>>, kept binary")]
    )
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = text_bytes(batch)
            found = [merged(a or [], b or []) for a, b in zip(batch["_begin"].to_pylist(), batch["_end"].to_pylist(), strict=True)]
            kept = []
            for raw, runs in zip(raws, found, strict=True):
                edges = [0, *[x for run in runs for x in run], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            arrays = [pa.array(map(len, raws), pa.int64()), pa.array([[{"begin": a, "end": b} for a, b in r] for r in found], kind)]
            yield pa.RecordBatch.from_arrays([batch["_id"], *arrays, pa.array(kept, pa.binary())], schema.names)

    return both.mapInArrow(work, schema).withColumnRenamed("_id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256)"""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return found.select(
        id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
