"""Token ids as files of canonical length-limited Huffman codes, and their table-driven decoding.

Code lengths come from the counts of all ids (package-merge, at most ``MAX_BITS`` bits). Documents lie in
ascending order of their ids in shards, which are ranges of those ids; a shard is a run of independent blocks. A
file row holds one block; one row more (shard -1) holds the code lengths, from which the canonical code follows.

A block's bytes, little-endian: magic, documents, checkpoints and interval as u4; each document's number of ids
and byte offset as u4; the checkpoints' bit offsets as u4; the codes, each document from a whole byte on, most
significant bit first. There is a checkpoint every ``INTERVAL`` ids of a document, so that a block is decoded from
all its checkpoints at once, one table look-up a step for each.

Null texts are empty documents: only the end id. Null document ids come first. Rows with equal ids lie next to
each other, fewer ids first and then by their codes. An empty table gives a file with no block. Only the id and
text columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeweft.llm.chunks import AT_ONCE_BYTES
from treeweft.llm.common import gathered, shared_path, small_batches, stored, whole_text
from treeweft.llm.token_ids import encode_texts

MAX_BITS = 16
INTERVAL = 128
MAGIC = 0x31465548
#: Bytes of codes after which a block is closed, and ids that a shard holds about.
BLOCK_BYTES = 2 << 20
SHARD_IDS = 8_000_000
MOST_SHARDS = 1 << 16
HEAD = struct.Struct("<4I")


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``most`` bits: package-merge. 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids don't fit codes of {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    n = len(order)
    # each level: the leaves merged with the pairs of the level below, in order of weight
    weights, is_leaf = leaves, np.ones(n, dtype=bool)
    levels = [is_leaf]
    for _ in range(most - 1):
        half = len(weights) // 2
        pairs = weights[0 : 2 * half : 2] + weights[1 : 2 * half : 2]
        both = np.concatenate([leaves, pairs])
        place = np.argsort(both, kind="stable")
        weights, is_leaf = both[place], place < n
        levels.append(is_leaf)
    take, found = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for is_leaf in reversed(levels):
        taken = int(is_leaf[:take].sum())
        found[:taken] += 1
        take = 2 * (take - taken)
    lengths[order] = found
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: in order of length, then id."""
    codes = np.zeros(len(lengths), dtype=np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    sizes = lengths[order].astype(np.int64)
    # in units of the longest code, each code starts where the one before it ends
    spans = np.left_shift(1, MAX_BITS - sizes)
    codes[order] = (np.cumsum(spans) - spans) >> (MAX_BITS - sizes)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every value of the next MAX_BITS bits the id they begin with, and its length."""
    ids, sizes = np.zeros(1 << MAX_BITS, dtype=np.int32), np.zeros(1 << MAX_BITS, dtype=np.int32)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    spans = np.left_shift(1, MAX_BITS - lengths[order].astype(np.int64))
    end = int(spans.sum())
    ids[:end], sizes[:end] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, sizes


def spread(starts: np.ndarray, counts: np.ndarray, step: int = 1) -> np.ndarray:
    """starts[i], starts[i]+step, ... counts[i] of them, for all i."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before * step, counts) + np.arange(int(counts.sum())) * step


def encode_documents(docs: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray):
    """For each document, which has one id at least, its codes and the bit offsets of its checkpoints, as bytes."""
    sizes = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
    ids = np.concatenate(docs).astype(np.int64)
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    last = np.cumsum(sizes) - 1
    first = last - sizes + 1
    begin = ends[first] - bits[first]
    wide = (ends[last] - begin + 7) // 8
    offset = np.cumsum(wide) - wide
    inside = ends - bits - np.repeat(begin, sizes)
    at = inside + np.repeat(offset * 8, sizes)
    value = codes[ids] << (32 - (at & 15) - bits)
    word, n = at >> 4, int(wide.sum()) // 2 + 2
    # codes don't overlap, so that adding up what falls into a 16-bit word puts them side by side
    words = np.bincount(word, value >> 16, n) + np.bincount(word + 1, value & 0xFFFF, n)
    stream = words.astype(">u2").tobytes()
    counts = -(-sizes // INTERVAL)
    marks = inside[spread(first, counts, INTERVAL)].astype("<u4").tobytes()
    edges = (np.cumsum(counts) * 4).tolist()
    for o, w, a, b in zip(offset.tolist(), wide.tolist(), [0, *edges], edges, strict=False):
        yield stream[o : o + w], marks[a:b]


def pack_block(sizes: list[int], streams: list[bytes], marks: list[bytes]) -> bytes:
    wide = np.fromiter(map(len, streams), dtype=np.int64, count=len(streams))
    offset = np.cumsum(wide) - wide
    counts = np.fromiter(map(len, marks), dtype=np.int64, count=len(marks)) // 4
    points = np.frombuffer(b"".join(marks), dtype="<u4") + np.repeat(offset * 8, counts)
    head = HEAD.pack(MAGIC, len(sizes), len(points), INTERVAL)
    return b"".join(
        [head, *[np.array(x).astype("<u4").tobytes() for x in (sizes, offset, points)], *streams]
    )


def unpack_block(data: bytes, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each document's number of ids, and all ids one after another."""
    magic, n_docs, n_points, interval = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block of Huffman codes")
    numbers = np.frombuffer(data, dtype="<u4", count=2 * n_docs + n_points, offset=HEAD.size).astype(np.int64)
    sizes, points = numbers[:n_docs], numbers[2 * n_docs :]
    stream = np.frombuffer(data, dtype=np.uint8, offset=HEAD.size + 4 * len(numbers))
    stream = np.concatenate([stream, np.zeros(4, dtype=np.uint8)]).astype(np.int32)
    ahead = (stream[:-2] << 16) | (stream[1:-1] << 8) | stream[2:]
    lanes = -(-sizes // interval)
    first = np.cumsum(sizes) - sizes
    starts = spread(first, lanes, interval)
    left = np.minimum(np.repeat(first + sizes, lanes) - starts, interval)
    order = np.argsort(-left, kind="stable")
    at, to = points[order], starts[order]
    going = np.searchsorted(-left[order], -np.arange(interval), side="left")
    ids, bits = table
    out = np.empty(int(sizes.sum()), dtype=np.uint32)
    for step in range(interval):
        n = going[step]
        if not n:
            break
        here = at[:n]
        seen = (ahead[here >> 3] >> (8 - (here & 7))) & 0xFFFF
        out[to[:n] + step] = ids[seen]
        at[:n] += bits[seen]
    return sizes, out


def encoded(docs: DataFrame, path: str, id_col: str, text_col: str, end: int) -> DataFrame:
    """(_id, width, ids, counts): the ids of each row's whole text as bytes, ``width`` to an id.

    Each task adds one row for which ``counts`` is true: its ids and how often it has them, as pairs of 8 bytes.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    schema = T.StructType([rows.schema["_id"], *T._parse_datatype_string("width int, ids binary, counts boolean")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = np.zeros(0, dtype=np.int64), None
        for batch in gathered(batches, AT_ONCE_BYTES):
            found, kind = encode_texts(batch["_text"].to_pylist(), path, end)
            here = np.bincount(np.frombuffer(b"".join(found), dtype=kind), minlength=len(total))
            here[: len(total)] += total
            total, key = here, batch["_id"].type
            columns = [[kind.itemsize] * len(found), found, [False] * len(found)]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["_id"], *arrays], schema.names)
        if kind is not None:
            used = np.flatnonzero(total)
            pairs = np.stack([used, total[used]], axis=1).astype("<i8").tobytes()
            arrays = [pa.array([None], key), pa.array([8], pa.int32()), pa.array([pairs], pa.binary()), pa.array([True])]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return rows.mapInArrow(work, schema)


def id_counts(rows: DataFrame) -> dict[int, int]:
    """How often each id occurs, from the tasks' counts; the driver holds a number for each id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs in batch["ids"].to_pylist():
                ids, n = np.frombuffer(pairs, dtype="<i8").reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["id", "n"])

    counted = rows.filter("counts").select("ids").mapInArrow(count, "id long, n long")
    return {r["id"]: r["n"] for r in counted.groupBy("id").agg(F.sum("n").alias("n")).collect()}


def write_ids(
    docs: DataFrame, path: str, out: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = 0
) -> str:
    """Write the ids of every row of ``docs`` in ascending order of ``id_col``, an int or a long; returns the folder."""
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, (T.IntegerType, T.LongType)):
        raise TypeError(f"{id_col} is neither an int nor a long")
    rows = stored(encoded(docs, path, id_col, text_col, end), "token-ids", parts=("counts",))
    counts = id_counts(rows)
    rows = rows.filter("not counts").drop("counts")
    freq = np.zeros(max(counts, default=0) + 1, dtype=np.int64)
    freq[list(counts)] = list(counts.values())
    lengths = code_lengths(freq)
    codes = canonical(lengths)
    shards = min(MOST_SHARDS, max(1, -(-int(freq.sum()) // SHARD_IDS)))
    cuts = [k / shards for k in range(1, shards)]
    found = rows.select(F.percentile_approx("_id", cuts, 100 * shards).alias("b")).head()["b"] if cuts else []
    bounds = np.array(sorted(set(found or [])), dtype=np.int64)
    id_type = rows.schema["_id"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            widths, ids = batch["width"].to_pylist(), batch["ids"].to_pylist()
            docs_ = [np.frombuffer(x, dtype=f"<u{w}") for x, w in zip(ids, widths, strict=True)]
            streams, marks = zip(*encode_documents(docs_, lengths, codes), strict=True)
            keys = batch["_id"].to_pylist()
            shard = [0 if k is None else int(np.searchsorted(bounds, k)) for k in keys]
            arrays = [pa.array(shard, pa.int32()), batch["_id"], pa.array(list(map(len, docs_)), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(streams, pa.binary()), pa.array(marks, pa.binary())],
                ["shard", "_id", "n", "codes", "marks"],
            )

    coded_schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            id_type,
            T.StructField("n", T.LongType()),
            T.StructField("codes", T.BinaryType()),
            T.StructField("marks", T.BinaryType()),
        ]
    )
    file_schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("block", T.IntegerType()),
            T.StructField("first", T.LongType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(id_type.dataType)),
            T.StructField("data", T.BinaryType()),
        ]
    )
    arrow_id = pa.int64() if isinstance(id_type.dataType, T.LongType) else pa.int32()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first, held = None, 0, 0, []

        def close():
            keys, sizes, streams, marks = zip(*held, strict=True)
            n = sum(sizes)
            row = [[shard], [block], [first], [n], [list(keys)], [pack_block(list(sizes), list(streams), list(marks))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(arrow_id), pa.binary()]
            return n, pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], file_schema.names)

        size = 0
        for batch in batches:
            for s, *row in zip(*[batch[c].to_pylist() for c in ("shard", "_id", "n", "codes", "marks")], strict=True):
                if held and (s != shard or size >= BLOCK_BYTES):
                    n, done = close()
                    yield done
                    block, first, held, size = block + 1, first + n, [], 0
                if s != shard:
                    shard, block, first = s, 0, 0
                held.append(row)
                size += len(row[2])
        if held:
            yield close()[1]

    ordered = (
        rows.mapInArrow(coded, coded_schema)
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", F.col("_id").asc_nulls_first(), "n", "codes")
    )
    table = spark.createDataFrame([(-1, 0, 0, 0, [], bytes(lengths))], file_schema)
    files = ordered.mapInArrow(blocks, file_schema).unionByName(table)
    out = out or shared_path(spark, "huffman")
    files.write.option("compression", "none").parquet(out)
    return out


def read_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files at ``path``.

    ``start`` counts the ids of all documents before it; ``ids`` are left out on request.
    """
    files = spark.read.parquet(path)
    lengths = np.frombuffer(files.filter("shard = -1").select("data").head()[0], dtype=np.uint8)
    table = decode_table(lengths)
    sums = files.filter("shard >= 0").groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    before, total = {}, 0
    for r in sums:  # one number for each of at most MOST_SHARDS shards
        before[r["shard"]] = total
        total += r["n"]
    element = files.schema["doc_ids"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("doc_id", element),
            *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")],
            *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                sizes, found = unpack_block(batch["data"][i].as_py(), table)
                ends = np.cumsum(sizes)
                cuts = list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))
                begin = before[batch["shard"][i].as_py()] + batch["first"][i].as_py()
                crc = [zlib.crc32(found[a:b]) for a, b in cuts]
                arrays = [batch["doc_ids"][i].values, pa.array(ends - sizes + begin), pa.array(sizes), pa.array(crc, pa.int64())]
                if ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(found.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return files.filter("shard >= 0").select("shard", "first", "doc_ids", "data").mapInArrow(work, schema)
