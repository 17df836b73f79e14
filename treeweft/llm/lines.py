"""Line deduplication with a deletion-neighbourhood join.

A line goes if an earlier line, in this or another document, equals it or differs in one edit (a character put in,
left out or replaced). Lines are compared without the white space around them; empty ones always stay. What counts as an edit
of a line is the argument ``fuzzy``: from so many characters on one edit is allowed, and shorter lines have to be equal, as another
character makes another line of them. It may be any number from 1 on. Earlier is by document id (nulls first), then a hash of the text,
then the line's number; a line is judged by the whole input, not by what is left of it.

1. Every line gets a 128-bit hash, and keys of ``PARTS`` partial lines: of two lines one edit apart, all but one
   part are equal. Keys that meet one line only are of no use; what holds of the others is a fixed-size bit table. Lines too
   short for parts have no keys, and all of their few variants are emitted.
2. The lines that the table lets through emit their deletion neighbourhood: hashes of the line and of all variants
   with one character left out, in the parts where their keys allow an edit. Variants with the same character place left out belong to lines one replacement
   apart, and each only needs the earliest of them; a variant that is a whole line belongs to lines one insertion
   apart. So no group is expanded into pairs. Each link's edit distance is verified on the texts.
3. Each line is held against the earliest of its equals and neighbours.

Null texts are empty documents. Rows with equal id and text are cleaned alike. An empty table gives an empty
result. Only the id and text columns are read, all others are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeweft.llm.common import parts_of, small_batches, stored, trimmed, whole_text

#: Characters from which on a line may differ in one edit, unless the caller says otherwise.
MIN_FUZZY = 20
PARTS = 4
STEP = 4
#: Shorter lines have no parts, so that a line of up to so many characters may be one edit away from one without.
PARTED = PARTS * STEP
BLANK = " \t\r\v\f"
#: log2 of the bits of the table of keys; 16 MB whatever the input.
TABLE_BITS = 27
#: Keys up to which the table lets few others through (one in twenty), and is used.
MOST_KEYS = 1 << TABLE_BITS - 3
#: A line is hot from this share of all lines on, so that there are at most as many hot ones.
HOT = 1000
PAGE = 4096
#: Bytes of texts whose lines are hashed at once; that takes several arrays of 8 bytes a character.
PART_BYTES = 1 << 19

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class Rolled:
    """Hashes of any pieces of many lines, from running sums over all their characters."""

    def __init__(self, lines: list[str]):
        self.sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
        self.starts = np.cumsum(self.sizes) - self.sizes
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        powers = np.full(len(codes) + 1, BASE)
        powers[0] = 1
        self.back = np.full(len(codes) + 1, INVERSE)
        self.back[0] = 1
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self.back, out=self.back)
        terms = mix(codes.astype(np.uint64) + np.uint64(1)) * powers[:-1]
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def piece(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The hash of the characters from place a to b among all lines."""
        return (self.sums[b] - self.sums[a]) * self.back[a]

    def keys(self, parts: int = PARTS, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, key, span): two lines of 1 edit share a key, made of all parts but the one with the edit.

        ``span`` is that part's first place and the place after its last.
        """
        lines, found, spans = [], [], []
        unit = self.sizes // parts // step * step
        other = np.maximum(self.sizes - 1, 0) // parts // step * step
        every = np.arange(len(self.sizes))
        for size, of in ((unit, every[unit > 0]), (other, every[(other > 0) & (other != unit)])):
            u, a, n = size[of], self.starts[of], self.sizes[of]
            for k in range(parts):
                head = self.piece(a, a + k * u)
                tail = self.piece(a + n - (parts - 1 - k) * u, a + n)
                lines.append(of)
                found.append(mix(mix(head + np.uint64(k + 1)) + mix(tail) * MIX1 + u.astype(np.uint64)))
                spans.append(np.stack([k * u, (k + 1) * u if k < parts - 1 else n], axis=1))
        return np.concatenate(lines), np.concatenate(found), np.concatenate(spans)

    def neighbourhood(self, of: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, place, hash): place -1 is the whole line, others leave that character out.

        Characters are left out within ``spans`` of the lines ``of``.
        """
        begin, wide = self.starts[of] + spans[:, 0], spans[:, 1] - spans[:, 0]
        at = np.repeat(begin - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
        at = np.unique(at)
        line = np.searchsorted(self.starts, at, side="right") - 1
        start, size = self.starts[line], self.sizes[line]
        short = (self.sums[at] - self.sums[start]) + (self.sums[start + size] - self.sums[at + 1]) * INVERSE
        short = mix(short * self.back[start] + mix((size - 1).astype(np.uint64)))
        every = np.arange(len(self.sizes))
        whole = self.piece(self.starts, self.starts + self.sizes)
        whole = mix(whole + mix(self.sizes.astype(np.uint64)))
        place = np.concatenate([np.full(len(every), -1), at - start])
        return np.concatenate([every, line]), place, np.concatenate([whole, short])


def one_edit(a: str, b: str) -> bool:
    """Whether the edit distance of two different lines is 1."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def split(text: str) -> list[str]:
    return [x.strip(BLANK) for x in text.split("\n")]


def long_hash(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def bit_places(keys: np.ndarray, bits: int = TABLE_BITS) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << bits) - 1)
    return (keys & low).astype(np.int64), ((keys >> np.uint64(bits)) & low).astype(np.int64)


def line_rows(rows: DataFrame, fuzzy: int) -> DataFrame:
    """(_id, _th, line, h, keys): the lines that aren't empty of (_id, _th, _text), keys from ``fuzzy`` characters on."""
    schema = T.StructType(
        [
            rows.schema["_id"],
            rows.schema["_th"],
            T.StructField("line", T.IntegerType()),
            T.StructField("h", T.BinaryType()),
            T.StructField("keys", T.ArrayType(T.LongType())),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, "_text", PART_BYTES):
            owner, number, lines = [], [], []
            for i, text in enumerate(batch["_text"].to_pylist()):
                for k, line in enumerate(split(text)):
                    if line:
                        owner.append(i)
                        number.append(k)
                        lines.append(line)
            if not lines:
                continue
            long_ = [n for n, x in enumerate(lines) if len(x) >= fuzzy]
            of, keys, _ = Rolled([lines[n] for n in long_]).keys()
            of = np.array(long_, dtype=np.int64)[of]
            order = np.argsort(of, kind="stable")
            ends = np.r_[0, np.cumsum(np.bincount(of, minlength=len(lines)))].astype(np.int32)
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["_id"].take(take),
                    batch["_th"].take(take),
                    pa.array(number, pa.int32()),
                    pa.array(map(long_hash, lines), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[order].view(np.int64))),
                ],
                schema.names,
            )

    return rows.mapInArrow(trimmed(work), schema)


def key_table(keys: DataFrame) -> bytes:
    """A bit table of at most MOST_KEYS keys: two bits each among 2^TABLE_BITS, gathered page by page."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << TABLE_BITS - 3, dtype=np.uint8)
        for batch in batches:
            for place in bit_places(batch["key"].to_numpy().view(np.uint64)):
                np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
        pages = bits.reshape(-1, PAGE)
        used = np.flatnonzero(pages.any(axis=1))
        data = pa.array([pages[i].tobytes() for i in used], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(used), data], ["page", "bits"])

    def join(_, table: pa.Table) -> pa.Table:
        both = np.zeros(PAGE, dtype=np.uint8)
        for data in table["bits"].to_pylist():
            both |= np.frombuffer(data, dtype=np.uint8)
        return pa.table({"page": table["page"][:1], "bits": pa.array([both.tobytes()], pa.binary())})

    kind = "page long, bits binary"
    marked = keys.select("key").coalesce(64).mapInArrow(mark, kind)  # a page from each task at most
    table = bytearray(1 << TABLE_BITS - 3)
    for row in marked.groupBy("page").applyInArrow(lambda k, t: join(k, t), kind).collect():
        table[row["page"] * PAGE : (row["page"] + 1) * PAGE] = row["bits"]
    return bytes(table)


def long_lines(batch: pa.RecordBatch, fuzzy: int) -> list[str]:
    return list({x for t in batch["_text"].to_pylist() for x in split(t) if len(x) >= fuzzy})


def unparted(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of lines that a line without parts may be one edit away from, and each one's whole span."""
    short = np.array([i for i, x in enumerate(lines) if len(x) <= PARTED], dtype=np.int64)
    return short, np.array([(0, len(lines[i])) for i in short.tolist()], dtype=np.int64).reshape(-1, 2)


def passed_lines(rows: DataFrame, table, fuzzy: int) -> DataFrame:
    """(h, text, spans) of the lines with a key that the table holds: where those keys allow an edit."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, dtype=np.uint8)
        for batch in parts_of(batches, "_text", PART_BYTES):
            lines = long_lines(batch, fuzzy)
            if not lines:
                continue
            of, keys, spans = Rolled(lines).keys()
            hit = np.ones(len(keys), dtype=bool)
            for place in bit_places(keys):
                hit &= (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
            short, whole = unparted(lines)
            of, spans = np.concatenate([of, short]), np.concatenate([spans, whole])
            hit = np.concatenate([hit, np.ones(len(short), dtype=bool)])
            order = np.flatnonzero(hit)[np.argsort(of[hit], kind="stable")]
            which, counts = np.unique(of[order], return_counts=True)
            found = [lines[i] for i in which.tolist()]
            hashes = pa.array(map(long_hash, found), pa.binary())
            ends = pa.array(np.r_[0, 2 * np.cumsum(counts)].astype(np.int32))
            where = pa.ListArray.from_arrays(ends, pa.array(spans[order].ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([hashes, pa.array(found, pa.string()), where], ["h", "text", "spans"])

    found = rows.select("_text").mapInArrow(trimmed(work), "h binary, text string, spans array<int>")
    return found.groupBy("h").agg(F.first("text").alias("text"), F.first("spans").alias("spans"))


def joined_lines(rows: DataFrame, shared: DataFrame, fuzzy: int) -> DataFrame:
    """passed_lines for more keys than a table takes: the lines' keys meet the shared ones in a join."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if lines := long_lines(batch, fuzzy):
                of, keys, spans = Rolled(lines).keys()
                hashes = pa.array(map(long_hash, lines), pa.binary()).take(pa.array(of))
                ends = [pa.array(c.astype(np.int32)) for c in spans.T]
                yield pa.RecordBatch.from_arrays([hashes, pa.array(keys.view(np.int64)), *ends], ["h", "key", "a", "b"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = long_lines(batch, fuzzy)
            yield pa.RecordBatch.from_arrays([pa.array(map(long_hash, lines), pa.binary()), pa.array(lines, pa.string())], ["h", "text"])

    def short_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = long_lines(batch, fuzzy)
            of, whole = unparted(lines)
            hashes = pa.array([long_hash(lines[i]) for i in of.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([hashes, *[pa.array(c.astype(np.int32)) for c in whole.T]], ["h", "a", "b"])

    held = rows.select("_text").mapInArrow(parts, "h binary, key long, a int, b int").join(shared, "key", "left_semi").drop("key")
    if fuzzy <= PARTED:
        held = held.unionByName(rows.select("_text").mapInArrow(short_ones, "h binary, a int, b int"))
    spans = held.groupBy("h").agg(F.flatten(F.transform(F.collect_set(F.struct("a", "b")), lambda s: F.array(s["a"], s["b"]))).alias("spans"))
    text = rows.select("_text").mapInArrow(texts, "h binary, text string").groupBy("h").agg(F.first("text").alias("text"))
    return text.join(spans, "h")


def neighbourhoods(lines: DataFrame) -> DataFrame:
    """(h, pos, place, v) of the whole of each line and its variants of one deletion within its spans."""
    schema = T.StructType([lines.schema["h"], lines.schema["pos"], *T._parse_datatype_string("place int, v long")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 128):
                part = batch.slice(i, 128)
                spans = part["spans"].to_pylist()
                owner = np.repeat(np.arange(len(part)), [len(x) // 2 for x in spans])
                flat = np.array([y for x in spans for y in x], dtype=np.int64).reshape(-1, 2)
                of, place, v = Rolled(part["text"].to_pylist()).neighbourhood(owner, flat)
                take = pa.array(of)
                kinds = [pa.array(place.astype(np.int32)), pa.array(v.view(np.int64))]
                yield pa.RecordBatch.from_arrays([part["h"].take(take), part["pos"].take(take), *kinds], schema.names)

    return lines.select("h", "pos", "text", "spans").mapInArrow(work, schema)


def verified(pairs: DataFrame) -> DataFrame:
    """The (h, best) of those (h, best, text, other) whose texts are one edit apart."""
    schema = T.StructType([pairs.schema["h"], pairs.schema["best"]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, others = batch["text"].to_pylist(), batch["other"].to_pylist()
            good = pa.array([one_edit(a, b) for a, b in zip(texts, others, strict=True)], pa.bool_())
            yield batch.select(["h", "best"]).filter(good)

    return pairs.mapInArrow(work, schema)


def near_links(rows: DataFrame, lines: DataFrame, firsts: DataFrame, fuzzy: int) -> DataFrame:
    """(h, best): lines with an earlier line one edit away, and the earliest such place."""
    spark = rows.sparkSession
    keys = lines.select(F.xxhash64("h").alias("x"), F.explode("keys").alias("key")).groupBy("key")
    shared = keys.agg(F.min("x").alias("a"), F.max("x").alias("b")).filter("a <> b").select("key")
    shared = stored(shared, "line-keys")
    if shared.count() <= MOST_KEYS:
        texts = passed_lines(rows, spark.sparkContext.broadcast(key_table(shared)), fuzzy)
    else:
        texts = joined_lines(rows, shared, fuzzy)
    texts = stored(texts.join(firsts.select("h", "pos"), "h"), "line-texts")
    near = stored(neighbourhoods(texts), "line-variants")
    variants = near.filter("place >= 0")
    alike = Window.partitionBy("v", "place")
    replaced = variants.withColumn("m", F.min(F.struct("pos", "h")).over(alike))
    replaced = replaced.select("h", "pos", F.col("m.h").alias("to"), F.col("m.pos").alias("best"))
    whole = near.filter("place = -1").select(F.col("v").alias("w"), F.col("h").alias("to"), F.col("pos").alias("best"))
    longer = variants.join(whole, variants["v"] == whole["w"]).select("h", "pos", "to", "best")
    shorter = longer.select(F.col("to").alias("h"), F.col("best").alias("pos"), F.col("h").alias("to"), F.col("pos").alias("best"))
    links = replaced.unionByName(longer).unionByName(shorter).filter("best < pos").distinct()
    other = texts.select(F.col("h").alias("to"), F.col("text").alias("other"))
    pairs = links.join(texts.select("h", "text"), "h").join(other, "to").select("h", "best", "text", "other")
    return verified(pairs).groupBy("h").agg(F.min("best").alias("near"))


def without_lines(texts: pa.Array, numbers: pa.Array) -> pa.Array:
    """Each text without the lines of these numbers; null without any."""
    out = []
    for text, gone in zip(texts, numbers, strict=True):
        if gone.is_valid:
            lines = text.as_py().split("\n")
            stay = np.ones(len(lines), dtype=bool)
            stay[gone.values.to_numpy()] = False
            out.append("\n".join(compress(lines, stay)))
        else:
            out.append(None)
    return pa.array(out, pa.string())


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    counts: bool = False,
    drop_emptied: bool = False,
    fuzzy: int = MIN_FUZZY,
) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text_col``; on request also n_lines, n_exact and n_near.

    A document that loses lines and a null text come out as the text that is left. ``n_near`` counts lines that
    only a line one edit away took out. ``drop_emptied`` leaves out documents of which nothing but white space is
    left. Columns of ``docs`` that are named like the counts give way to these if they are asked for. Lines of fewer than
    ``fuzzy`` characters go for equality only.
    """
    if fuzzy < 1:
        raise ValueError("an empty line is no line: fuzzy is 1 at least")
    small_batches(docs.sparkSession)
    own = ("n_lines", "n_exact", "n_near")
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    rows = rows.withColumn("_th", F.xxhash64("_text"))
    lines = stored(line_rows(rows, fuzzy), "lines")
    # nulls come first in the order of structs
    places = lines.withColumn("pos", F.struct(F.col("_id"), F.col("_th"), F.col("line")))
    firsts = stored(places.groupBy("h").agg(F.min("pos").alias("pos"), F.count("*").alias("n")), "line-firsts")
    near = near_links(rows, lines, firsts, fuzzy)
    judged = firsts.join(near, "h", "left").filter("n > 1 or near is not null")
    judged = judged.select("h", F.col("pos").alias("first"), "near", "n")
    # the places of hot lines stay where they are
    hot = F.broadcast(judged.filter(F.col("n") * HOT >= lines.count()).drop("n"))
    others = judged.filter(F.col("n") * HOT < lines.count()).drop("n")
    places = places.select("h", "pos")
    rest = places.join(hot.select("h"), "h", "left_anti").join(others, "h")
    gone = rest.unionByName(places.join(hot, "h")).filter("pos > first or pos > near")
    gone = gone.select(
        F.col("pos._id").alias("_gid"), F.col("pos._th").alias("_gth"), "pos.line", (F.col("pos") > F.col("first")).alias("exact")
    ).distinct()
    gone = gone.groupBy("_gid", "_gth").agg(
        F.collect_list("line").alias("_lines"), F.count_if("exact").alias("_exact"), F.count("*").alias("_all")
    )
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text_col])
    carried = docs.select(row.alias("_row"), docs[id_col].alias("_id"), whole_text(text_col).alias("_text"))
    carried = carried.withColumn("_th", F.xxhash64("_text"))
    both = carried.join(gone, carried["_id"].eqNullSafe(gone["_gid"]) & (carried["_th"] == gone["_gth"]), "left")
    # texts that lose nothing don't go to Python
    left = F.arrow_udf(without_lines, "string")(F.when(F.col("_lines").isNotNull(), F.col("_text")), F.col("_lines"))
    both = both.withColumn("_left", F.coalesce(left, F.col("_text")))
    if drop_emptied:
        both = both.filter(F.col("_lines").isNull() | F.col("_left").rlike(r"\S"))
    extra = [
        F.size(F.split("_text", "\n")).cast("long").alias("n_lines"),
        F.coalesce("_exact", F.lit(0)).cast("long").alias("n_exact"),
        (F.coalesce("_all", F.lit(0)) - F.coalesce("_exact", F.lit(0))).cast("long").alias("n_near"),
    ]
    names = [c for c in docs.columns if not (counts and c in own)]
    kept = [F.col("_left").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in names]
    return both.select(*kept, *(extra if counts else []))
