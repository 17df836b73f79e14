"""Media columns: TIFF files written to and read from binary columns.

Reading walks the chain of image directories, decodes each strip or tile (none, PackBits, LZW or deflate), undoes
the predictor (none or horizontal differencing) and yields one page per directory. Both byte orders are read;
samples have 8 or 16 bits, interleaved. Writing makes 8-bit pages in strips or tiles.

Null media have no pages. Something that isn't a readable TIFF yields one row with an ``error`` and no page;
a chain of directories that runs in a circle, and data that ends early, count as such. Repeated rows, long files
and empty tables need no care: each row is read by itself. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeweft.llm.common import BATCH_BYTES, gathered, small_batches, whole_text

# fixed values of the format: tags, compressions, predictors, sizes of the field types
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD = {1: "B", 3: "H", 4: "I"}
CLEAR, END = 256, 257

ROW = 64
UNIT = 576
PAGE_ROWS = 4608
STRIP_ROWS = 512


class TiffError(ValueError):
    pass


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    pixels: np.ndarray


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    fresh = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, last = list(fresh), 9, b""
    out, held, bits = bytearray(), 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == CLEAR:
            table, width, last = list(fresh), 9, b""
            continue
        if code == END or len(out) >= size:
            break
        if last:
            if code > len(table):
                raise TiffError("an LZW code points beyond its table")
            table.append(last + (table[code] if code < len(table) else last)[:1])
        elif code >= len(table):
            raise TiffError("an LZW code points beyond its table")
        last = table[code]
        out += last
        # codes widen one entry early in this format
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out[:size])


def pack_lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    fresh = {bytes((i,)): i for i in range(256)}
    table, width, nxt = dict(fresh), 9, 258

    def put(code):
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    put(CLEAR)
    prefix = b""
    for byte in data:
        longer = prefix + bytes((byte,))
        if longer in table:
            prefix = longer
            continue
        put(table[prefix])
        table[longer] = nxt
        nxt += 1
        if nxt == 4094:
            put(CLEAR)
            table, width, nxt = dict(fresh), 9, 258
        elif nxt >= 1 << width:
            width += 1
        prefix = longer[-1:]
    if prefix:
        put(table[prefix])
        if nxt + 1 >= 1 << width and width < 12:
            width += 1
    put(END)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        found = data[:size]
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            found = zlib.decompressobj().decompress(data, size)  # no more than fits, whatever the file holds
        except zlib.error as e:
            raise TiffError(str(e)) from None
    elif compression == LZW:
        found = unpack_lzw(data, size)
    elif compression == PACKBITS:
        found = unpack_bits(data, size)
    else:
        raise TiffError(f"compression {compression} is not read")
    if len(found) != size:
        raise TiffError("a strip or tile ends early")
    return found


PACK = {NONE: bytes, DEFLATE: lambda x: zlib.compress(x, 6), LZW: pack_lzw, PACKBITS: pack_bits}


def directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    """The fields of the image directory at ``at``, and where the next one is."""
    try:
        (n,) = struct.unpack_from(f"{order}H", data, at)
        fields = {}
        for k in range(n):
            entry = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, entry)
            if kind in FIELD:
                form = f"{order}{count}{FIELD[kind]}"
                inside = struct.calcsize(form) <= 4
                where = entry + 8 if inside else struct.unpack_from(f"{order}I", data, entry + 8)[0]
                fields[tag] = struct.unpack_from(form, data, where)
        (following,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)
    except (struct.error, MemoryError, OverflowError):
        raise TiffError("an image directory ends early") from None
    return fields, following


def read_page(data: bytes, fields: dict[int, tuple[int, ...]], order: str, number: int) -> Page:
    def one(tag: int, default: int | None = None) -> int:
        if tag in fields and fields[tag]:
            return fields[tag][0]
        if default is None:
            raise TiffError(f"tag {tag} is missing")
        return default

    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, compression, predictor = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if bits not in (8, 16) or (samples > 1 and one(PLANAR, 1) != 1) or predictor not in (1, 2):
        raise TiffError("only interleaved samples of 8 or 16 bits, plain or differenced, are read")
    kind = np.dtype("u1") if bits == 8 else np.dtype(f"{order}u2")
    tiled = TILE_OFFSETS in fields
    if tiled:
        bw, bh, offsets, counts = one(TILE_WIDTH), one(TILE_HEIGHT), fields[TILE_OFFSETS], fields.get(TILE_COUNTS, ())
    else:
        bw, bh = width, min(one(ROWS_PER_STRIP, height), height)
        offsets, counts = fields.get(STRIP_OFFSETS, ()), fields.get(STRIP_COUNTS, ())
    if not (width and height and samples and bw and bh):
        raise TiffError("an image without extent")
    across, down = -(-width // bw), -(-height // bh)
    if len(offsets) < across * down or len(counts) < across * down:
        raise TiffError("strips or tiles are missing")
    if width * height * samples * kind.itemsize > 1 << 31:
        raise TiffError("an image beyond 2 GB is not read")
    pixels = np.empty((height, width, samples), dtype=kind)
    for k in range(across * down):
        top, left = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, height - top)
        part = data[offsets[k] : offsets[k] + counts[k]]
        block = np.frombuffer(unpack(part, compression, rows * bw * samples * kind.itemsize), dtype=kind)
        block = block.reshape(rows, bw, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        pixels[top : top + rows, left : left + bw] = block[: height - top, : width - left]
    return Page(number, width, height, samples, pixels.astype(pixels.dtype.newbyteorder("<"), copy=False))


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF file, one per image directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise TiffError("not a TIFF file")
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise TiffError("the image directories run in a circle")
        seen.add(at)
        fields, following = directory(data, at, order)
        yield read_page(data, fields, order, len(seen) - 1)
        at = following


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows: int = STRIP_ROWS, tile: int = 0):
    """A little-endian TIFF of 8-bit (height, width, samples) images, in strips or in square tiles."""
    out, link = bytearray(struct.pack("<2sHI", b"II", 42, 0)), 4
    for image in images:
        height, width, samples = image.shape
        if tile:
            padded = np.pad(image, ((0, -height % tile), (0, -width % tile), (0, 0)))
            spots = [(y, x) for y in range(0, height, tile) for x in range(0, width, tile)]
            blocks = [padded[y : y + tile, x : x + tile] for y, x in spots]
        else:
            blocks = [image[y : y + rows] for y in range(0, height, rows)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
            packed = PACK[compression](block.tobytes())
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed
        fields = {
            WIDTH: [width], HEIGHT: [height], BITS: [8] * samples, COMPRESSION: [compression],
            PHOTOMETRIC: [2 if samples == 3 else 1], SAMPLES: [samples], PLANAR: [1], PREDICTOR: [predictor],
        }
        if tile:
            fields |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile], TILE_OFFSETS: offsets, TILE_COUNTS: counts}
        else:
            fields |= {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [rows], STRIP_COUNTS: counts}
        entries = b""
        for tag, values in sorted(fields.items()):
            kind = 3 if tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR) else 4
            packed = struct.pack(f"<{len(values)}{FIELD[kind]}", *values)
            if len(packed) > 4:
                where = len(out) + len(out) % 2
                out += b"\0" * (where - len(out)) + packed
                packed = struct.pack("<I", where)
            entries += struct.pack("<HHI4s", tag, kind, len(values), packed)
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def payload_of(text: str) -> bytes:
    """The text's bytes, with bytes 255 up to a positive multiple of UNIT."""
    raw = text.encode()
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def media_of(payload: bytes, compression: int = DEFLATE, predictor: int = 2) -> bytes:
    """A gray TIFF ROW samples wide that holds the payload, in pages of PAGE_ROWS rows."""
    samples = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW, 1)
    return write([samples[i : i + PAGE_ROWS] for i in range(0, len(samples), PAGE_ROWS)], compression, predictor)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as a TIFF. A null text is an empty one."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    schema = T.StructType(
        [rows.schema["_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["_text"].to_pylist()
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            media = pa.array([media_of(payload_of(t)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["_id"], sizes, media], schema.names)

    return rows.mapInArrow(work, schema).withColumnRenamed("_id", id_col)


PAGE_FIELDS = "page int, width int, height int, samples int, bits int, pixels binary, error string"
FILE_FIELDS = "left int, media_bytes long, media_sha256 string"


def page_rows(media: DataFrame, media_col: str, carried: list[str]) -> DataFrame:
    """(*carried, *PAGE_FIELDS, *FILE_FIELDS): one row per page, in order, and one without a page for a null or a
    broken file, whose error is null or says what is wrong. ``left`` counts the rows of the file that follow."""
    small_batches(media.sparkSession)
    rows = media.select(*carried, F.col(media_col).cast("binary").alias("_media"))
    fields = [*T._parse_datatype_string(PAGE_FIELDS), *T._parse_datatype_string(FILE_FIELDS)]
    schema = T.StructType([*rows.schema.fields[:-1], *fields])
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    kinds = [kinds[f.dataType.simpleString()] for f in fields]

    def page_row(page: Page) -> tuple:
        return page.number, page.width, page.height, page.samples, page.pixels.itemsize * 8, page.pixels.tobytes(), None

    def rows_of(data: bytes | None) -> list[tuple]:
        if data is None:
            return [(*[None] * 7, 0, None, None)]
        try:
            found = [page_row(p) for p in pages(data)] or [(*[None] * 6, "no image directory")]
        except TiffError as e:
            found = [(*[None] * 6, str(e))]
        file = len(data), hashlib.sha256(data).hexdigest()
        return [(*row, len(found) - 1 - i, *file) for i, row in enumerate(found)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                found = rows_of(data)
                take = pa.array([i] * len(found), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns[:-1]), *columns], schema.names)

    return rows.mapInArrow(lambda batches: gathered(work(batches), BATCH_BYTES), schema)


def tiff_pages(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, page, width, height, samples, bits, pixels, error): one row per page of each file."""
    rows = page_rows(media.select(F.col(id_col).alias("_id"), F.col(media_col).alias("_file")), "_file", ["_id"])
    names = [f.name for f in T._parse_datatype_string(PAGE_FIELDS)]
    return rows.filter("page is not null or error is not null").select(F.col("_id").alias(id_col), *names)


class Digest:
    """Of the pages of one file, as they come: sums by row and eighth, and hashes of the samples."""

    def __init__(self):
        self.size, self.hash, self.tail, self.across, self.pages = 0, hashlib.sha256(), b"", [], 0

    def add(self, pixels: bytes, width: int, samples: int, bits: int) -> None:
        self.size += len(pixels)
        self.hash.update(pixels)
        self.tail = (self.tail + pixels[-32:])[-32:]
        rows = np.frombuffer(pixels, dtype="u1" if bits == 8 else "<u2").reshape(-1, width, samples)[:, :, 0]
        eighths = np.add.reduceat(rows.astype(np.int64), np.arange(8) * width // 8, axis=1) if width >= 8 else np.zeros((len(rows), 8), np.int64)
        self.across.append(eighths)
        self.pages += 1
        self.width = width

    def feature(self) -> str:
        """Pages, mean sample, and which cells of an 8 by 8 grid over all rows are brighter than that (16 hex digits)."""
        across = np.concatenate(self.across)
        edges = np.arange(9) * len(across) // 8
        sums = np.concatenate([np.zeros((1, 8), dtype=np.int64), np.cumsum(across, axis=0)])
        cells = np.diff(sums[edges], axis=0)
        wide = np.diff(np.arange(9) * self.width // 8)
        total, size = int(across.sum()), len(across) * self.width
        bright = (cells * size > total * np.diff(edges)[:, None] * wide[None]).ravel()
        return f"p{self.pages}_m{total / size:.3f}_g{int.from_bytes(np.packbits(bright).tobytes(), 'big'):016x}"

    def row(self) -> tuple:
        return self.size, self.hash.hexdigest(), zlib.crc32(self.tail), self.feature()


def media_digest(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", size_col: str = "n_bytes") -> DataFrame:
    """What each file holds, from its pages: size and checksums of the samples and of the file, and a feature.

    The columns are null for a null file, and those of the samples for a broken one.
    """
    known = media.select(F.col(id_col).alias("_id"), F.col(size_col).alias("_size"), F.col(media_col).alias("_file"))
    rows = page_rows(known, "_file", ["_id", "_size"])
    more = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema = T.StructType([*rows.schema.fields[:2], *T._parse_datatype_string(more)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Digest()  # a file's rows follow each other, and may go on in the next batch
        for batch in batches:
            ends, out = [], []
            columns = [batch[c].to_pylist() for c in ("error", "pixels", "width", "samples", "bits", "left", "media_bytes", "media_sha256")]
            for i, (error, pixels, width, samples, bits, left, size, of_file) in enumerate(zip(*columns, strict=True)):
                if pixels is not None and error is None:
                    held.add(pixels, width, samples, bits)
                if not left:
                    payload, sha, crc, feature = held.row() if held.pages else [None] * 4
                    out.append((payload, sha, crc, size, of_file, feature))
                    ends.append(i)
                    held = Digest()
            if out:
                take = pa.array(ends, pa.int64())
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["_id"].take(take), batch["_size"].take(take), *arrays], schema.names)

    return rows.mapInArrow(work, schema).withColumnsRenamed({"_id": id_col, "_size": size_col})
