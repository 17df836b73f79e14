"""Posterior draws as NetCDF classic files, as a Spark data source named ``netcdf_draws``.

Rows are (var, chain, draw, node, k, value); variables without nodes or components have nulls there. A file holds one chain, a
record a draw, in the 64-bit offset form of the classic format, so that any NetCDF library reads it. Node labels are a character variable,
and the chain's number is an attribute. Files of others are read as well: a variable counts if its dimensions are, in
this order, any of chain, draw (that one always), nodes and components; labels are looked for in the variable ``node``.

* Writing: ``write_draws`` deals the draws of all chains to tasks, which write them as records, one draw at a time, to a file of the
  task. Then a task a chain puts the bytes of its records together. To the data source itself rows come a chain a task, in order of
  draws. Every draw of a chain has the same cells. What a task writes has a name of its own until the job commits, so that lost or
  repeated tasks leave nothing behind.
* Reading: a partition a chain and variable, or several if that is long, of which blocks of draws are read. Equality and IN filters on
  ``var`` and ``chain`` skip partitions if ``spark.sql.python.filterPushdown.enabled`` is set; the options ``var`` and ``chain`` always do.

Paths are those that pyarrow's file systems know (file, hdfs, s3, gs).
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from posixpath import basename, dirname, join

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)

from treeweft.plans.lineage import settled

SCHEMA = "var string, chain int, draw int, node string, k int, value double"
FORMAT = "netcdf_draws"
# a draw that is written: where its bytes lie, those of the labels (of a chain's first draw alone), and which cells it has
RECORDS = """chain int, draw int, file string, place long, size long, labels long, wide int, nodes int, components int,
variables string, cells string, error string"""
# fixed values of the format: tags of its lists, and its types by number
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
CHAR, INT, DOUBLE = 2, 4, 6
MAGIC = b"CDF"
BLOCK = 8 << 20
HEAD = 64 << 10
#: Bytes of a variable that a partition reads, rows that a task writes, and nodes that all tasks may have a table of.
PART_BYTES, PART_ROWS, MOST_NODES = 16 << 20, 2 << 20, 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


# ---- the format


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 4)


def name_bytes(name: str) -> bytes:
    data = name.encode()
    return struct.pack(">i", len(data)) + padded(data)


def listed(tag: int, items: list[bytes]) -> bytes:
    return struct.pack(">ii", tag if items else 0, len(items)) + b"".join(items)


@dataclass
class Variable:
    name: str
    dims: list[int]
    kind: int
    begin: int = 0


@dataclass
class Header:
    """Dimensions (name, length; 0 for that of the records), variables, whole-number attributes and the number of records."""

    dims: list[tuple[str, int]]
    variables: list[Variable]
    attributes: dict[str, int] = field(default_factory=dict)
    records: int = 0

    def shape(self, v: Variable) -> tuple[int, ...]:
        return tuple(self.dims[d][1] for d in v.dims)

    def is_record(self, v: Variable) -> bool:
        return bool(v.dims) and self.dims[v.dims[0]][1] == 0

    def slab(self, v: Variable) -> int:
        """Bytes of a variable, or of one record of it, without padding."""
        shape = self.shape(v)[1:] if self.is_record(v) else self.shape(v)
        return int(np.prod(shape, dtype=np.int64)) * np.dtype(TYPES[v.kind]).itemsize

    def step(self) -> int:
        """Bytes from one record to the next: slabs are padded unless there is but one."""
        own = [self.slab(v) for v in self.variables if self.is_record(v)]
        return own[0] if len(own) == 1 else sum(n + -n % 4 for n in own)

    def encode(self) -> bytes:
        """The header's bytes; sets where each variable begins: fixed ones first, then those of the first record."""

        def made() -> bytes:
            dims = [name_bytes(n) + struct.pack(">i", size) for n, size in self.dims]
            attributes = [name_bytes(n) + struct.pack(">iii", INT, 1, x) for n, x in self.attributes.items()]
            variables = []
            for v in self.variables:
                size = self.slab(v)
                data = name_bytes(v.name) + struct.pack(f">i{len(v.dims)}i", len(v.dims), *v.dims) + listed(ATTRIBUTES, [])
                variables.append(data + struct.pack(">iIq", v.kind, min(size + -size % 4, 0xFFFFFFFF), v.begin))
            return MAGIC + b"\x02" + struct.pack(">i", self.records) + listed(DIMENSIONS, dims) + listed(ATTRIBUTES, attributes) + listed(VARIABLES, variables)

        at = len(made())
        for record in (False, True):
            for v in self.variables:
                if self.is_record(v) == record:
                    v.begin = at
                    size = self.slab(v)
                    at += size + -size % 4
        return made()


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        found = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return found if len(found) > 1 else found[0]

    def name(self) -> str:
        n = self.take(">i")
        text = self.data[self.at : self.at + n]
        if len(text) < n:
            raise struct.error("more is needed")
        self.at += n + -n % 4
        return text.decode()

    def items(self) -> range:
        _, n = self.take(">ii")
        return range(n)

    def attributes(self) -> dict[str, int]:
        out = {}
        for _ in self.items():
            name = self.name()
            kind, n = self.take(">ii")
            size = n * np.dtype(TYPES[kind]).itemsize
            if kind in (1, 3, 4) and n == 1:
                out[name] = int(np.frombuffer(self.data, TYPES[kind], 1, self.at)[0])
            self.at += size + -size % 4
        return out


def decode(data: bytes) -> Header:
    """The header at the beginning of ``data``; struct.error if it goes on beyond that."""
    if data[:3] != MAGIC or data[3:4] not in (b"\x01", b"\x02"):
        raise ValueError("not a NetCDF classic file")
    c = Cursor(data)
    c.at = 4
    records = c.take(">i")
    dims = [(c.name(), c.take(">i")) for _ in c.items()]
    attributes, variables = c.attributes(), []
    for _ in c.items():
        name, n = c.name(), c.take(">i")
        ids = list(struct.unpack_from(f">{n}i", data, c.at))
        c.at += 4 * n
        c.attributes()
        kind, _ = c.take(">iI")
        variables.append(Variable(name, ids, kind, c.take(">q" if data[3] == 2 else ">i")))
    return Header(dims, variables, attributes, records)


def read_header(file, size: int) -> Header:
    """By a beginning of the file that is doubled until it holds the header."""
    n = HEAD
    while True:
        file.seek(0)
        try:
            head = decode(file.read(min(n, size)))
            break
        except (struct.error, ValueError, IndexError):
            if n >= size:
                raise
            n *= 2
    if head.records < 0:  # written as a stream: as many as there are
        first = min((v.begin for v in head.variables if head.is_record(v)), default=size)
        head.records = (size - first) // max(head.step(), 1)
    return head


# ---- reading


@dataclass
class Part(InputPartition):
    path: str
    var: str
    chain: int
    place: int | None  # of the chain along the variable's own dimension of chains
    first: int = 0  # of the draws
    stop: int | None = None

    def __init__(self, path: str, var: str, chain: int, place: int | None, first: int = 0, stop: int | None = None):
        super().__init__((path, var, chain, place, first, stop))
        self.path, self.var, self.chain, self.place, self.first, self.stop = path, var, chain, place, first, stop


def draw_variables(head: Header) -> Iterator[tuple[Variable, list[str]]]:
    for v in head.variables:
        names = [head.dims[d][0] for d in v.dims]
        rest = names[1:] if names[:1] == ["chain"] else names
        if v.kind != CHAR and rest[:1] == ["draw"] and len(rest) <= 3:
            yield v, names


def extent(head: Header, v: Variable, names: list[str]) -> tuple[int, int]:
    """Draws of a variable, and the bytes of one."""
    inner = [head.dims[d][1] for d, n in zip(v.dims, names, strict=True) if n not in ("chain", "draw")]
    draws = head.records if head.is_record(v) else head.dims[v.dims[names.index("draw")]][1]
    return draws, int(np.prod(inner, dtype=np.int64)) * np.dtype(TYPES[v.kind]).itemsize


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.wanted: dict[str, set] = {}
        if "var" in options:
            self.wanted["var"] = set(options["var"].split(","))
        if "chain" in options:
            self.wanted["chain"] = {int(x) for x in options["chain"].split(",")}

    def keep(self, column: str, values: set) -> None:
        self.wanted[column] = self.wanted.get(column, values) & values

    def partitions(self) -> list[Part]:
        where, path = opened(self.path)
        info = where.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(path))
        out = []
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.base_name.endswith(".nc")), key=lambda f: f.path):
            with where.open_input_file(f.path) as file:
                head = read_header(file, f.size)
            for v, names in draw_variables(head):
                chains = range(head.shape(v)[0]) if names[0] == "chain" else [None]
                for place in chains:
                    chain = head.attributes.get("chain", 0) if place is None else place
                    if v.name in self.wanted.get("var", {v.name}) and chain in self.wanted.get("chain", {chain}):
                        draws, size = extent(head, v, names)
                        each = max(1, PART_BYTES // max(size, 1))
                        out += [Part(f.path, v.name, chain, place, a, min(a + each, draws)) for a in range(0, max(draws, 1), each)]
        return out or [Part("", "", 0, None)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        where, _ = opened(self.path)
        with where.open_input_file(part.path) as file:
            head = read_header(file, file.size())
            v, names = next(x for x in draw_variables(head) if x[0].name == part.var)
            inner = [head.dims[d][1] for d, n in zip(v.dims, names, strict=True) if n not in ("chain", "draw")]
            kind = np.dtype(TYPES[v.kind])
            draws, size = extent(head, v, names)
            width = size // kind.itemsize
            labels = self.labels(file, head)
            named = [labels[i] if i < len(labels) else str(i) for i in range(inner[0])] if inner else [None]
            ks = list(range(inner[1])) if len(inner) > 1 else [None]
            nodes = pa.array(named, pa.string()).take(pa.array(np.repeat(np.arange(len(named)), len(ks))))
            components = pa.array(ks * len(named), pa.int32())
            step, at = (head.step(), v.begin) if head.is_record(v) else (size, v.begin + (part.place or 0) * draws * size)
            block = max(1, BLOCK // max(step, 1))
            stop = draws if part.stop is None else min(part.stop, draws)
            for first in range(part.first, stop, block):
                n = min(block, stop - first)
                file.seek(at + first * step)
                data = file.read((n - 1) * step + size)
                x = np.concatenate([np.frombuffer(data, kind, width, i * step) for i in range(n)]).astype(np.float64)
                each = np.arange(first, first + n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(part.var, len(x)), pa.array(np.full(len(x), part.chain, np.int32)), pa.array(np.repeat(each, width)), pa.concat_arrays([nodes] * n), pa.concat_arrays([components] * n), pa.array(x)],
                    names=["var", "chain", "draw", "node", "k", "value"],
                )

    @staticmethod
    def labels(file, head: Header) -> list[str]:
        for v in head.variables:
            if v.name == "node" and v.kind == CHAR and len(v.dims) == 2:
                file.seek(v.begin)
                rows, wide = head.shape(v)
                data = file.read(rows * wide)
                return [data[i * wide : (i + 1) * wide].rstrip(b"\0").decode() for i in range(rows)]
        return []


class PushingReader(Reader):
    """Takes equality and IN on var and chain; Spark evaluates them once more, which costs little."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | EqualNullSafe | In) and f.attribute in (("var",), ("chain",)):
                self.keep(f.attribute[0], set(f.value) if isinstance(f, In) else {f.value})
            yield f


# ---- writing


def header(chain: int, records: int, nodes: int, wide: int, components: int, variables: dict[str, int]) -> Header:
    """Of a chain's file, whose variables have none, one or both of the dimensions of nodes and components."""
    dims = [("draw", 0), ("node", nodes), ("component", components), ("label", wide)]
    dims = [d for d in dims if d[1] or d[0] == "draw" or d[0] == "label"]
    at = {n: i for i, (n, _) in enumerate(dims)}
    made = [Variable("node", [at["node"], at["label"]], CHAR)] if nodes else []
    made += [Variable(v, [at[n] for n in ("draw", "node", "component")[: 1 + inner]], DOUBLE) for v, inner in variables.items()]
    return Header(dims, made, {"chain": int(chain)}, records)


def final_name(made: str, chain: int) -> str:
    return join(dirname(made), f"chain-{chain:05d}.nc")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator) -> Written:
        where, path = opened(self.path)
        where.create_dir(path, recursive=True)
        done, chain, rows = [], None, []
        for row in iterator:
            if rows and (row["chain"], row["draw"]) != (rows[0]["chain"], rows[0]["draw"]):
                chain = self.add(where, path, chain, rows)
                if row["chain"] != rows[0]["chain"]:
                    done.append(self.close(where, chain))
                    chain = None
                rows = []
            rows.append(row)
        if rows:
            done.append(self.close(where, self.add(where, path, chain, rows)))
        return Written(done)

    def add(self, where, path: str, chain: dict | None, rows: list) -> dict:
        """One draw to the end of its chain's records."""
        cells: dict[str, dict] = {}
        for r in rows:
            if (r["node"], r["k"]) in cells.setdefault(r["var"], {}):
                raise ValueError(f"chain {r['chain']} is in more than one task or has a cell twice")
            cells[r["var"]][r["node"], r["k"]] = r["value"]
        if chain is None:
            chain = self.start(where, path, rows[0]["chain"], cells)
        if {v: set(c) for v, c in cells.items()} != chain["cells"]:
            raise ValueError("all draws of a chain have the same cells")
        for var, shape in chain["shapes"].items():
            values = [cells[var][n, k] for n in (chain["nodes"] if shape else [None]) for k in (chain["ks"] if len(shape) > 1 else [None])]
            chain["file"].write(np.array([np.nan if x is None else x for x in values], ">f8").tobytes())
        chain["records"] += 1
        return chain

    def start(self, where, path: str, number: int, cells: dict[str, dict]) -> dict:
        every = [key for c in cells.values() for key in c]
        nodes, ks = sorted({n for n, _ in every if n is not None}), sorted({k for _, k in every if k is not None})
        shapes = {}
        for var, held in sorted(cells.items()):
            shapes[var] = () if set(held) == {(None, None)} else (len(nodes), len(ks)) if None not in {k for _, k in held} else (len(nodes),)
            if len(held) != int(np.prod(shapes[var], dtype=np.int64)) or ks != list(range(len(ks))):
                raise ValueError(f"the cells of {var} are no full table of nodes and components from 0")
        attempt = join(path, f"_{uuid.uuid4().hex}")
        return {
            "number": number, "nodes": nodes, "ks": ks, "shapes": shapes, "cells": {v: set(c) for v, c in cells.items()},
            "records": 0, "path": attempt, "file": where.open_output_stream(f"{attempt}.records"),
        }

    def close(self, where, chain: dict) -> tuple[str, str]:
        """Header and labels, which need the number of records, and then the records, block by block."""
        chain["file"].close()
        labels = [n.encode() for n in chain["nodes"]]
        wide = max(map(len, labels), default=1)
        head = header(chain["number"], chain["records"], len(labels), wide, len(chain["ks"]), {v: len(s) for v, s in chain["shapes"].items()})
        with where.open_output_stream(f"{chain['path']}.made") as out:
            out.write(head.encode())
            if labels:
                out.write(padded(b"".join(n.ljust(wide, b"\0") for n in labels)))
            with where.open_input_stream(f"{chain['path']}.records") as records:
                while block := records.read(BLOCK):
                    out.write(block)
        where.delete_file(f"{chain['path']}.records")
        return f"{chain['path']}.made", final_name(chain["path"], chain["number"])

    def commit(self, messages) -> None:
        where, path = opened(self.path)
        made = [f for m in messages if m is not None for f in m.files]
        if len({final for _, final in made}) < len(made):
            self.drop(where, path)
            raise ValueError("a chain was written by more than one task")
        where.create_dir(path, recursive=True)
        if self.overwrite:
            for f in where.get_file_info(fs.FileSelector(path)):
                if f.type == fs.FileType.File and f.base_name.endswith(".nc"):
                    where.delete_file(f.path)
        for name, final in made:
            where.move(name, final)
        self.drop(where, path)

    def abort(self, messages) -> None:
        self.drop(*opened(self.path))

    @staticmethod
    def drop(where, path: str) -> None:
        """What lost tasks left."""
        for f in where.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if f.type == fs.FileType.File and basename(f.path).startswith("_") and f.path.endswith((".made", ".records")):
                where.delete_file(f.path)


class Joiner(Writer):
    """Takes what record_files() gives, a chain a task, in order of draws: the bytes are copied as they are."""

    def write(self, iterator: Iterator) -> Written:
        where, path = opened(self.path)
        where.create_dir(path, recursive=True)
        return Written([self.joined(where, path, list(draws)) for _, draws in groupby(iterator, key=lambda r: r["chain"])])

    def joined(self, where, path: str, draws: list) -> tuple[str, str]:
        first = draws[0]
        for d in draws:
            if d["error"]:
                raise ValueError(d["error"])
            if d["cells"] != first["cells"]:
                raise ValueError("all draws of a chain have the same cells")
        dims = dict(json.loads(first["variables"]))
        head = header(first["chain"], len(draws), first["nodes"], first["wide"], first["components"], dims)
        made = join(path, f"_{uuid.uuid4().hex}.made")
        with contextlib.ExitStack() as stack, where.open_output_stream(made) as out:
            files: dict[str, pa.NativeFile] = {}

            def copy(file: str, at: int, size: int) -> None:
                if file not in files:
                    files[file] = stack.enter_context(where.open_input_file(file))
                files[file].seek(at)
                while size:
                    block = files[file].read(min(BLOCK, size))
                    if not block:
                        raise OSError(f"{file} ends early")
                    out.write(block)
                    size -= len(block)

            out.write(head.encode())
            if first["nodes"]:
                labels = first["nodes"] * first["wide"]
                copy(first["file"], first["labels"], labels)
                out.write(bytes(-labels % 4))
            for d in draws:
                copy(d["file"], d["place"], d["size"])
        return made, final_name(made, first["chain"])


class NetcdfDraws(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("push") == "true" else Reader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return (Joiner if "cells" in schema.names else Writer)(dict(self.options), overwrite)


def record(names: list[str], v: np.ndarray, node: np.ndarray, k: np.ndarray, value: np.ndarray):
    """(variables with their numbers of inner dimensions, numbers of the nodes, number of components, bytes) of one draw.

    Cells come in any order. -1 stands for no node or component.
    """
    nodes, ks = np.unique(node[node >= 0]), np.unique(k[k != -1])
    at = np.searchsorted(nodes, node)
    variables, data = [], []
    for i in np.flatnonzero(np.bincount(v)).tolist():
        own = v == i
        none, flat = node[own] < 0, k[own] == -1
        dims = 0 if none.all() and flat.all() else 1 if flat.any() else 2
        shape = (len(nodes), len(ks))[:dims]
        size = int(np.prod(shape, dtype=np.int64))
        full = len(none) == size and np.array_equal(ks, np.arange(len(ks))) and not (dims and none.any()) and not (dims == 1 and not flat.all())
        if full:
            to = (0, at[own], at[own] * len(ks) + k[own])[dims]
            seen = np.zeros(size, dtype=bool)
            seen[to] = True
            full = bool(seen.all())
        if not full:
            raise ValueError(f"the cells of {names[i]} are no full table of nodes and components from 0, each of them once")
        out = np.empty(size, ">f8")
        out[to] = value[own]
        variables.append((names[i], dims))
        data.append(out.tobytes())
    return variables, nodes, len(ks), b"".join(data)


def record_files(rows: DataFrame, path: str, names: list[str]) -> DataFrame:
    """RECORDS of (at, v, node, k, value, label): rows with one ``at``, which tells chain and draw, lie next to each other.

    ``v`` is the place in ``names``, ``node`` a number that is ordered as the labels are; these come with a chain's first draw.
    """
    schema = T._parse_datatype_string(RECORDS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = opened(path)
        made, wait, out = [], [], None
        target, place = join(folder, f"_{uuid.uuid4().hex}.records"), 0

        def done() -> None:
            nonlocal wait, out, place
            table = pa.Table.from_batches(wait)
            wait = []
            at = table["at"][0].as_py() + (1 << 31)
            row = {"chain": at >> 32, "draw": (at & 0xFFFFFFFF) - (1 << 31), "file": target}
            made.append(row)
            v, node, k, value = (table[c].to_numpy() for c in ("v", "node", "k", "value"))
            try:
                variables, nodes, components, data = record(names, v, node, k, value)
            except ValueError as e:  # for the chain's task, so that nothing is written when the job ends
                row["error"] = str(e)
                return
            if out is None:
                where.create_dir(folder, recursive=True)
                out = where.open_output_stream(target)
            row |= {"place": place, "size": len(data), "nodes": len(nodes), "components": components, "variables": json.dumps(variables)}
            row["cells"] = hashlib.sha256(f"{row['variables']} {components} ".encode() + nodes.tobytes()).hexdigest()
            out.write(data)
            place += len(data)
            labels = table["label"].combine_chunks()
            if len(labels) - labels.null_count or not len(nodes):
                first = np.unique(node, return_index=True)[1][-len(nodes) :] if len(nodes) else []
                found = [x.encode() for x in labels.take(pa.array(first, pa.int64())).to_pylist()]
                row |= {"labels": place, "wide": max(map(len, found), default=1)}
                data = b"".join(x.ljust(row["wide"], b"\0") for x in found)
                out.write(data)
                place += len(data)

        for batch in batches:
            if not len(batch):
                continue
            at = batch["at"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(batch)]
            for a, b in zip(edges, edges[1:], strict=False):
                if wait and wait[-1]["at"][0].as_py() != at[a]:
                    done()
                wait.append(batch.slice(a, b - a))
        if wait:
            done()
        if out is not None:
            out.close()
        if made:
            yield pa.RecordBatch.from_pydict({f.name: pa.array([r.get(f.name) for r in made], KINDS[f.dataType.typeName()]) for f in schema})

    return rows.mapInArrow(work, schema)


KINDS = {"integer": pa.int32(), "long": pa.int64(), "string": pa.string()}


def write_draws(draws: DataFrame, path: str) -> None:
    """(var, chain, draw, node, k, value) as a file a chain."""
    spark = draws.sparkSession
    spark.dataSource.register(NetcdfDraws)
    rows = draws.selectExpr("cast(var AS string) AS var", "cast(chain AS int) AS chain", "cast(draw AS int) AS draw", "cast(node AS string) AS node", "cast(k AS int) AS k", "cast(value AS double) AS value")
    # without the values: which variables, chains and nodes there are
    held = settled(rows.groupBy("chain", "var", "node").agg(F.min("draw").alias("draw"), F.count("draw").alias("n"), F.count("*").alias("rows")))
    chains = held.groupBy("chain").agg(F.min("draw").alias("_first"), F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    found = chains.collect()
    names = sorted(r["var"] or "" for r in held.select("var").distinct().collect())
    if "" in names or any(r["chain"] is None or r["n"] < r["rows"] for r in found):
        raise ValueError("a row without variable, chain or draw")
    nodes = held.select(F.col("node").alias("_node")).filter("_node IS NOT NULL").distinct().orderBy("_node")
    nodes = settled(nodes.withColumn("_number", F.monotonically_increasing_id()))
    if nodes.count() <= MOST_NODES:
        nodes = F.broadcast(nodes)
    both = rows.join(nodes, rows["node"] == nodes["_node"], "left").join(F.broadcast(chains.select(F.col("chain").alias("_chain"), "_first")), F.col("chain") == F.col("_chain"))
    k = F.when(F.col("k").isNull(), -1).when(F.col("k") < 0, -2).otherwise(F.col("k"))
    cells = both.select(
        (F.shiftleft(F.col("chain").cast("long"), 32) + F.col("draw")).alias("at"), (F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), F.col("var")) - 1).cast("int").alias("v"),
        F.coalesce("_number", F.lit(-1).cast("long")).alias("node"), k.cast("int").alias("k"), F.coalesce("value", F.lit(float("nan"))).alias("value"),
        F.when(F.col("draw") == F.col("_first"), F.col("node")).alias("label"),
    )
    parts = max(spark.sparkContext.defaultParallelism, -(-sum(r["rows"] for r in found) // PART_ROWS))
    made = record_files(cells.repartition(parts, "at").sortWithinPartitions("at"), path, names)
    try:
        made.repartition("chain").sortWithinPartitions("chain", "draw").write.format(FORMAT).mode("overwrite").save(path)
    except Exception:
        Writer.drop(*opened(path))
        raise


def read_draws(spark: SparkSession, path: str, var: str | None = None, chain: int | None = None) -> DataFrame:
    """The draws in a file or a folder of files, of one variable or chain on request."""
    spark.dataSource.register(NetcdfDraws)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    chosen = {n: str(x) for n, x in (("var", var), ("chain", chain)) if x is not None}
    return spark.read.format(FORMAT).options(push=push, **chosen).load(path)
