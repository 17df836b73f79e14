"""NetCDF classic draws: round trips, files made by hand, skipped partitions, and what isn't a table of draws."""

import struct
from pathlib import Path

import numpy as np
import pytest

from treeweft.sources import netcdf
from treeweft.sources.netcdf import Header, Part, PushingReader, Reader, Variable, Writer, decode


def rows_of(chains=3, draws=7, nodes=("a", "b é", "c"), ks=2):
    g = np.random.default_rng(0)
    out = [("sigma", c, d, None, None, float(g.random())) for c in range(chains) for d in range(draws)]
    out += [("depth", c, d, n, None, float(g.random())) for c in range(chains) for d in range(draws) for n in nodes]
    return out + [("e", c, d, n, k, float(g.random())) for c in range(chains) for d in range(draws) for n in nodes for k in range(ks)]


def test_round_trip(spark, tmp_path):
    rows = rows_of()
    frame = spark.createDataFrame(rows, netcdf.SCHEMA).repartition(5)
    for _ in range(2):  # the second overwrites the first
        netcdf.write_draws(frame, f"file://{tmp_path}/trace")
    assert sorted(p.name for p in Path(tmp_path, "trace").iterdir()) == [f"chain-{c:05d}.nc" for c in range(3)]
    found = netcdf.read_draws(spark, f"file://{tmp_path}/trace")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, rows))
    assert found.rdd.getNumPartitions() == 9
    one = netcdf.read_draws(spark, str(tmp_path / "trace"), var="sigma", chain=1)
    assert one.rdd.getNumPartitions() == 1 and sorted(map(tuple, one.collect())) == sorted(r for r in rows if r[0] == "sigma" and r[1] == 1)
    assert netcdf.read_draws(spark, str(tmp_path / "trace"), var="none").count() == 0


def test_filters_skip_partitions(spark, tmp_path):
    netcdf.write_draws(spark.createDataFrame(rows_of(), netcdf.SCHEMA), str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = netcdf.read_draws(spark, str(tmp_path / "t")).filter("var = 'e' and chain in (0, 2)")
        assert some.rdd.getNumPartitions() == 2 and some.count() == 2 * 7 * 6
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    reader = PushingReader({"path": str(tmp_path / "t")})
    assert {(p.var, p.chain) for p in reader.partitions()} == {(v, c) for v in ("sigma", "depth", "e") for c in range(3)}


def test_header_of_both_forms(tmp_path):
    head = Header([("draw", 0), ("node", 3)], [Variable("s", [0], 6), Variable("e", [0, 1], 5)], {"chain": 4}, 2)
    data = head.encode()
    again = decode(data)
    assert again == head and again.step() == 8 + 12 and again.variables[0].begin == len(data)
    with pytest.raises(struct.error):
        decode(data[:-3])
    with pytest.raises(ValueError):
        decode(b"HDF5....")
    # the form with 32-bit offsets, chains as a dimension, written here byte by byte
    def name(x):
        return struct.pack(">i", len(x)) + x + bytes(-len(x) % 4)

    body = struct.pack(">ii", 10, 2) + name(b"chain") + struct.pack(">i", 2) + name(b"draw") + struct.pack(">i", 3)
    body += struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 1) + name(b"x") + struct.pack(">iii", 2, 0, 1) + struct.pack(">ii", 0, 0)
    body = b"CDF\x01" + struct.pack(">i", 0) + body + struct.pack(">iI", 4, 24)
    values = np.arange(6, dtype=">i4")
    path = tmp_path / "odd.nc"
    path.write_bytes(body + struct.pack(">i", len(body) + 4) + values.tobytes())
    reader = Reader({"path": str(path)})
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["var"], r["chain"], r["draw"], r["node"], r["k"], r["value"]) for r in found] == [("x", i // 3, i % 3, None, None, float(i)) for i in range(6)]


def test_blocks_and_streams(tmp_path, monkeypatch):
    """Draws in several blocks, a header longer than what is read first, and a file that doesn't know how many records it has."""
    rows = [dict(zip(("var", "chain", "draw", "node", "k", "value"), r, strict=True)) for r in sorted(rows_of(1, 50, tuple(f"n{i}" for i in range(20))), key=lambda r: r[2])]
    writer = Writer({"path": str(tmp_path)}, True)
    writer.commit([writer.write(iter(rows)), None])
    monkeypatch.setattr(netcdf, "BLOCK", 1000)
    monkeypatch.setattr(netcdf, "HEAD", 16)
    path = tmp_path / "chain-00000.nc"
    data = path.read_bytes()
    path.write_bytes(data[:4] + b"\xff\xff\xff\xff" + data[8:])
    reader = Reader({"path": str(tmp_path)})
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(map(repr, found)) == sorted(map(repr, rows))
    assert list(reader.read(Part("", "", 0, None))) == []


@pytest.mark.parametrize("spoil", ["missing", "twice", "gap"])
def test_no_full_table(spark, tmp_path, spoil):
    rows = rows_of(1, 3)
    rows = {"missing": rows[:-1], "twice": [*rows, rows[-1]], "gap": [(*r[:4], 5 if r[4] == 1 else r[4], r[5]) for r in rows]}[spoil]
    with pytest.raises(Exception, match="cells|twice|full table"):
        netcdf.write_draws(spark.createDataFrame(rows, netcdf.SCHEMA), str(tmp_path / "bad"))
    assert not list(Path(tmp_path, "bad").glob("*"))


def test_chains_in_several_tasks(tmp_path):
    rows = [dict(zip(("var", "chain", "draw", "node", "k", "value"), r, strict=True)) for r in rows_of(1, 2)]
    writer = Writer({"path": str(tmp_path)}, True)
    by = [sorted((r for r in rows if r["draw"] == d), key=lambda r: r["var"]) for d in range(2)]
    with pytest.raises(ValueError, match="more than one task"):
        writer.commit([writer.write(iter(b)) for b in by])
    assert not list(tmp_path.glob("*"))


def test_a_chain_is_dealt_to_tasks(spark, tmp_path, monkeypatch):
    """The draws of one chain are made into records by several tasks and read by several; rows come in any order."""
    rows = rows_of(1, 40)
    rows[50] = (*rows[50][:5], None)
    made, whole = [], netcdf.record_files
    monkeypatch.setattr(netcdf, "record_files", lambda *a: made.append(whole(*a)) or made[-1])
    monkeypatch.setattr(netcdf, "PART_ROWS", 100)
    netcdf.write_draws(spark.createDataFrame(rows, netcdf.SCHEMA).repartition(3), str(tmp_path / "t"))
    assert [p.name for p in Path(tmp_path, "t").iterdir()] == ["chain-00000.nc"]
    assert len({r["file"] for r in made[0].collect()}) > 1
    monkeypatch.setattr(netcdf, "PART_BYTES", 10 * 6 * 8)  # ten draws of e, which has six cells
    reader = Reader({"path": str(tmp_path / "t")})
    parts = reader.partitions()
    assert [(p.first, p.stop) for p in parts if p.var == "e"] == [(0, 10), (10, 20), (20, 30), (30, 40)]
    every = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    rows[50] = (*rows[50][:5], float("nan"))
    assert sorted(map(repr, every)) == sorted(map(repr, rows))
    with pytest.raises(ValueError, match="without variable, chain or draw"):
        netcdf.write_draws(spark.createDataFrame([("e", None, 0, "a", 0, 1.0)], netcdf.SCHEMA), str(tmp_path / "u"))
