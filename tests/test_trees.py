"""Trees by pointer doubling, intervals and Newick text in parts, against plain walks; processes that share atoms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeweft.functions import tables
from treeweft.operators import sticks, tree
from treeweft.operators.measures import DirichletPrior, TreeProcess
from treeweft.sources import files, newick

EDGES = "tumour int, parent string, child string, length double"


def random_forest(trees, size, seed, deep=False):
    g = np.random.default_rng(seed)
    odd = ["", " b", "'s", ",(x)", ":1", ";"]
    rows = []
    for t in range(trees):
        names = [f"t{t}n{i:03d}{odd[int(g.integers(len(odd)))] if g.random() < 0.2 else ''}" for i in range(size)]
        for i in range(1, size):
            up = i - 1 if deep and i % 3 else int(g.integers(0, i))
            rows.append((t, names[up], names[i], float(g.integers(1, 9))))
    return rows


def test_a_path_takes_logarithmic_rounds(spark, monkeypatch):
    frame = spark.createDataFrame([(0, f"n{i}", f"n{i + 1}", 1.0) for i in range(10_000)], EDGES)
    rounds, settled = [], tree.settled
    monkeypatch.setattr(tree, "settled", lambda df: rounds.append(1) or settled(df))
    found = tree.depths(frame).agg(F.max("depth"), F.count("*")).head()
    assert tuple(found) == (10_000, 10_001) and len(rounds) <= 15


def test_several_parents_and_cycles(spark):
    frame = spark.createDataFrame([(0, p, c, 1.0) for p, c in ("ra", "ab", "bc", "rc", "cd", "sd", "sd")], EDGES)
    assert sorted(map(tuple, tree.depths(frame).collect())) == [(0, "a", 1), (0, "b", 2), (0, "c", 1), (0, "d", 1), (0, "r", 0), (0, "s", 0)]
    assert {(r["root"], r["depth"]) for r in tree.to_roots(frame).filter("node = 'd'").collect()} == {("r", 2), ("s", 1)}
    with pytest.raises(ValueError, match="more than one parent"):
        tree.intervals(frame)
    for bad in (["ra", "ab", "ba"], ["xy", "yx"], ["xx"]):
        with pytest.raises(ValueError, match="cycle"):
            tree.depths(spark.createDataFrame([(0, p, c, 1.0) for p, c in bad], EDGES))


def test_first_forest_gives_the_parent(spark):
    a = spark.createDataFrame([(1, "z", "x", 2.0), (1, "x", "y", 1.0)], EDGES)
    b = spark.createDataFrame([(0, "a", "x", 9.0), (0, "x", "w", 3.0)], EDGES)
    both = tree.union(a.repartition(3), b)
    assert both.columns == a.columns
    assert sorted(map(tuple, both.collect())) == [(0, "x", "w", 3.0), (1, "x", "y", 1.0), (1, "z", "x", 2.0)]


@pytest.mark.parametrize("deep", [False, True])
def test_intervals_and_sums(spark, deep):
    rows = random_forest(3, 60, 1, deep) + [(2, "second root", "below", 1.0)]
    below, up = {}, {}
    for t, p, c, _ in rows:
        below.setdefault((t, p), []).append((t, c))
        up[t, c] = (t, p)
    tops = sorted({(t, p) for t, p, *_ in rows} - set(up))
    want, at = {}, {}

    def walk(node, depth):
        entry = at.get(node[0], 0)
        at[node[0]] = entry + 1
        for child in sorted(below.get(node, [])):
            walk(child, depth + 1)
        want[node] = (depth, entry, at[node[0]] - 1)

    for top in tops:
        walk(top, 0)
    frame = spark.createDataFrame(rows, EDGES).repartition(5)
    placed = tree.intervals(frame)
    found = {(r["tumour"], r["node"]): (r["depth"], r["entry"], r["exit"]) for r in placed.collect()}
    assert found == want
    nths = {(r["tumour"], r["node"]): r["nth"] for r in placed.collect()}
    assert all(nths[c] == i for children in below.values() for i, c in enumerate(sorted(children)))
    values = {node: i % 7 for i, node in enumerate(sorted(want))}
    given = spark.createDataFrame([(*node, v) for node, v in values.items()], "tumour int, node string, v int")
    sums = {(r["tumour"], r["node"]): r["v"] for r in tree.within(placed, placed.join(given, ["tumour", "node"]), "v").collect()}
    inside = {n: [m for m in want if m[0] == n[0] and want[n][1] <= want[m][1] <= want[n][2]] for n in want}
    assert sums == {n: sum(values[m] for m in ms) for n, ms in inside.items()}
    steps = tree.subtree_sums(placed.join(given, ["tumour", "node"]).select("tumour", "node", "parent", "v"), "v")
    assert {(r["tumour"], r["node"]): r["v"] for r in steps.collect()} == sums


def test_newick_in_parts(spark, tmp_path):
    rows = random_forest(4, 50, 2)
    frame = spark.createDataFrame(rows, EDGES).repartition(3)
    text = newick.text_rows(frame)
    for r in newick.serialise(frame).collect():
        assert sorted(newick.parse_tree(r["newick"], r["tumour"])) == sorted(x for x in rows if x[0] == r["tumour"])
    again = newick.parse_parts(text, "text", ["tumour", "position"], "tumour")
    assert sorted(map(tuple, again.collect())) == sorted(rows)
    files.write_newick(text, f"file://{tmp_path}/trees.nwk")
    lines = files.read_newick(spark, f"file://{tmp_path}/trees.nwk")
    assert sorted(map(tuple, newick.parse_parts(lines, "value", files.LINE_ORDER).collect())) == sorted(rows)


def test_odd_newick(spark):
    """Blank trees, unnamed nodes, quotes, lengths, and texts cut anywhere but within a label."""
    parts = ["((a:1,b:2.5)x:1,", "'c d;:(':0.5", ",(e", ")'it''s'", ")r;;(,(q,", ")):3;\n alone ; (p", ")w"]
    want = newick.parse_tree("((a:1,b:2.5)x:1,'c d;:(':0.5,(e)'it''s')r;", 0) + newick.parse_tree("(,(q,)):3;", 1) + newick.parse_tree("(p)w;", 3)
    frame = spark.createDataFrame(list(enumerate(parts)), "i int, value string")
    found = newick.parse_parts(frame.repartition(4), "value", ["i"])
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    for bad in ("((a,b);", "(a,b));", "(a", "((a)", "(a,b)", "(a,"):
        with pytest.raises(ValueError):
            newick.parse_parts(spark.createDataFrame([(0, bad)], "i int, value string"), "value", ["i"])
    none = frame.limit(0)
    assert newick.parse_parts(none, "value", ["i"]).count() == 0
    assert newick.parse_parts(none.unionByName(spark.createDataFrame([(1, None), (2, " ;")], "i int, value string")), "value", ["i"]).count() == 0


def test_table_function(spark):
    tables.register(spark)
    rows = [("x", 2, "c)r;"), ("x", 1, "(a:2,"), ("y", 1, None), ("z", 1, "(p,q)s;(u)v"), (None, 1, "(m)n;")]
    spark.createDataFrame(rows, "tumour string, position int, text string").createOrReplaceTempView("some_trees")
    found = spark.sql("SELECT * FROM newick_edges(TABLE(some_trees))").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(
        map(repr, [("x", "r", "a", 2.0), ("x", "r", "c", None), ("z", "s", "p", None), ("z", "s", "q", None), ("z", "v", "u", None), (None, "n", "m", None)])
    )
    with pytest.raises(Exception, match="columns tumour and text"):
        spark.sql("SELECT * FROM newick_edges(TABLE(SELECT 1 AS a))").collect()


def test_relatives_share_atoms(spark):
    """Draws of a tree of processes: siblings meet in few atoms, unrelated trees in none, and twice is the same."""
    rows = [(0, "r", f"m{i}", 1.0) for i in range(3)] + [(0, f"m{i}", f"m{i}c{k}", 1.0) for i in range(3) for k in range(4)] + [(1, "s", "t", 1.0)]
    e = spark.createDataFrame(rows, EDGES)
    forest = tree.nodes(e).join(tree.depths(e), ["tumour", "node"]).select("node", "parent", "depth")
    draws = forest.select("node", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("draw"))
    found = sticks.tree_draws(forest, draws, 1.5).collect()
    by = {(r["node"], r["draw"]): (r["root"], r["k"]) for r in found}
    assert len(found) == len(by) == 40 * 18
    assert {r for (n, _), (r, _) in by.items() if n in ("s", "t")} == {"s"} and all(r == "r" for (n, _), (r, _) in by.items() if n[0] == "m")
    atoms = {n: {a for (m, _), a in by.items() if m == n} for n in {n for n, _ in by}}
    siblings = [atoms[f"m0c{k}"] for k in range(4)]
    assert all(a & b for a in siblings for b in siblings)  # with private sticks there would be none in common
    assert atoms["m0c0"] <= {a for (n, _), a in by.items()} and sum(map(len, siblings)) > len(set.union(*siblings))
    again = sticks.tree_draws(forest.repartition(5), draws.filter("node = 'm1c2'"), 1.5).collect()
    assert {(r["node"], r["draw"]): (r["root"], r["k"]) for r in again} == {k: v for k, v in by.items() if k[0] == "m1c2"}
    process = TreeProcess(DirichletPrior(6), 1.5, forest)
    drawn = {}
    for r in process.sample(draws.filter("node in ('m0c0', 'm0c1') and draw < 12")).collect():
        drawn.setdefault((r["node"], r["draw"]), {})[r["channel"]] = r["p"]
    vectors = {k: tuple(round(v[c], 12) for c in range(6)) for k, v in drawn.items()}
    assert len(vectors) == 24 and all(abs(sum(v) - 1) < 1e-9 for v in vectors.values())
    assert all((vectors[a] == vectors[b]) == (by[a] == by[b]) for a in vectors for b in vectors)
    assert sticks.tree_draws(forest, draws.limit(0), 1.5).count() == 0
