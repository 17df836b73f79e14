"""Plans that hold on larger tables: work is dealt to tasks, and is done once."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from treeweft.functions import arrays
from treeweft.llm import common, hnsw, lines
from treeweft.operators import diagnostics, evaluate, plotdata
from treeweft.plans import domain as D
from treeweft.plans.queries import QUERIES

TABLES = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_draws_are_dealt_by_node(spark):
    """A table of nodes is one small file: its draws were all made in the task that read it, and shuffled for each grouping."""
    found = D.draws(spark, TABLES)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    for by in (["node", "k"], ["node", "chain", "draw"]):
        plan = plan_of(found.groupBy(*by).agg(F.sum("value")))
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange") == plan.count("BroadcastExchange") + 1
    assert "ObjectHashAggregate" not in plan_of(QUERIES["softmax_draws"](spark, TABLES)) + plan_of(QUERIES["gathered_draws"](spark, TABLES))


def test_softmax_works_out_each_power_once(spark):
    """The largest logit is named once in the plan, not within the function of each element."""
    eta = [0.5, -2.0, 700.0, 1.0]
    frame = spark.createDataFrame([(eta,), (None,)], "eta array<double>").select(arrays.softmax_last_zero("eta").alias("p"))
    whole = [math.exp(x - 700.0) for x in [*eta, 0.0]]
    found = [r["p"] for r in frame.collect()]
    assert np.allclose(found[0], np.array(whole) / sum(whole), rtol=1e-14) and not found[1]
    project = frame._jdf.queryExecution().optimizedPlan().toString()
    assert project.count("concat(eta") == 1


def test_narrowest_intervals_of_small_and_large_keys(spark, monkeypatch):
    """Keys of few samples are sorted as arrays; those beyond the bound go by ranges; the answers are the same."""
    g = np.random.default_rng(3)
    by = {"a": g.random(40), "b": np.round(g.random(300), 1), "c": g.random(1), "d": g.random(301)}
    frame = spark.createDataFrame([(k, float(x)) for k, v in by.items() for x in v], "g string, value double").repartition(5)
    want = {}
    for k, v in by.items():
        v = np.sort(v)
        span = min(int(np.floor(0.9 * len(v))), len(v) - 1)
        want[k] = min((v[i + span] - v[i], v[i], v[i + span]) for i in range(len(v) - span))[1:]
    assert "rangepartitioning" not in plan_of(evaluate.hdi(frame, "g", prob=0.9))
    for bound in (1 << 16, 299, 0):
        monkeypatch.setattr(evaluate, "ARRAY", bound)
        assert {r["g"]: (r["lo"], r["hi"]) for r in evaluate.hdi(frame, "g", prob=0.9).collect()} == want


def test_summary_is_one_aggregate(spark):
    """Each parameter's draws meet once: no table on the way is written or dealt again."""
    plan = plan_of(QUERIES["mcmc_summary"](spark, TABLES))
    assert plan.count("Exchange hashpartitioning") == 1 and "ExistingRDD" not in plan and "Window" not in plan and "Join" not in plan.replace("BroadcastNestedLoopJoin", "")
    one = spark.createDataFrame([(None, c, d, float(c + d)) for c in range(2) for d in range(2)] + [("few", 0, 0, 1.0)], "node string, chain int, draw int, value double")
    found = diagnostics.summary(one, ["node"]).collect()
    assert [(r["node"], r["mean"], r["ess_bulk"], r["ess_tail"]) for r in found] == [(None, 1.0, 4.0, 4.0)]  # one draw a chain tells nothing


def test_upper_layer_of_more_points_than_the_first_block(monkeypatch):
    """A shard of more than 16 x FIRST points has an upper layer that goes beyond what stands of the lower one."""
    monkeypatch.setattr(hnsw, "FIRST", 64)
    g = np.random.default_rng(5)
    x = hnsw.unit(g.standard_normal((3000, 16))).astype(np.float32)
    assert hnsw.layer_sizes(3000)[1] > hnsw.FIRST
    layers, asked = hnsw.build(x), x[::30]
    assert all((links < len(links)).all() for links in layers)
    found = hnsw.search(x, layers, asked)[0][:, :5]
    want = np.argsort(-(asked @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found.tolist(), want.tolist(), strict=True)]) > 0.95


def test_linkage_of_many_rows(monkeypatch):
    """More rows than a matrix takes, in small blocks, give the tree of the matrix; so do rows that are alike."""
    g = np.random.default_rng(6)
    x = g.dirichlet(np.full(9, 0.3), 300)
    far = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))
    want = plotdata.average_linkage(far)
    assert plotdata.linkage_of_rows(x) == want
    monkeypatch.setattr(plotdata, "MATRIX", 10)
    monkeypatch.setattr(plotdata, "BLOCK", 8 * 300 * 7)
    assert plotdata.linkage_of_rows(x) == want
    assert sorted(plotdata.linkage_of_rows(np.round(x, 1))) == list(range(300)) and plotdata.linkage_of_rows(x[:0]) == []


def test_heat_map_of_more_rows_than_before(spark, monkeypatch):
    monkeypatch.setattr(plotdata, "MATRIX", 20)
    monkeypatch.setattr(plotdata, "MOST_ROWS", 20, raising=False)  # the bound beyond which it was an error
    rows = spark.createDataFrame([(p, f"n{i:03d}", c, float((i * 7 + c * c) % 11)) for p in range(2) for i in range(60) for c in range(4)], "patient int, node string, channel int, share double")
    found = plotdata.cluster_rows(rows, "patient").collect()
    assert sorted((r["patient"], r["position"]) for r in found) == [(p, i) for p in range(2) for i in range(60)]
    assert len({(r["patient"], r["node"]) for r in found}) == 120


def test_lines_are_hashed_in_parts(spark, monkeypatch):
    """A batch's texts go in parts of bounded size, none lost and none twice, whatever the bound."""
    texts = ["a" * 700, "", None, "x\ny\n" * 200, "é" * 90, "b"] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(texts)], ["i", "_text"])
    for most in (1, 100, 1000, 1 << 20):
        parts = list(common.parts_of(iter([batch, batch.slice(0, 0)]), "_text", most))
        assert pa.concat_batches(parts).equals(batch)
        assert all(len(p) <= 1 or sum(len((t or "").encode()) for t in p["_text"].to_pylist()[1:]) <= most + 800 for p in parts)
    docs = spark.createDataFrame([(i, f"{t}\nline number {i % 7} of a text\nline number {i % 7} of a texts") for i, t in enumerate(texts)], "doc_id long, text string")
    want = sorted(map(tuple, lines.dedup_lines(docs).collect()))
    monkeypatch.setattr(lines, "PART_BYTES", 64)
    assert sorted(map(tuple, lines.dedup_lines(docs).collect())) == want


def test_linkage_by_short_lists(monkeypatch):
    """Lists that run out, few groups compared at once and sums of large groups give the tree of the matrix."""
    g = np.random.default_rng(8)
    x = g.dirichlet(np.full(12, 0.5), 500)
    x[:250] = (x[:250] + 3 / 12) / 4
    want = plotdata.average_linkage(np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0)))
    monkeypatch.setattr(plotdata, "MATRIX", 1)
    for near, pending in ((2, 1), (5, 40), (64, 3), (1000, 9)):
        monkeypatch.setattr(plotdata, "NEAR", near)
        monkeypatch.setattr(plotdata, "PENDING", pending)
        assert plotdata.linkage_of_rows(x) == want


def test_rows_alike_are_together(monkeypatch):
    """Copies of rows are groups to begin with, and rows at one distance from all others end."""
    monkeypatch.setattr(plotdata, "MATRIX", 20)
    g = np.random.default_rng(9)
    kinds = g.integers(0, 40, 600)
    order = plotdata.linkage_of_rows(g.dirichlet(np.full(9, 0.3), 40)[kinds])
    runs = np.flatnonzero(np.diff(kinds[order], prepend=-1))
    assert len(runs) == 40 and all(r.tolist() == sorted(r.tolist()) for r in np.split(np.array(order), runs[1:]))
    assert sorted(plotdata.linkage_of_rows(np.eye(300))) == list(range(300))


def test_work_of_the_linkage(monkeypatch):
    """Groups are compared with all others a few times each, and not again after each merge nearby."""
    done = [0]

    class Counted:
        def __getattr__(self, name):
            return getattr(np, name)

        def sqrt(self, a, *more, **named):
            done[0] += np.size(a)
            return np.sqrt(a, *more, **named)

    g = np.random.default_rng(10)
    x = g.multinomial(40, np.full(96, 1 / 96), 1500) / 40
    monkeypatch.setattr(plotdata, "MATRIX", 100)
    monkeypatch.setattr(plotdata, "np", Counted())
    assert sorted(plotdata.linkage_of_rows(x)) == list(range(1500))
    assert done[0] < 8 * 1500 * 1500, done[0] / 1500**2
