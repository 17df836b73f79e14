"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard.

Equal vectors are one point, which keeps the ``k + 1`` smallest of their ids: no more can be in an answer. Points
are dealt by a hash of the vector into shards; each shard becomes one row that holds its vectors and, for each layer, a
flat array of neighbours. The queries go past the shards in blocks of ``QUERY_BYTES``: a block is handed to all tasks,
each of which reads its shards where they lie, keeps the best it has met for each query, and gives that once. No shard
is copied or moved for a query. Within a shard, building and searching go in lockstep over many vectors at a time.

Points are ordered by layer, highest first, so that each layer holds a prefix of them, and layers are built from
the top. All that a search has found is scored in double precision on the original vectors. Scores are rounded to
``DIGITS`` decimals, which is above the error of their sums, so that vectors of one direction have one score and tie. Where
the last that a search has found may tie with an answer, so that there may be more like it, or a search ends with too few,
that query is held against the whole shard.

Vectors that are null, empty or zero, or hold null or non-finite components, take no part; neither do null ids.
Vectors meet only those of their own length. Rows that repeat an id and vector count once; of query rows that repeat an
id with other vectors the one with the smallest vector asks (by its first component that differs). Ties go to the
smaller id. An empty table gives an empty result. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeweft.llm.common import shared_path, stored

#: Points of a shard; beyond ``SHARDS`` shards these grow up to ``LARGEST``.
SHARD_SIZE = 8192
SHARDS = 4096
LARGEST = 1 << 17
QUERY_BYTES = 32 << 20
LINKS = 16
EF_BUILD = 64
EF_SEARCH = 96
BATCH = 256
FIRST = 512
AT_ONCE = 4
#: Single precision may be off by this much.
CLOSE = 1e-6
DIGITS = 12
NONE = -1


def layer_sizes(n: int, links: int = LINKS) -> list[int]:
    """How many points each layer holds, from the lowest: a geometric row down to fewer than ``links``."""
    sizes = [n]
    while sizes[-1] > links:
        sizes.append(sizes[-1] // links)
    return [s for s in sizes if s]


def beam(x, links, queries, start, ef):
    """The ``ef`` nearest found for each query: (ids, similarities), nearest first, NONE and -inf as filling.

    ``links`` holds the neighbours of the points of one layer, ``start`` one point to begin with for each query.
    """
    n, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((n, len(links)), dtype=bool)
    ids = np.full((n, ef), NONE, dtype=np.int32)
    near = np.full((n, ef), -np.inf, dtype=np.float32)
    open_ = np.zeros((n, ef), dtype=bool)
    ids[:, 0], open_[:, 0] = start, True
    near[:, 0] = np.einsum("nd,nd->n", queries, x[start])
    seen[np.arange(n), start] = True
    live = np.arange(n)
    while len(live):
        here = rows[: len(live)]
        best = np.where(open_[live], near[live], -np.inf)
        pick = np.argsort(-best, axis=1, kind="stable")[:, :AT_ONCE]
        good = np.take_along_axis(best, pick, axis=1) > -np.inf
        from_ = np.where(good, np.take_along_axis(ids[live], pick, axis=1), 0)
        open_[live[:, None], pick] = False
        met = np.where(good[:, :, None], links[from_], NONE).reshape(len(live), -1)
        met.sort(axis=1)
        fresh = (met >= 0) & ~seen[live[:, None], np.maximum(met, 0)]
        fresh[:, 1:] &= met[:, 1:] != met[:, :-1]
        lane, spot = np.nonzero(fresh)
        point = met[lane, spot]
        seen[live[lane], point] = True
        found = np.full(met.shape, -np.inf, dtype=np.float32)
        found[lane, spot] = np.einsum("nd,nd->n", queries[live[lane]], x[point])
        all_ids = np.concatenate([ids[live], met], axis=1)
        all_near = np.concatenate([near[live], found], axis=1)
        all_open = np.concatenate([open_[live], fresh], axis=1)
        top = np.argsort(-all_near, axis=1, kind="stable")[:, :ef]
        ids[live], near[live], open_[live] = all_ids[here, top], all_near[here, top], all_open[here, top]
        ids[live] = np.where(near[live] == -np.inf, NONE, ids[live])
        open_[live] &= near[live] > -np.inf
        live = live[open_[live].any(axis=1)]
    return ids, near


def choose(x, ids, near, most):
    """Up to ``most`` of each row's candidates (nearest first): first those nearer to the point than to any chosen
    before them, then the nearest of the rest."""
    n, c = ids.shape
    points = x[np.maximum(ids, 0)]
    between = points @ points.transpose(0, 2, 1)
    chosen = np.zeros((n, c), dtype=bool)
    rank = np.full((n, c), 2, dtype=np.int8)
    rank[ids < 0] = 3
    for k in range(c):
        blocked = (chosen & (between[:, k, :] > near[:, k : k + 1])).any(axis=1)
        chosen[:, k] = (ids[:, k] >= 0) & ~blocked
    rank[chosen] = 1
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(rank, order, axis=1) < 3, np.take_along_axis(ids, order, axis=1), NONE)


def link_back(x, links, new, chosen):
    """Give every chosen neighbour a link to its new point, and thin out where links would be too many."""
    most = links.shape[1]
    src, at = np.nonzero(chosen >= 0)
    to, from_ = chosen[src, at], new[src]
    near = np.einsum("nd,nd->n", x[to], x[from_])
    order = np.lexsort((-near, to))
    to, from_ = to[order], from_[order]
    first = np.r_[True, to[1:] != to[:-1]]
    place = np.arange(len(to)) - np.maximum.accumulate(np.where(first, np.arange(len(to)), 0))
    keep = place < most
    points, row = np.unique(to, return_inverse=True)
    added = np.full((len(points), most), NONE, dtype=np.int32)
    added[row[keep], place[keep]] = from_[keep]
    both = np.concatenate([links[points], added], axis=1)
    sims = np.einsum("nd,ncd->nc", x[points], x[np.maximum(both, 0)])
    sims[both < 0] = -np.inf
    order = np.argsort(-sims, axis=1, kind="stable")
    both, sims = np.take_along_axis(both, order, axis=1), np.take_along_axis(sims, order, axis=1)
    few = (both[:, most:] < 0).all(axis=1)
    links[points[few]] = both[few, :most]
    for i in range(0, len(full := np.flatnonzero(~few)), BATCH):
        part = full[i : i + BATCH]
        links[points[part]] = choose(x, both[part], sims[part], most)


def descend(x, layers, queries):
    """For each query a point near it, from the layers in ``layers``, lowest first."""
    start = np.zeros(len(queries), dtype=np.int32)
    for links in reversed(layers):
        start = beam(x, links, queries, start, 8)[0][:, 0]
    return start


def build(x: np.ndarray) -> list[np.ndarray]:
    """The layers, lowest first, of unit vectors ``x`` (float32): neighbours of the first so many points."""
    layers: list[np.ndarray] = []  # highest first while building
    for level, size in reversed(list(enumerate(layer_sizes(len(x))))):
        most = LINKS * (1 if level else 2)
        links = np.full((size, most), NONE, dtype=np.int32)
        begin = min(size, FIRST)
        sims = x[:begin] @ x[:begin].T
        np.fill_diagonal(sims, -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : min(EF_BUILD, begin - 1)].astype(np.int32)
        if begin > 1:
            for i in range(0, begin, BATCH):
                part = order[i : i + BATCH]
                links[i : i + len(part)] = choose_padded(x, part, np.take_along_axis(sims[i : i + BATCH], part, 1), most)
            new = np.arange(begin, dtype=np.int32)
            link_back(x, links, new, links[:begin].copy())
            dedupe(links[:begin])
        for i in range(begin, size, BATCH):
            new = np.arange(i, min(i + BATCH, size), dtype=np.int32)
            start = descend(x, layers[::-1], x[new])
            if (start >= i).any():
                start = earlier(layers[-1], start, i)
            ids, near = beam(x, links[:i], x[new], start, EF_BUILD)
            own = x[new] @ x[new].T
            np.fill_diagonal(own, -np.inf)
            peers = np.argsort(-own, axis=1, kind="stable")[:, :LINKS].astype(np.int32)
            ids = np.concatenate([ids, new[peers]], axis=1)
            near = np.concatenate([near, np.take_along_axis(own, peers, axis=1)], axis=1)
            ids = np.where(near == -np.inf, NONE, ids)
            top = np.argsort(-near, axis=1, kind="stable")
            ids, near = np.take_along_axis(ids, top, axis=1), np.take_along_axis(near, top, axis=1)
            links[new] = choose_padded(x, ids, near, most)
            link_back(x, links, new, links[new].copy())
            dedupe(links[: i + len(new)])
        layers.append(links)
    return layers[::-1]


def earlier(above: np.ndarray, start: np.ndarray, i: int) -> np.ndarray:
    """``start`` with those points that are not among the first ``i`` yet replaced by a neighbour that is, or else by the first point.

    A layer of more than FIRST points stands whole while the one below it, which begins with the same points, is being built.
    """
    near = above[start]
    good = (near >= 0) & (near < i)
    other = np.where(good.any(axis=1), near[np.arange(len(near)), good.argmax(axis=1)], 0)
    return np.where(start < i, start, other)


def choose_padded(x, ids, near, most):
    out = np.full((len(ids), most), NONE, dtype=np.int32)
    found = choose(x, ids, near, most)
    out[:, : found.shape[1]] = found
    return out


def dedupe(links: np.ndarray) -> None:
    """Two points may choose each other; each link counts once."""
    order = np.argsort(links, axis=1, kind="stable")
    ordered = np.take_along_axis(links, order, axis=1)
    ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = NONE
    np.put_along_axis(links, order, ordered, axis=1)


def search(x: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, ef: int = EF_SEARCH):
    start = descend(x, layers[1:], queries)
    return beam(x, layers[0], queries, start, ef)


def unit(v: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small components stay finite
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)
    return rows.filter(F.exists("v", lambda c: c != 0)).withColumn("dim", F.size("v"))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


GRAPH = "dim int, shard int, n int, kept int, vectors binary, ids binary, layers array<binary>"


def build_index(
    vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_size: int = SHARD_SIZE
) -> DataFrame:
    """One row a shard: its distinct vectors, the smallest k+1 ids of each, and its layers; written to the shared
    folder. It answers searches for up to ``k`` neighbours."""
    rows = usable(vectors, id_col, vector_col).distinct()
    alike = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(alike)).filter(F.col("r") <= k + 1)
    points = few.groupBy("v", "dim").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = stored(points, "points")
    sizes = points.groupBy("dim").agg(F.count("*").alias("n"))
    size = F.greatest(F.lit(shard_size), F.least(F.lit(LARGEST), F.col("n") / SHARDS))
    shards = F.ceil(F.col("n") / size).cast("int")
    dealt = points.join(sizes.select("dim", shards.alias("_shards")), "dim")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("v"), F.col("_shards")).cast("int")).drop("_shards")

    def graph(key, table):
        dim = key[0].as_py()
        v = matrix(table["v"], dim)
        ids = table["ids"].to_pylist()
        # a fixed order that has nothing to do with the vectors' places
        order = np.argsort([hash((i[0], 7)) & 0xFFFFFFFF for i in ids], kind="stable")
        v, ids = np.ascontiguousarray(v[order]), [ids[i] for i in order]
        members = np.array([i + [NONE] * (k + 1 - len(i)) for i in ids], dtype=np.int64)
        given = np.array([len(i) for i in ids], dtype=np.int64)
        layers = build(unit(v).astype(np.float32))
        row = [[dim], [key[1].as_py()], [len(v)], [k + 1], [v.tobytes()], [given.tobytes() + members.tobytes()], [[x.tobytes() for x in layers]]]
        kinds = [*[pa.int32()] * 4, pa.binary(), pa.binary(), pa.list_(pa.binary())]
        names = ["dim", "shard", "n", "kept", "vectors", "ids", "layers"]
        return pa.table([pa.array(r, t) for r, t in zip(row, kinds, strict=True)], names=names)

    # a task a shard: a shard is small to move and long to build, so that partitions must not be put together
    total = sizes.agg(F.sum(shards)).head()[0] or 1
    dealt = dealt.repartition(int(total), "dim", "shard")
    return stored(dealt.groupBy("dim", "shard").applyInArrow(graph, GRAPH), "graphs")


class Shard:
    """One row of an index, ready to be searched."""

    def __init__(self, row: dict):
        n, dim = row["n"], row["dim"]
        self.unit = unit(np.frombuffer(row["vectors"], dtype=np.float64).reshape(n, dim))
        self.single = self.unit.astype(np.float32)
        layers = [np.frombuffer(b, dtype=np.int32) for b in row["layers"]]
        self.layers = [x.reshape(s, -1) for x, s in zip(layers, layer_sizes(n), strict=True)]
        ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.given, self.ids = ids[:n], ids[n:].reshape(n, row["kept"])

    def nearest(self, asked: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(score, id) of the k nearest found of each query, -inf and NONE as filling; ``asked`` are their own ids."""
        found, near = search(self.single, self.layers, queries.astype(np.float32), max(EF_SEARCH, 4 * k))
        scores = self.scores(queries, found)
        out = self.best(asked, found, scores, k)
        # one point may be the query's own, so that the answers lie in the k + 1 best points
        last = -np.partition(-scores, k, axis=1)[:, k]
        # a search that ends early has met a part of the graph that no link leaves, as many points of one direction may be
        for i in np.flatnonzero((found[:, -1] < 0) | (near[:, -1] >= last - CLOSE)).tolist():
            every = self.unit @ queries[i]
            # this product rounds otherwise than the scores do: all within a margin are scored
            edge = -np.partition(-every, k)[k] - 4 * 10.0**-DIGITS if len(every) > k else -np.inf
            these = np.flatnonzero(every >= edge)[None]
            exact = self.scores(queries[i : i + 1], these)
            for whole, part in zip(out, self.best(asked[i : i + 1], these, exact, k), strict=True):
                whole[i] = part[0]
        return out

    def scores(self, queries: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The rounded cosine of each query and its points, -inf where there is none. Rounding an exact 1 leaves it 1."""
        found = np.round(np.einsum("nd,nkd->nk", queries, self.unit[np.maximum(points, 0)]), DIGITS)
        return np.where(points < 0, -np.inf, found)

    def best(self, asked: np.ndarray, points: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids = self.ids[np.maximum(points, 0)]
        good = (np.arange(ids.shape[2]) < self.given[np.maximum(points, 0)][:, :, None]) & (points >= 0)[:, :, None]
        good &= ids != asked[:, None, None]
        scores = np.where(good, scores[:, :, None], -np.inf)
        return first_by_score(scores.reshape(len(asked), -1), ids.reshape(len(asked), -1), k)


def first_by_score(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row and their ids, ties by the smaller id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)


def answers(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each query in ``asked``, a block of bounded size, the best that each task found."""
    block = asked.toArrow()
    blocks = {}
    for dim in block["dim"].unique().to_pylist():
        part = block.filter(pc.equal(block["dim"], dim))
        blocks[dim] = part["id"].to_numpy(), unit(matrix(part["v"], dim))
    held = index.sparkSession.sparkContext.broadcast(blocks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                if row["dim"] not in held.value:
                    continue
                ids, queries = held.value[row["dim"]]
                shard = Shard(row)
                parts = [shard.nearest(ids[j : j + BATCH], queries[j : j + BATCH], k) for j in range(0, len(ids), BATCH)]
                found = [padded(np.concatenate(c), k, fill) for c, fill in zip(zip(*parts, strict=True), (-np.inf, NONE), strict=True)]
                if row["dim"] in best:
                    found = [np.concatenate(c, axis=1) for c in zip(best[row["dim"]], found, strict=True)]
                best[row["dim"]] = first_by_score(*found, k)
        for dim, (scores, ids) in best.items():
            at, place = np.nonzero(scores > -np.inf)
            columns = [held.value[dim][0][at], ids[at, place], scores[at, place]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return index.mapInArrow(work, "query_id long, vec_id long, score double")


def padded(x: np.ndarray, k: int, fill) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, k - x.shape[1])), constant_values=fill)


def search_index(
    index: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, its own id left out."""
    kept = index.agg(F.min("kept")).head()[0]
    if kept is not None and kept <= k:
        raise ValueError(f"this index answers searches for {kept - 1} neighbours at most")
    asked = usable(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    asked = stored(asked, "queries")
    components = asked.agg(F.sum("dim")).head()[0] or 0
    blocks = max(1, -(-8 * components // QUERY_BYTES))
    paths = []
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        ranked = answers(index, block, k).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        paths.append(shared_path(index.sparkSession, "nearest"))
        ranked.select("query_id", "rank", "vec_id", "score").write.parquet(paths[-1])
    return index.sparkSession.read.schema("query_id long, rank int, vec_id long, score double").parquet(*paths)
