"""The tables behind the figures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeweft.functions.vectors import quantiles

#: Groups whose distances are held as a matrix at once (128 MB), and bytes of a block of distances to all rows.
MATRIX = 4096
BLOCK = 32 << 20
#: Groups in a new list of the nearest, groups that are compared with all at once, and bytes of the sums of large groups.
NEAR = 64
PENDING = 64
SUMS = 128 << 20
GROUP_PARTS = 1000


def box(rows: DataFrame, by, value: str) -> DataFrame:
    """(*by, q1, median, q3, whisker_lo, whisker_hi, n_outliers): whiskers end at the last value within 1.5 IQR."""
    by = [by] if isinstance(by, str) else list(by)
    for c in by:
        rows = rows.filter(F.col(c).isNotNull())
    rows = rows.filter(~F.isnan(value))
    cuts = quantiles(rows, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.join(cuts, by).groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_lo"), F.max(F.when(inside, F.col(value))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"),
    )


def histogram(rows: DataFrame, value: str, bins: int, density: bool = False) -> DataFrame:
    """(bin, lo, hi, height) of equal bins over the range, the last one closed; values all alike get the range
    half a unit to each side. Empty bins are held."""
    rows = rows.filter(F.col(value).isNotNull() & ~F.isnan(value))
    ends = rows.agg(F.min(value).alias("a"), F.max(value).alias("b"), F.count("*").alias("n")).filter("n > 0")
    flat = F.col("a") == F.col("b")
    ends = ends.select(F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("b"), "n")
    width = (F.col("b") - F.col("a")) / bins
    place = F.least(F.floor((F.col(value) - F.col("a")) / width), F.lit(bins - 1)).cast("int")
    counts = rows.select(value).join(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("c"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    both = every.join(counts, "bin", "left")
    c = F.coalesce("c", F.lit(0))
    height = c / (F.col("n") * width) if density else c
    return both.select("bin", (F.col("a") + F.col("bin") * width).alias("lo"), (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), height.alias("height"))


def axis_limit(rows: DataFrame, a: str, b: str, slack: float) -> DataFrame:
    return rows.agg((F.greatest(F.max(a), F.max(b)) * slack).alias("axis_limit"))


def relative_profiles(counts: DataFrame) -> DataFrame:
    """(node, channel, share) of (node, channel, n)."""
    total = F.sum("n").over(Window.partitionBy("node"))
    return counts.select("node", "channel", F.try_divide(F.col("n").cast("double"), total).alias("share"))


def average_linkage(distances: np.ndarray, held: list[list[int]] | None = None) -> list[int]:
    """The leaves in the order of the merge tree: groups with the smallest mean distance merge, the one with the
    smaller first leaf to the left.

    A chain goes from a group to its nearest until two are nearest to each other; these merge, whatever is nearer
    elsewhere, as that does not change the tree. So the time is quadratic, like the matrix. ``held`` are the leaves of the groups to begin
    with, by their first leaf; a leaf each, if not given.
    """
    n = len(distances)
    members = {i: list(held[i]) if held else [i] for i in range(n)}
    d = np.array(distances, float)
    np.fill_diagonal(d, np.inf)
    chain: list[int] = []
    while len(members) > 1:
        if not chain:
            chain.append(next(iter(members)))
        a = chain[-1]
        b = int(np.argmin(d[a]))
        if len(chain) < 2 or d[a, b] < d[a, chain[-2]]:
            chain.append(b)
            continue
        i, j = sorted((a, chain[-2]))
        del chain[-2:]
        x, y = len(members[i]), len(members[j])
        d[i] = (x * d[i] + y * d[j]) / (x + y)
        d[:, i] = d[i]
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        members[i] += members.pop(j)
    return next(iter(members.values()), [])


class Lists:
    """Groups of the rows of ``x``, each with a list of the groups that may be its nearest.

    A list holds lower bounds of the sums of distances to its groups, or those sums themselves; all groups without a part in it have
    a mean distance of ``bound`` or more. Merges leave this as it is, as the mean distance to a merged group lies between those to its
    parts. So a group is compared with all others only when its list has nothing below its bound. Lists are brought up to date when
    they are read.
    """

    def __init__(self, x: np.ndarray, groups: list[list[int]]):
        n = len(x)
        square, one = (x * x).sum(axis=1)[:, None], np.ones((n, 1))
        #: Squared distances are products of a row of the one and a row of the other.
        self.left, self.right = np.hstack([-2 * x, square, one]), np.hstack([x, one, square])
        self.members = {g[0]: np.array(g) for g in groups}
        self.label, self.size, self.first = np.empty(n, np.int64), np.zeros(n, np.int64), np.arange(n)
        for i, g in self.members.items():
            self.label[g], self.size[i] = i, len(g)
        #: By group: groups listed, by a row of each, their sizes then, sums, and whether these are more than lower bounds.
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.bound = np.zeros(n)
        #: Of groups of many rows, the sums of distances from all rows to theirs, and the members that are not in these yet.
        self.sums: dict[int, np.ndarray] = {}
        self.extra: dict[int, np.ndarray] = {}
        self.many = max(64, 8 * n * n // SUMS)
        self.found: dict[int, tuple[float, int, int, int]] = {}

    def far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = self.left[a] @ self.right[b].T
        np.maximum(out, 0, out=out)
        return np.sqrt(out, out=out)

    def far_sums(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each row of ``b``, the sum of the distances to those of ``a``."""
        step, out = max(1, BLOCK // 8 // max(1, len(b))), 0.0
        if len(a) <= step:
            return self.far(a, b).sum(axis=0)
        for i in range(0, len(a), step):
            out += self.far(a[i : i + step], b).sum(axis=0)
        return out

    def exact(self, g: int, others: np.ndarray) -> np.ndarray:
        """Sums of the distances of members of ``g`` to those of other groups."""
        own, out = self.members[g], np.zeros(len(others))
        small = []
        for k, c in enumerate(others.tolist()):
            if c in self.sums and g not in self.sums:
                out[k] = self.sums[c][own].sum() + self.far_sums(self.extra[c], own).sum()
            else:
                small.append(k)
        if small:
            asked = others[small]
            rows = np.concatenate([self.members[c] for c in asked.tolist()])
            each = self.sums[g][rows] + self.far_sums(self.extra[g], rows) if g in self.sums else self.far_sums(own, rows)
            sizes = self.size[asked]
            out[small] = np.add.reduceat(each, np.cumsum(sizes) - sizes)
        return out

    def add_up(self, g: int) -> None:
        """Put the extra members of a large group into its sums."""
        if len(self.extra[g]):
            self.sums[g] = self.sums[g] + self.far_sums(self.extra[g], np.arange(len(self.label)))
            self.extra[g] = self.extra[g][:0]

    def compare(self, asked: list[int]) -> None:
        """New lists for groups, by the distances to all rows; no more than a block of these is held."""
        ids = np.array(list(self.members))
        ids = ids[np.argsort(self.size[ids], kind="stable")]
        sizes, place = self.size[ids], np.empty(len(self.label), np.int64)
        place[ids] = np.arange(len(ids))
        starts, single = np.cumsum(sizes) - sizes, int((sizes == 1).sum())
        plain, rows = single == len(ids), max(1, BLOCK // 8 // len(self.label))
        # fresh memory for each block would take longer than the sums in it
        fars, totals, means = (np.empty((min(rows, len(self.label)), len(m))) for m in (self.label, ids, ids))

        def keep(some: np.ndarray, total: np.ndarray, squared: bool = False) -> None:
            mean = total if plain else np.divide(total, sizes, out=means[: len(some)])
            mean[np.arange(len(some)), place[some]] = np.inf
            # about NEAR of the smallest lie below a bound that a sample of the columns gives
            sample = mean[:, ::16]
            ends = np.partition(sample, min(NEAR // 16, sample.shape[1] - 1), axis=1)[:, min(NEAR // 16, sample.shape[1] - 1)]
            for r, g in enumerate(some.tolist()):
                at, end = np.flatnonzero(mean[r] < ends[r]), ends[r]
                if not NEAR // 2 <= len(at) <= 4 * NEAR:
                    k = min(NEAR, len(ids) - 1)
                    best = np.argpartition(mean[r], k)
                    at, end = best[:k], mean[r, best[k]]
                if np.isinf(end):  # all are listed
                    end = 2 * mean[r, at].max() + 1
                sums = total[r, at]
                self.lists[g] = ids[at], sizes[at], np.sqrt(sums) if squared else sums, np.ones(len(at), bool)
                self.bound[g] = np.sqrt(end) if squared else end / self.size[g]

        for g in asked:
            if g in self.sums:
                self.add_up(g)
                keep(np.array([g]), np.bincount(self.label, self.sums[g], len(self.label))[ids][None])
        rest, begin = [g for g in asked if g not in self.sums], 0
        y = self.right[np.concatenate([self.members[i] for i in ids.tolist()])].T if rest else None
        while begin < len(rest):
            end, taken = begin + 1, self.size[rest[begin]]
            while end < len(rest) and taken + self.size[rest[end]] <= rows:
                taken += self.size[rest[end]]
                end += 1
            some = np.array(rest[begin:end])
            own, begin = np.concatenate([self.members[g] for g in some.tolist()]), end
            squared = plain and len(own) == len(some)
            total = totals[: len(some)]
            if not squared:
                total[:] = 0
            ends = np.cumsum(self.size[some])
            for i in range(0, len(own), rows):
                part = self.left[own[i : i + rows]]
                far = np.matmul(part, y, out=fars[: len(part)])
                np.maximum(far, 0, out=far)
                if squared:
                    total = far
                    break
                np.sqrt(far, out=far)
                for k in range(int(np.searchsorted(ends, i, "right")), int(np.searchsorted(ends, i + len(far) - 1, "right")) + 1):
                    lot = far[max(0, int(ends[k] - self.size[some[k]]) - i) : int(ends[k]) - i]
                    each = lot[0] if len(lot) == 1 else lot.sum(axis=0)
                    total[k, :single] += each[:single]
                    if not plain:
                        total[k, single:] += np.add.reduceat(each[single:], starts[single:] - single)
            keep(some, total, squared)

    def refresh(self, g: int) -> None:
        """A group's list by the groups of now: of grown ones, what is not listed is at the bound or beyond."""
        rows, sizes, low, sure = self.lists[g]
        now = self.label[rows]
        same = self.size[now] == sizes
        if same.all():
            return
        new = ~same
        ids, at = np.unique(now[new], return_inverse=True)
        grown = self.size[ids]
        more = np.bincount(at, low[new], len(ids)) + self.bound[g] * self.size[g] * (grown - np.bincount(at, sizes[new], len(ids)))
        self.lists[g] = tuple(map(np.concatenate, ((now[same], ids), (sizes[same], grown), (low[same], more), (sure[same], np.zeros(len(ids), bool)))))

    def nearest(self, g: int) -> tuple[float, int] | None:
        """(mean distance, group), or None where only a comparison with all tells."""
        if (f := self.found.get(g)) and self.size[f[1]] == f[2] and self.size[g] == f[3]:
            return f[:2]
        self.refresh(g)
        ids, sizes, low, sure = self.lists[g]
        mean = low / sizes / self.size[g]
        while True:
            least = min(mean[sure].min(initial=np.inf), self.bound[g])
            open_ = np.flatnonzero(~sure & (mean <= least))
            if not len(open_):
                break
            if len(open_) > 16:
                open_ = open_[np.argpartition(mean[open_], 8)[:8]]
            low[open_] = self.exact(g, ids[open_])
            mean[open_], sure[open_] = low[open_] / sizes[open_] / self.size[g], True
        left = mean <= self.bound[g]
        self.lists[g] = ids[left], sizes[left], low[left], sure[left]
        best = ids[sure & left & (mean == least)]
        if not len(best):
            return None
        j = int(best[self.first[best].argmin()])
        self.found[g] = float(least), j, int(self.size[j]), int(self.size[g])
        return self.found[g][:2]

    def merge(self, a: int, b: int) -> int:
        """The merged group has the name of the larger one, and a list of what is in either list."""
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.refresh(a)
        self.refresh(b)
        ids = np.unique(np.concatenate([self.lists[a][0], self.lists[b][0]]))
        ids = ids[(ids != a) & (ids != b)]
        low, sure, total = np.zeros(len(ids)), np.ones(len(ids), bool), self.size[a] + self.size[b]
        for g in (a, b):
            own, _, known, certain = self.lists[g]
            listed = (own != a) & (own != b)
            at = np.searchsorted(ids, own[listed])
            part, have = self.bound[g] * self.size[g] * self.size[ids], np.zeros(len(ids), bool)
            part[at], have[at] = known[listed], certain[listed]
            low += part
            sure &= have
        self.bound[a] = (self.bound[a] * self.size[a] + self.bound[b] * self.size[b]) / total
        mean = low / (total * self.size[ids])
        left = np.flatnonzero(mean < self.bound[a])
        if len(left) > 4 * NEAR:
            cut = np.argpartition(mean[left], 2 * NEAR)
            self.bound[a], left = mean[left[cut[2 * NEAR]]], left[cut[: 2 * NEAR]]
        self.lists[a] = ids[left], self.size[ids[left]], low[left], sure[left]
        one, other = self.members[a], self.members.pop(b)
        self.members[a] = np.concatenate([one, other] if self.first[a] < self.first[b] else [other, one])
        if total >= self.many:
            if a not in self.sums:
                self.sums[a], self.extra[a] = np.zeros(len(self.label)), one
            if b in self.sums:
                self.sums[a] = self.sums[a] + self.sums.pop(b)
                other = self.extra.pop(b)
            self.extra[a] = np.concatenate([self.extra[a], other])
            if len(self.extra[a]) >= 64:
                self.add_up(a)
        self.label[self.members[a]] = a
        self.size[a], self.size[b], self.first[a] = total, 0, min(self.first[a], self.first[b])
        del self.lists[b]
        self.found.pop(b, None)
        return a

    def matrix(self) -> tuple[np.ndarray, list[list[int]]]:
        """The mean distances of all groups, in the order of their first rows, and their members."""
        ids = np.array(sorted(self.members, key=lambda i: self.first[i]))
        out, sizes = np.zeros((len(ids), len(ids))), self.size[ids]
        for k, g in enumerate(ids.tolist()):
            if g in self.sums:
                self.add_up(g)
                out[k] = out[:, k] = np.bincount(self.label, self.sums[g], len(self.label))[ids]
        small = np.array([k for k, g in enumerate(ids.tolist()) if g not in self.sums], np.int64)
        rows = np.concatenate([self.members[g] for g in ids[small].tolist()]) if len(small) else small
        ends = np.cumsum(sizes[small])
        starts, most, begin = ends - sizes[small], max(1, BLOCK // 8 // len(self.label)), 0
        while begin < len(small):  # each pair once
            end = max(begin + 1, int(np.searchsorted(ends, starts[begin] + most, "right")))
            far = self.far(rows[starts[begin] : ends[end - 1]], rows[starts[begin] :])
            far = np.add.reduceat(np.add.reduceat(far, starts[begin:] - starts[begin], axis=1), starts[begin:end] - starts[begin], axis=0)
            out[np.ix_(small[begin:end], small[begin:])] = far
            out[np.ix_(small[begin:], small[begin:end])] = far.T
            begin = end
        out /= sizes[:, None]
        out /= sizes
        return out, [self.members[g].tolist() for g in ids.tolist()]


def linkage_of_rows(x: np.ndarray) -> list[int]:
    """average_linkage() of the Euclidean distances of the rows of ``x``, in memory that grows with the rows and not their square.

    Of more than MATRIX rows, those that are alike are groups to begin with. Chains from group to nearest group end at two that
    merge, or at a group that has to be compared with all; PENDING of these are compared at once. The rest's matrix is small.
    """
    groups = [[i] for i in range(len(x))]
    if len(x) > MATRIX:
        _, alike = np.unique(x, axis=0, return_inverse=True)
        alike = alike.ravel()
        groups = sorted((g.tolist() for g in np.split(np.argsort(alike, kind="stable"), np.cumsum(np.bincount(alike))[:-1])), key=lambda g: g[0])
    if not groups:
        return []
    lists = Lists(x, groups)
    if len(groups) > MATRIX:
        lists.compare([g[0] for g in groups])
    pending: set[int] = set()
    starts, chain = iter(list(lists.members)), []
    while len(lists.members) > MATRIX:
        if not chain:
            start = next((i for i in starts if i in lists.members and i not in pending), None)
            if start is None or len(pending) >= PENDING:
                lists.compare(sorted(pending))
                pending.clear()
            if start is None:
                starts = iter(list(lists.members))
                continue
            chain = [start]
        a = chain[-1]
        near = None if a in pending else lists.nearest(a)
        if near is None and a in lists.sums:
            lists.compare([a])
        elif near is None:
            pending.add(a)
            chain = []
        elif len(chain) > 1 and (near[1] in chain or near[0] >= lists.found[chain[-2]][0]):  # a ring has equal distances, rounded apart
            lists.merge(a, chain[-2])
            del chain[-2:]
        else:
            chain.append(near[1])
    return average_linkage(*lists.matrix())


def cluster_rows(profiles: DataFrame, by: str) -> DataFrame:
    """(by, node, position): the nodes of each group in the order of average linkage of Euclidean distances.

    A patient's profiles lie in one task, and a bounded part of their distances at a time. Its time grows with the square of their number,
    so patients are dealt to GROUP_PARTS partitions, which are not put together for being small: few share a task.
    """

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        table = frame.pivot(index="node", columns="channel", values="share").fillna(0.0).sort_index()
        x = table.to_numpy()
        order = linkage_of_rows(x)
        return pd.DataFrame({by: frame[by].iloc[0], "node": table.index[order], "position": range(len(order))})

    kind = profiles.schema[by].dataType.simpleString()
    rows = profiles.select(by, "node", "channel", "share").repartition(GROUP_PARTS, by)
    return rows.groupBy(by).applyInPandas(kernel, f"{by} {kind}, node string, position int")
