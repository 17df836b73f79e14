"""Suffix arrays by linear grouping, without renaming or recursion.

Suffixes are grouped by the prefix known of them, first one symbol. Groups are taken in descending order. Each
suffix of the group at hand points to the nearest suffix before it whose group is lower; that suffix's known prefix
ends where the group's suffix begins, so it grows by the group's prefix, once for each pointer that meets it, and
the suffixes that grow leave their group for new ones just above it. When all groups are done they stand for the
Lyndon prefixes, in order. Suffix i-1, its pointer's target and so on are the suffixes whose Lyndon prefix ends
before i: taking i in ascending order and giving each of them the next place of its group yields the array.

``sort_lanes`` runs many small texts side by side, one group of each at a time; ``sort_one`` takes a large one.
"""

from __future__ import annotations

import numpy as np


def sort_one(text: list[int]) -> list[int]:
    """The starts of the text's suffixes in ascending order."""
    n = len(text)
    sa = sorted(range(n), key=text.__getitem__)
    group, size, place = [0] * n, [0] * n, [0] * n
    start = 0
    for k, i in enumerate(sa):
        if text[i] != text[sa[start]]:
            start = k
        group[i], place[i] = start, k
        size[start] += 1
    prev = [-1] * n
    end = n
    while end:
        g = group[sa[end - 1]]
        met: dict[int, int] = {}
        members = sa[g:end]
        members.sort()  # a pointer into the group itself is then known already
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                met[j] = met.get(j, 0) + 1
        end = g
        moved: dict[int, list[tuple[int, int]]] = {}
        for j, c in met.items():
            moved.setdefault(group[j], []).append((c, j))
        for q, found in moved.items():
            found.sort(reverse=True)
            top = q + size[q]
            size[q] -= len(found)
            for k, (c, j) in enumerate(found):
                top -= 1
                other, hole = sa[top], place[j]
                sa[hole], place[other] = other, hole
                sa[top], place[j] = j, top
                if k + 1 == len(found) or found[k + 1][0] != c:  # the lowest place of those that grew alike
                    first = k
                    while first and found[first - 1][0] == c:
                        first -= 1
                    for _, x in found[first : k + 1]:
                        group[x] = top
                    size[top] = k + 1 - first
    return emit_one(n, group, prev)


def emit_one(n: int, group: list[int], prev: list[int]) -> list[int]:
    out, free, placed = [-1] * n, {}, [False] * n
    for k in range(-1, n):
        i = n if k < 0 else out[k]
        j = i - 1
        while j >= 0 and not placed[j]:
            at = free.get(group[j], group[j])
            out[at], free[group[j]], placed[j] = j, at + 1, True
            j = prev[j]
    return out


def sort_lanes(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(flat, order): the texts one after another, each behind a guard of -1, and for each slot of ``flat`` that a
    text takes, the place in ``flat`` of its suffix of that rank; -1 for guards."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    base = np.cumsum(sizes + 1) - sizes
    total = int((sizes + 1).sum())
    flat = np.full(total + 1, -1, dtype=np.int64)
    lane = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(int(sizes.sum())) + lane + 1
    if not len(inside):
        return flat[:total], flat[:total].copy()
    flat[inside] = np.concatenate(texts)
    width = int(flat.max()) + 2
    by = np.argsort(lane * width + flat[inside], kind="stable")
    sa = np.full(total + 1, -1, dtype=np.int64)
    sa[inside] = inside[by]
    place = np.full(total + 1, -1, dtype=np.int64)
    place[sa[inside]] = inside
    keys = (lane * width + flat[inside])[by]
    first = np.r_[True, keys[1:] != keys[:-1]]
    starts = inside[first]
    size = np.zeros(total + 1, dtype=np.int64)
    size[starts] = np.diff(np.r_[np.flatnonzero(first), len(keys)])
    group = np.full(total + 1, -1, dtype=np.int64)
    group[sa[inside]] = np.repeat(starts, size[starts])
    prev = np.arange(-1, total)
    end, live = base + sizes, np.flatnonzero(sizes)
    taken = np.zeros(total + 1, dtype=bool)
    while len(live):
        stop = end[live]
        g = group[sa[stop - 1]]
        wide = stop - g
        slots = np.repeat(g - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
        members, own = sa[slots], np.repeat(g, wide)
        near = members - 1
        prev[members] = near
        todo = np.flatnonzero(group[near] >= own)
        while len(todo):  # past higher groups, and past the group itself, whose pointers shorten meanwhile
            near[todo] = prev[near[todo]]
            prev[members[todo]] = near[todo]
            todo = todo[group[near[todo]] >= own[todo]]
        end[live] = g
        live = live[g > base[live]]
        met = near[group[near] >= 0]
        if not len(met):
            continue
        met.sort()
        edge = np.flatnonzero(np.r_[True, met[1:] != met[:-1]])
        grown, times = met[edge], np.diff(np.r_[edge, len(met)])
        q = group[grown]
        order = np.lexsort((times, q))
        grown, times, q = grown[order], times[order], q[order]
        edge = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        count = np.diff(np.r_[edge, len(q)])
        heads = q[edge]
        low = heads + size[heads] - count
        target = np.repeat(low - edge, count) + np.arange(len(q))
        taken[grown] = True
        there = sa[target]
        out = there[~taken[there]]
        hole = place[grown]
        hole = hole[hole < np.repeat(low, count)]
        taken[grown] = False
        sa[hole], place[out] = out, hole
        sa[target], place[grown] = grown, target
        size[heads] -= count
        edge = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (times[1:] != times[:-1])])
        runs = np.diff(np.r_[edge, len(q)])
        size[target[edge]] = runs
        group[grown] = np.repeat(target[edge], runs)
    # emission, one suffix of each text at a time
    order = np.full(total + 1, -1, dtype=np.int64)
    free = np.arange(total + 1)
    placed = np.zeros(total + 1, dtype=bool)
    placed[base - 1] = True
    placed[total] = True
    at = base + sizes
    by_size = np.argsort(-sizes, kind="stable")
    going = np.searchsorted(-sizes[by_size], -np.arange(int(sizes.max(initial=0)) + 1), side="right")
    for k in range(int(sizes.max(initial=0)) + 1):
        some = by_size[: going[k]] if k else by_size
        if k:
            at_k = order[base[some] + k - 1]
        else:
            at_k = at[some]
        j = at_k - 1
        j = j[~placed[j]]
        while len(j):
            spot = free[group[j]]
            order[spot] = j
            free[group[j]] = spot + 1
            placed[j] = True
            j = prev[j]
            j = j[~placed[j]]
    return flat[:total], order[:total]
