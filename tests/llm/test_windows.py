import zlib
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from treeweft.llm.windows import RoomTree, best_fit_decreasing, is_power, pack_windows, parts_of, planned

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.booleans()), max_size=40), st.integers(0, 40))
def test_tightest_room(changes, need):
    tree, held = RoomTree(40), []
    for room, put in changes:
        if put or room not in held:
            held.append(room)
            tree.change(room, 1)
        else:
            held.remove(room)
            tree.change(room, -1)
    assert tree.tightest(need) == min((r for r in held if r >= need), default=None)


def plain_best_fit(counts, capacity):
    windows = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [w for w in windows if capacity - sum(w) >= n]
        if fits:
            min(fits, key=lambda w: capacity - sum(w)).append(n)
        else:
            windows.append([n])
    return windows


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 30)))
def test_best_fit_decreasing(counts):
    found = best_fit_decreasing(counts, 30)
    held = {}
    for pattern, times in found:
        assert times > 0 and 0 < sum(pattern) <= 30
        for n in pattern:
            held[n] = held.get(n, 0) + times
    assert held == {n: c for n, c in counts.items() if c}
    # as many windows as best fit makes one by one (ties between windows of equal room may go either way)
    assert abs(sum(t for _, t in found) - len(plain_best_fit(counts, 30))) <= 1


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 20)), st.booleans())
def test_plan_places_every_token_once(counts, close):
    plan = planned(best_fit_decreasing(counts, 30), 30, close)
    taken, cuts = {}, 0
    for n, c in counts.items():
        for k in range(c):
            parts = parts_of(plan, n, k)
            assert [p[0] for p in parts] == [0, *(p[1] for p in parts[:-1])] and parts[-1][1] == n
            cuts += len(parts) - 1
            for a, b, window, offset in parts:
                taken.setdefault(window, []).append((offset, b - a))
    for held in taken.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *(n for _, n in held)]).tolist()[:-1] and sum(n for _, n in held) <= 30
    assert sorted(taken) == list(range(plan.windows))
    if close:
        assert all(is_power(size) or size == 30 for size in (sum(n for _, n in h) for h in taken.values()))
    else:
        assert cuts == 0


@pytest.mark.parametrize("close", [True, False])
def test_windows(spark, close):
    library = Tokenizer.from_file(PATH)
    rows = [(1, None, 5), (2, "word " * 40, 5), (2, "word " * 40, 5), (3, "b", 5), (4, "c d e", 5), (None, "z", 5)]
    rows += [(10 + i, "x y " * i + "é", 5) for i in range(9)] + [(50 + i, "a b c d e f", 1) for i in range(7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, length int")
    found = pack_windows(frame.repartition(3), PATH, capacity=16, close=close, with_ids=True).collect()
    texts, by, pieces = {i: t for i, t, _ in rows}, {}, {}
    for r in found:
        ids = np.array([*library.encode(texts[r["doc_id"]] or "").ids, 1], dtype="<u4")
        assert r["ids"] == ids[r["start"] : r["start"] + r["length"]].tolist() and r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for spots in by.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 16 and (not close or is_power(at))
    copies = {i: sum(j == i for j, *_ in rows) for i, *_ in rows}
    for i, spots in pieces.items():
        covered = np.zeros(400, dtype=int)
        for start, length in spots:
            covered[start : start + length] += 1
        n = len(library.encode(texts[i] or "").ids) + 1
        assert (covered[:n] == copies[i]).all() and not covered[n:].any()
    light = pack_windows(frame, PATH, capacity=16, close=close)
    assert light.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert light.agg({"length": "sum"}).head()[0] == sum(r["length"] for r in found)
    assert pack_windows(frame.limit(0), PATH).count() == 0


def test_all_documents_of_one_awkward_length():
    """Best fit alone would leave a quarter of each window empty."""
    plan = planned(best_fit_decreasing({1500: 1000}), 2048, True)
    sizes = {}
    for k in range(1000):
        for a, b, window, _ in parts_of(plan, 1500, k):
            sizes[window] = sizes.get(window, 0) + b - a
    assert sum(sizes.values()) == 1_500_000 and all(is_power(n) for n in sizes.values())
    assert len(sizes) <= 1_500_000 // 2048 + 11


def test_few_lengths_are_optimal():
    for pair in combinations_with_replacement(range(9, 17), 2):
        counts = {n: pair.count(n) for n in pair}
        assert sum(t for _, t in best_fit_decreasing(counts, 32)) == 1
