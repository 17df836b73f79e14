from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from treeweft.llm.audit import NUMBERS, Walk, interactions, swaps, text_mask


def test_swaps_visit_every_order_once():
    for n in range(6):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert len(seen) == len(swaps(n)) + 1 == len(list(permutations(range(n))))


def plain(cells):
    """Numbers by (order, step) from {mask: (n, good, toxic)}, each order by itself."""
    out, shapley = {}, [0] * 5
    for order in permutations(range(5)):
        left = dict(cells)
        for step, f in enumerate(order):
            fail = {m: c for m, c in left.items() if m >> f & 1}
            left = {m: c for m, c in left.items() if m not in fail}
            total = [sum(c[i] for c in fail.values()) for i in range(3)]
            redundant = sum(c[0] for m, c in cells.items() if m >> f & 1) - total[0]
            unique = cells.get(1 << f, (0, 0, 0))[0]
            shapley[f] += total[0]
            out["".join("ABCDE"[i] for i in order), step + 1] = [sum(c[0] for c in left.values()), total[0], redundant, unique, *total[1:]]
    return {k: (*v, shapley["ABCDE".index(k[0][k[1] - 1])]) for k, v in out.items()}


@settings(max_examples=20, deadline=None)
@given(st.dictionaries(st.integers(0, 31), st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(0, 9)), max_size=12))
def test_walk(cells):
    table = np.zeros((1, 32, 3), dtype=np.int64)
    for m, c in cells.items():
        table[0, m] = c
    names, _, numbers = Walk(table).rows()
    got = {(name, s + 1): tuple(numbers[0, o, s].tolist()) for o, name in enumerate(names) for s in range(5)}
    assert got == plain(cells)


def test_masks():
    words = " ".join(f"w{i}" for i in range(200))
    assert text_mask(b"") == 1
    assert text_mask(words.encode()) == 0 and text_mask(words[:-5].encode()) == 1
    assert text_mask(b" ".join([b"x", b"y"] * 100)) == 2 and text_mask(b"\t".join([b"a"] * 2)) == 1
    assert text_mask(b"a a a") == 1 | 2
    assert text_mask(("é" * 97 + "ABC").encode()) == 1 and text_mask(("é" * 96 + "ABC").encode()) == 1 | 4
    assert text_mask((words + "|").encode()) == 8 and text_mask("\x1c\x85 ".encode()) == 1


def test_interactions(spark):
    long_ = " ".join(f"w{i}" for i in range(220))
    rows = [(i, long_, "en") for i in (5, 3, 3, 9)] + [(3, long_, "de"), (None, long_, "en"), (None, long_, None)]
    rows += [(20 + i, t, lang) for i, (t, lang) in enumerate([(None, None), ("", ""), ("A B", "en"), ("#", "en"), (long_ + " $", None), ("A B", "fr")])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n long, mask string")
    labels = spark.createDataFrame(
        [(3, 1, 0), (3, 0, 1), (5, 1, None), (9, None, 1), (22, 0, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int"
    )
    good, toxic = {3, 5}, {3, 9, 22}
    cells = {}
    for i, text, lang in rows:
        e = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in rows)
        mask = text_mask((text or "").encode()) | e << 4
        cell = cells.setdefault(lang or "", {}).setdefault(mask, [0, 0, 0])
        for k, said in enumerate((True, i in good, i in toxic)):
            cell[k] += said
    found = interactions(frame.repartition(3), labels).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in NUMBERS) for r in found}
    want = {(p, *k): v for p, c in cells.items() for k, v in plain({m: tuple(x) for m, x in c.items()}).items()}
    assert len(found) == len(got) and got == want
    assert interactions(frame.limit(0), labels).count() == 0
    without = interactions(frame, labels.limit(0))
    assert without.count() == len(want) and without.agg({"good_lost": "sum"}).head()[0] == 0
