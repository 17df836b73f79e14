import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeweft.llm import collocations as module
from treeweft.llm.collocations import collocations, score_of


def plain(rows, max_n, least, most, subsumed):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, max_n + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = {}
    for (lang, p), a in counts.items():
        if len(p) < 2 or a < least:
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        inside = (
            q for (other, q), b in counts.items()
            if other == lang and len(q) > len(p) and b >= least and 100 * b >= subsumed * a
            and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        )
        if not any(True for _ in inside):
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    out = []
    for lang, rows_ in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("max_n", "least", "most", "subsumed", "broad"), [(5, 4, 2000, 100, 1 << 20), (5, 3, 7, 60, 0), (2, 2, 50, 100, 0), (3, 5, 50, 90, 0)])
def test_collocations(spark, monkeypatch, max_n, least, most, subsumed, broad):
    monkeypatch.setattr(module, "BROADCAST_BYTES", broad)
    monkeypatch.setattr(module, "AT_ONCE_BYTES", 500)
    g = np.random.default_rng(least)
    words = ["The", "of", "a", "é", "É", "\x85", "new", "York", "x", "\x1c", "#"]
    fixed = ["new york city hall is", "of the a", "x x x x"]
    rows = []
    for i in range(120):
        held = [str(g.choice(fixed)) if g.random() < 0.3 else str(g.choice(words)) for _ in range(int(g.integers(0, 30)))]
        gaps = g.choice([" ", "  ", "\t", ". ", "\n", "\x0b", ", "], len(held), p=[0.8, 0.05, 0.05, 0.04, 0.02, 0.02, 0.02])
        rows.append((["en", "de", None, "und", ""][g.integers(5)], "".join(w + s for w, s in zip(held, gaps, strict=True))))
    rows += [("en", None), (None, None), ("fr", ""), ("fr", " .\n"), rows[0], rows[0]]
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(4)
    found = collocations(frame, max_n=max_n, least=least, most=most, subsumed=subsumed)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(tuple(r) for r in found.collect())
    assert got == plain(rows, max_n, least, most, subsumed) and got


def test_empty_and_long(spark):
    frame = spark.createDataFrame([("en", "a b " * 50000)], "lang string, text string")
    got = sorted(tuple(r) for r in collocations(frame).collect())
    assert got == plain([("en", "a b " * 50000)], 5, 100, 2000, 100)
    assert collocations(frame.limit(0)).count() == 0


def test_score_is_exact(spark):
    """Products of more than 64 bits."""
    rows = [(10**13, 10**17, 3 * 10**14, 7 * 10**13), (100, 123456789, 101, 307), (10**12 + 1, 10**16 + 7, 10**12 + 9, 10**12 + 3)]
    frame = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [r[0] for r in frame.select(score_of(*map(F.col, "anlr"))).collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in rows]
