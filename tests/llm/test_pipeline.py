"""The pipeline against a plain version of each stage, over all documents of the smallest tables and odd ones."""

import hashlib
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from test_near import plain_kept
from treeweft.llm import lines, quality

TABLES = "/root/testdata/sf0.001"


def plain_lines(rows):
    """Lines without white space around them: earlier equal ones, and from 20 characters on those one edit away."""
    seen, by_size, out = set(), {}, []
    for row in rows:
        kept = []
        for line in (row["text"] or "").split("\n"):
            x = line.strip(lines.BLANK)
            n = len(x)
            near = n >= 20 and any(lines.one_edit(x, y) for m in (n - 1, n, n + 1) for y in by_size.get(m, ()) if x != y and min(n, m) >= 20)
            if not x or not (x in seen or near):
                kept.append(line)
            if x and x not in seen:
                seen.add(x)
                by_size.setdefault(n, []).append(x)
        text = "\n".join(kept)
        if text.strip() or text == (row["text"] or ""):
            out.append({**row, "text": text, "n_chars": len(text)})
    return out


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level >= 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    return target


def plain_mixture(rows):
    by = {}
    for row in rows:
        h = int(hashlib.md5(str("" if row["doc_id"] is None else row["doc_id"]).encode()).hexdigest()[:15], 16)
        by.setdefault(row["source"], []).append((h, len((row["text"] or "").encode().split()), row))
    target = plain_targets({s: sum(n for _, n, _ in found) for s, found in by.items()})
    out = []
    for source, found in by.items():
        size = sum(n for _, n, _ in found)
        base = int(target[source] >= size)
        left, taken = target[source] - size * base, 0
        found.sort(key=lambda x: x[0])
        for _, n, row in found:
            more = taken < left and 2 * (left - taken) >= n
            taken = taken + n if more else np.inf
            out += [row] * (base + more)
    return out


def test_pipeline_equals_plain_stages(spark, monkeypatch):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    rows = [r.asDict() for r in docs.orderBy("doc_id").collect()]
    assert len({r["doc_id"] for r in rows}) == len(rows)
    kept = [r for r, s in zip(rows, model.score([r["text"] or "" for r in rows]), strict=True) if s >= 0.3]
    stages = [sorted(map(repr, (r["doc_id"] for r in kept)))]
    kept = plain_lines(kept)
    stages.append(sorted(repr((r["doc_id"], r["text"], r["n_chars"])) for r in kept))
    firsts = plain_kept([(r["doc_id"], r["text"]) for r in kept])
    kept = [r for r in kept if r["doc_id"] in firsts]
    stages.append(sorted(repr(r["doc_id"]) for r in kept))
    kept = plain_mixture(kept)
    stages.append(sorted(repr(r["doc_id"]) for r in kept))
    assert len(set(map(len, stages))) > 2
    found = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], stages, strict=True):
        found = stage(spark, found, TABLES)
        columns = ("doc_id", "text", "n_chars") if name == "lines" else ("doc_id",)
        got = [r[0] if len(r) == 1 else tuple(r) for r in found.select(*columns).collect()]
        assert sorted(map(repr, got)) == want, name
    from tokenizers import Tokenizer

    library, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for r in kept:
        ids = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 0], dtype="<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        pieces += [(r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    result = corpus_pipeline.run(spark, TABLES).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in result) == sorted(pieces)
    spots = {}
    for r in result:
        spots.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in spots.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *(n for _, n in held)]).tolist()[:-1] and sum(n for _, n in held) <= 2048
    assert len(spots) <= 1.05 * sum(n for *_, n, _ in pieces) / 2048 + 1


def test_query_scores_like_the_model(spark):
    """op10 over whole texts, by one score at a time."""
    from treeweft.llm.queries import op10_quality

    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs.select("doc_id", "text"), labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found = op10_quality(spark, TABLES).collect()
    assert len(found) == len(texts)
    for r in found:
        want = float(model.score([texts[r["doc_id"]]])[0])
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == int(want >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_fit_takes_whole_texts_and_no_more_lines_than_told(spark, monkeypatch):
    rows = [(i, "\n".join(f"line {i} {k}" for k in range(90))) for i in range(1, 30)]
    frame = spark.createDataFrame([*rows, rows[3], (rows[3][0], "another text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    sizes = []
    monkeypatch.setattr(quality.Field, "fit", lambda self, own, counts, good, each: sizes.append(counts.tolist()))
    quality.fit_quality(frame, labels)
    learnt = frame.filter(quality.fold_of("doc_id") != 0).select("doc_id").distinct().count()
    assert len(sizes[0]) == learnt and set(sizes[0]) <= {90, 1}
    monkeypatch.setattr(quality, "MAX_LINES", 300)
    quality.fit_quality(frame.filter(F.col("text") != "another text"), labels)
    assert sizes[1] == [90, 90, 90]
