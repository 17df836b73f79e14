import hashlib
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeweft.llm import components as module
from treeweft.llm import hnsw, lines, mixing, quality, substrings, tiff
from treeweft.llm.components import components
from treeweft.llm.fingerprint import simhash
from treeweft.llm.mixing import mix, mixed
from treeweft.llm.simhash import close_pairs, keep_first, near_duplicates
from treeweft.llm.substrings import dedup_substrings, digest
from treeweft.llm.suffixes import sort_lanes, sort_one


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id long, text string{extra}")


# ---- fingerprints


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in found]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB É\t\n\x1c\x85", max_size=60))
def test_simhash(text):
    assert simhash(text) == plain_simhash(text)


def test_long_simhash():
    text = " ".join(f"w{i % 977}" for i in range(40000))
    assert simhash(text) == plain_simhash(text)


def test_close_pairs_and_components(spark):
    g = np.random.default_rng(0)
    base = g.integers(0, 2**63, 40)
    fps = set(base.tolist())
    for x in base[:30].tolist():
        for _ in range(4):
            for b in g.choice(63, g.integers(1, 5), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    fps |= {0, 1, 7, 15, -1, -2}
    fps = sorted(fps)
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert {tuple(r) for r in close_pairs(frame).distinct().collect()} == want
    root = {x: x for x in fps}
    for _ in fps:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for p in want for x in p}
    found = {r["node"]: r["label"] for r in components(close_pairs(frame)).collect()}
    assert found == {x: root[x] for x in linked}


def test_long_chain(spark):
    order = np.random.default_rng(1).permutation(300).tolist()
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(5, 5), (None, 1)], "a long, b long")
    assert {r["label"] for r in components(edges).collect()} == {0}
    assert components(edges.filter("a < 0")).count() == 0


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """An ascending path, a star whose centre is its largest node, and a descending path beside them."""
    edges = [(k, k + 1) for k in range(300)] + [(9000, 1000 + k) for k in range(50)] + [(8000 - k, 7999 - k) for k in range(60)]
    tables = []
    kept = module.stored
    monkeypatch.setattr(module, "stored", lambda df, name, **more: (tables.append(name), kept(df, name, **more))[1])
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(301), 0), **dict.fromkeys([*range(1000, 1050), 9000], 1000), **dict.fromkeys(range(7940, 8001), 7940)}
    assert 2 <= tables.count("edges") - 1 <= 9


def test_near_duplicates(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(4, text, 1), (2, text.upper(), 2), (9, "quite another text with nothing shared", 3), (7, None, 4), (8, "  ", 5), (None, "x y", 6), (2, text, 7)]
    frame = docs(spark, rows, ", fp int")
    found = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in near_duplicates(frame).collect()}
    fp = f"{plain_simhash(text):016x}"
    assert {(4, fp, 2), (2, fp, 2), (7, "0" * 16, 7), (8, "0" * 16, 7)} <= found and len(found) == 6
    assert {r["doc_id"] for r in keep_first(frame).collect()} == {2, 9, 7, None}
    assert near_duplicates(docs(spark, [])).count() == 0


# ---- lines


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab", max_size=6), st.text(alphabet="ab", max_size=6))
def test_one_edit(a, b):
    if a != b:
        near = {a[:i] + a[i + 1 :] for i in range(len(a))}
        near |= {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "ab"} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "ab"}
        assert lines.one_edit(a, b) == (b in near)


@pytest.mark.parametrize("most", [lines.MOST_KEYS, 0])
@pytest.mark.parametrize("fuzzy", [1, 5, 16])
def test_short_lines(spark, monkeypatch, most, fuzzy):
    """Edits of short lines, about the length from which on lines have parts, against brute force."""
    monkeypatch.setattr(lines, "MOST_KEYS", most)
    g = np.random.default_rng(fuzzy)
    found = [["".join(g.choice(list("ab"), g.integers(1, 4))) for _ in range(12)]]
    for n in (5, 14, 15, 16, 17, 18, 40):
        base = "".join(g.choice(list("abc"), n))
        found.append([base[:k] + x + base[k + d :] for k, x, d in zip(g.integers(0, n, 9), "xyxyxy  x", [0, 1, 1] * 3, strict=True)] + [base])
    pool = [x.strip() for f in found for x in f]
    rows = [(i, "\n".join(g.choice(pool, 4))) for i in range(60)]
    seen, want = [], []
    for i, t in rows:
        kept = []
        for x in t.split("\n"):
            if not x or not any(x == y or (min(len(x), len(y)) >= fuzzy and lines.one_edit(x, y)) for y in seen):
                kept.append(x)
            if x:
                seen.append(x)
        want.append((i, "\n".join(kept)))
    got = sorted((r["doc_id"], r["text"]) for r in lines.dedup_lines(docs(spark, rows), fuzzy=fuzzy).collect())
    assert got == want


def test_many_lines_in_one_document(spark):
    """Time in proportion to the lines that go: a million at once."""
    rows = [(1, "the same line each time\n" * 1_000_000), (2, "another\nthe same line each time")]
    began = time.monotonic()
    got = dict(lines.dedup_lines(docs(spark, rows)).collect())
    assert got == {1: "the same line each time\n", 2: "another"} and time.monotonic() - began < 60


@pytest.mark.parametrize("most", [lines.MOST_KEYS, 0])
def test_lines(spark, monkeypatch, most):
    """By the table of keys, and by joins beyond its size."""
    monkeypatch.setattr(lines, "MOST_KEYS", most)
    g = np.random.default_rng(5)
    letters = list("abc deé")

    def some():
        return "".join(g.choice(letters, g.integers(18, 60))).strip()

    base = [some() for _ in range(25)]

    def edit(x):
        i, k = int(g.integers(len(x))), int(g.integers(4))
        return [x[:i] + "x" + x[i + 1 :], x[:i] + x[i + 1 :], x[:i] + "y" + x[i:], x][k]

    rows = []
    for i in range(120):
        held = [edit(base[g.integers(25)]) for _ in range(g.integers(0, 6))] + [["", "  ", "ab", "ac"][g.integers(4)]]
        rows.append((i, "\n".join(held), "own"))
    rows += [(None, base[0], "own"), (7, rows[7][1], "twin"), (7, "other\n" + base[3], "own"), (500, None, "own"), (501, "", "own")]
    frame = docs(spark, rows, ", n_near string").repartition(5)
    texts = sorted({t or "" for _, t, _ in rows})
    th = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t")).collect()}
    every = []
    for i, t, _ in rows:
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(lines.BLANK):
                every.append(((-1 if i is None else i, th[t or ""], k), line.strip(lines.BLANK)))
    want = []
    for i, t, _ in rows:
        keep, exact, near = [], 0, 0
        for k, line in enumerate((t or "").split("\n")):
            x, at = line.strip(lines.BLANK), (-1 if i is None else i, th[t or ""], k)
            before = [y for p, y in every if p < at]
            if x and x in before:
                exact += 1
            elif x and any(min(len(x), len(y)) >= lines.MIN_FUZZY and x != y and lines.one_edit(x, y) for y in before):
                near += 1
            else:
                keep.append(line)
        want.append((i, "\n".join(keep), len((t or "").split("\n")), exact, near))
    found = [tuple(r) for r in lines.dedup_lines(frame, counts=True).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert lines.dedup_lines(frame).columns == ["doc_id", "text", "n_near"]
    assert lines.dedup_lines(docs(spark, [])).count() == 0


# ---- substrings


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=30), min_size=1, max_size=8))
def test_suffix_arrays(texts):
    def plain(t):
        return sorted(range(len(t)), key=lambda i: t[i:])

    flat, order = sort_lanes([np.array(t, dtype=np.int64) for t in texts])
    at = 0
    for t in texts:
        assert sort_one(t) == plain(t)
        at += 1
        assert (order[at : at + len(t)] - at).tolist() == plain(t)
        at += len(t)


@pytest.mark.parametrize(("most", "many", "huge"), [(substrings.MOST_KEYS, 64, 8192), (0, 64, 8192), (substrings.MOST_KEYS, 4, 16)])
def test_substrings(spark, monkeypatch, most, many, huge):
    """By the table of anchors, by joins beyond its size, and with groups that count as large."""
    for name, value in (("MOST_KEYS", most), ("MANY", many), ("HUGE", huge)):
        monkeypatch.setattr(substrings, name, value)
    g = np.random.default_rng(8)

    def some(n):
        return "".join(g.choice(list("abcdefg é"), n))

    shared = [some(n) for n in (99, 100, 101, 150, 400)]
    rows = []
    for i in range(60):
        text = some(g.integers(0, 150))
        for _ in range(g.integers(0, 3)):
            text += shared[g.integers(5)] + some(g.integers(0, 90))
        rows.append((i, text))
    rows += [(100, "ab" * 300), (101, rows[3][1]), (102, None), (103, "x" * 100), (104, "x" * 101), (-5, shared[4] * 2), (None, shared[3]), (200, rows[5][1]), (200, rows[5][1])]
    found = digest(dedup_substrings(docs(spark, rows, "").repartition(6))).collect()
    seen, want = set(), []
    for i, t in sorted(dict.fromkeys(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(raw[k : k + 100])
        n = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(raw, dtype=np.uint8)[~gone])
        want += [(i, len(raw), int(gone.sum()), n, hashlib.sha256(kept).hexdigest())] * rows.count((i, t))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert dedup_substrings(docs(spark, [])).count() == 0


def test_shared_strings_just_under_a_window(spark):
    """99 bytes are shared, and no window of 100: segments agree beside their anchor, and nothing goes."""
    g = np.random.default_rng(5)
    word = lambda n: "".join(map(chr, g.integers(97, 123, n)))
    shared = [word(99) for _ in range(60)]
    rows = [(2 * i + j, word(80) + "ABCD"[j] + x + "ABCD"[j] + word(80)) for i, x in enumerate(shared) for j in range(2)]
    found = digest(dedup_substrings(docs(spark, rows))).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found) == [
        (i, len(x), 0, 0, hashlib.sha256(x.encode()).hexdigest()) for i, x in rows
    ]


# ---- quality


def test_field_is_exact():
    g = np.random.default_rng(0)
    counts = np.array([3, 0, 1, 4])
    score, change = g.standard_normal(8), g.standard_normal((2, 2))
    total, p, pairs = quality.Lanes(counts).marginals(score, change)
    want_total, want_p, want_pairs, at = 0.0, np.zeros(8), np.zeros((2, 2)), 0
    for n in counts:
        if n:
            weights = {}
            for bits in range(2**n):
                y = [bits >> k & 1 for k in range(n)]
                weights[bits] = np.exp(sum(score[at + k] * y[k] for k in range(n)) + sum(change[a, b] for a, b in zip(y, y[1:], strict=False)))
            z = sum(weights.values())
            want_total += np.log(z)
            for bits, w in weights.items():
                y = [bits >> k & 1 for k in range(n)]
                want_p[at : at + n] += np.array(y) * w / z
                for a, b in zip(y, y[1:], strict=False):
                    want_pairs[a, b] += w / z
            at += n
    assert np.allclose([total], [want_total]) and np.allclose(p, want_p) and np.allclose(pairs, want_pairs)


def test_quality_on_held_out(spark):
    d = "/root/testdata/sf0.01"
    frame, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit_quality(frame, labels)
    rows = quality.with_score(frame, model).join(labels, "doc_id").withColumn("fold", quality.fold_of("doc_id")).collect()
    held = [r for r in rows if r["fold"] == 0]
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in held]) > 0.93
    assert np.mean([r["score"] >= 0.3 for r in held if r["quality"] == 1]) > 0.98
    kept = quality.keep_good(frame, labels)
    assert kept.columns == frame.columns and 0 < kept.count() < frame.count()


def test_quality_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n ", "c"), (4, "good text here\nand more", "d"), (4, "good text here\nand more", "d"), (None, "x" * 100000, "e")]
    frame = docs(spark, rows, ", score string")
    none = spark.createDataFrame([(None, 1), (2, None)], "doc_id long, quality int")
    assert quality.fit_quality(frame, none) is None
    assert {r["score"] for r in quality.with_score(frame, None).collect()} == {0.5}
    model = quality.fit_quality(frame, spark.createDataFrame([(4, 1), (1, 0), (2, 0)], "doc_id long, quality int"))
    found = quality.with_score(frame, model).collect()
    assert len(found) == 6 and all(0 <= r["score"] <= 1 for r in found)
    assert quality.with_score(frame.limit(0), model).count() == 0


def test_quality_passes_over_what_does_not_fit(spark, monkeypatch):
    """A labelled document over the bound on lines, first in turn, leaves the model as it is without it."""
    g = np.random.default_rng(4)
    rows = [(i, "\n".join("good words in a line" if i % 2 else "#$ 99 %% @@ !!" for _ in range(int(g.integers(1, 9))))) for i in range(1, 60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    learnt = [i for i, *_ in spark.createDataFrame(rows, "doc_id long, text string").filter(quality.fold_of("doc_id") != 0).collect()]
    first = min(learnt, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    monkeypatch.setattr(quality, "MAX_LINES", 1000)
    without = docs(spark, [r for r in rows if r[0] != first])
    long_ = docs(spark, [(i, "short\n" * 1001 if i == first else t) for i, t in rows])
    want = quality.fit_quality(without, labels)
    got = quality.fit_quality(long_, labels)
    texts = [t for _, t in rows]
    assert np.allclose(got.score(texts), want.score(texts), atol=1e-9) and np.ptp(got.score(texts)) > 0.8
    with pytest.raises(ValueError):
        quality.fit_quality(docs(spark, [(first, "short\n" * 1001)]), labels)


# ---- media


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [0, 16])
def test_tiff(compression, tile):
    g = np.random.default_rng(0)
    for predictor in (1, 2):
        images = [g.integers(0, k, (h, w, s)).astype(np.uint8) for k, h, w, s in ((256, 50, 33, 3), (3, 90, 64, 1), (2, 150, 150, 1))]
        found = list(tiff.pages(tiff.write(images, compression, predictor, rows=37, tile=tile)))
        assert [p.number for p in found] == [0, 1, 2] and all((p.pixels == i).all() for p, i in zip(found, images, strict=True))


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=400))
def test_codes(data):
    assert tiff.unpack_lzw(tiff.pack_lzw(data), len(data)) == data
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data


def test_both_byte_orders_are_one_image():
    """16 bits a sample, in the file's own order, come out alike."""
    import struct

    image = np.arange(48, dtype=np.uint16).reshape(4, 12) * 1000

    def file(order, mark):
        data = image.astype(f"{order}u2").tobytes()
        entries = [(256, 3, 12), (257, 3, 4), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 4), (279, 4, len(data))]
        fields = b"".join(struct.pack(f"{order}HHI", t, k, 1) + (struct.pack(f"{order}HH", v, 0) if k == 3 else struct.pack(f"{order}I", v)) for t, k, v in entries)
        return mark + struct.pack(f"{order}HI", 42, 8 + len(data)) + data + struct.pack(f"{order}H", len(entries)) + fields + bytes(4)

    found = [next(tiff.pages(file(o, m))) for o, m in (("<", b"II"), (">", b"MM"))]
    assert all((p.pixels[:, :, 0] == image).all() for p in found) and found[0].pixels.tobytes() == found[1].pixels.tobytes()


def test_inflated_strips_are_cut_short():
    import zlib

    assert tiff.unpack(zlib.compress(bytes(50_000_000)), tiff.DEFLATE, 100) == bytes(100)
    with pytest.raises(tiff.TiffError):
        tiff.unpack(zlib.compress(bytes(50))[:-6], tiff.DEFLATE, 50)


def test_long_lzw():
    data = np.random.default_rng(0).integers(0, 40, 60000).astype(np.uint8).tobytes()
    assert tiff.unpack_lzw(tiff.pack_lzw(data), len(data)) == data


def plain_feature(payload):
    """Of the gray rows of all pages: eight by eight cells, brighter than the mean or not."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, tiff.ROW).astype(int)
    bits = ""
    for i in range(8):
        band = rows[i * len(rows) // 8 : (i + 1) * len(rows) // 8]
        for j in range(8):
            cell = band[:, j * tiff.ROW // 8 : (j + 1) * tiff.ROW // 8]
            bits += "1" if cell.sum() * rows.size > rows.sum() * cell.size else "0"
    return f"p{-(-len(rows) // tiff.PAGE_ROWS)}_m{rows.mean():.3f}_g{int(bits, 2):016x}"


def test_media(spark):
    rows = [(1, None), (2, ""), (3, "x" * 576), (4, "é" * 400), (4, "é" * 400), (None, "ab" * 200000)]
    media = tiff.to_media(docs(spark, rows))
    found = tiff.media_digest(media).collect()
    texts = dict(rows)
    for r in found:
        payload = tiff.payload_of(texts[r["doc_id"]] or "")
        assert len(payload) % 576 == 0 and r["payload_bytes"] == len(payload) > 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) and r["tail_crc32"] == zlib.crc32(payload[-32:])
        stored = tiff.media_of(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"] == plain_feature(payload)
    pages = tiff.tiff_pages(media).collect()
    assert len(pages) == 7 and all(p["error"] is None for p in pages)
    whole = tiff.write([np.zeros((4, 4, 1), dtype=np.uint8)])
    circle = whole[:-4] + whole[4:8]
    bad = spark.createDataFrame([(1, None), (2, b""), (3, bytearray(whole[:40])), (4, bytearray(circle))], "doc_id long, media binary")
    errors = {r["doc_id"]: r["error"] for r in tiff.tiff_pages(bad).collect()}
    assert set(errors) == {2, 3, 4} and all(errors.values()) and "circle" in errors[4]
    assert tiff.tiff_pages(bad.limit(0)).count() == 0
    broken = {r["doc_id"]: r for r in tiff.media_digest(bad.withColumn("n_bytes", F.lit(1))).collect()}
    assert set(broken) == {1, 2, 3, 4} and all(r["payload_sha256"] is None and r["feature"] is None for r in broken.values())
    assert broken[1]["media_bytes"] is None and broken[3]["media_bytes"] == 40


# ---- nearest neighbours


def test_graph_recall():
    g = np.random.default_rng(0)
    x = hnsw.unit(g.standard_normal((2500, 16))).astype(np.float32)
    layers = hnsw.build(x)
    assert [len(v) for v in layers] == hnsw.layer_sizes(2500)
    found = hnsw.search(x, layers, x[:100])[0]
    best = np.argsort(-(x[:100] @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(found.tolist(), best.tolist(), strict=True)]) > 0.95


def test_nearest(spark):
    g = np.random.default_rng(1)
    v = g.standard_normal((300, 8)).tolist()
    rows = [(i, x, 0) for i, x in enumerate(v)] + [(1000 + i, v[0], 1) for i in range(40)]
    rows += [(2000, None, 0), (2001, [0.0] * 8, 0), (2002, [float("nan")] + [1.0] * 7, 0), (2003, [None] + [1.0] * 7, 0), (2004, [1.0, 2.0], 0), (2005, [], 0), (None, v[1], 0), (7, v[7], 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    found = hnsw.search_index(hnsw.build_index(frame), frame.filter("vec_id % 50 = 0")).collect()
    good = {i: np.array(x) for i, x, _ in rows if i is not None and i < 2000}
    for q in (i for i in good if i % 50 == 0):
        def cosine(i):
            return good[q] @ good[i] / np.linalg.norm(good[q]) / np.linalg.norm(good[i])

        want = sorted((-round(cosine(i), 12), i) for i in good if i != q)[:5]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [i for _, i, _ in got] == [i for _, i in want] and abs(got[0][2] + want[0][0]) < 1e-9
    assert not [r for r in found if r["query_id"] >= 2000]
    none = frame.limit(0)
    assert hnsw.search_index(hnsw.build_index(none), none).count() == 0


def test_shards_are_merged(spark, monkeypatch):
    """Several shards and blocks of queries against brute force: 120 multiples of one vector, copies, one id twice."""
    monkeypatch.setattr(hnsw, "QUERY_BYTES", 2000)
    g = np.random.default_rng(2)
    base = g.standard_normal((40, 12))
    v = (base[g.integers(0, 40, 3000)] + 0.5 * g.standard_normal((3000, 12))).astype(np.float32).astype(np.float64)
    one = v[0].astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(5000 + i, (one * np.float32(i + 1)).astype(np.float64).tolist()) for i in range(120)]
    rows += [(6000 + i, v[100].tolist()) for i in range(30)] + [(150, v[7].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    index = hnsw.build_index(frame, shard_size=700)
    assert index.select("shard").distinct().count() >= 4
    found = {}
    for r in hnsw.search_index(index, frame.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ids, units = np.array([i for i, _ in rows]), hnsw.unit(np.array([x for _, x in rows]))
    hits = total = 0
    for q in {i for i, _ in rows if i % 50 == 0}:
        own = min((x for i, x in rows if i == q))
        scores = np.round(np.einsum("nd,nkd->nk", hnsw.unit(np.array([own])), units[None])[0], hnsw.DIGITS)
        best = {}
        for i, c in zip(ids.tolist(), scores.tolist(), strict=True):
            if i != q:
                best[i] = max(c, best.get(i, -2))
        want = sorted((-c, i) for i, c in best.items())[:5]
        got = [i for i, _ in found[q]]
        hits, total = hits + len({i for _, i in want} & set(got)), total + 5
        if q in (0, 100, 5000, 5050, 6000):  # ties by the smaller id
            assert [(-c, i) for i, c in found[q]] == want, q
    assert hits / total >= 0.9 and len(found) == len({i for i, _ in rows if i % 50 == 0})
    with pytest.raises(ValueError):
        hnsw.search_index(index, frame, k=6)


def test_one_direction_is_one_score(spark, monkeypatch):
    """300 multiples of one vector by factors that aren't whole, whose cosines differ by rounding only."""
    g = np.random.default_rng(3)
    v, w = g.standard_normal((2, 16))
    rows = [(i, (v * (1 + 0.37 * i)).tolist()) for i in range(300)] + [(1000, w.tolist())]
    rows += [(2000 + i, x.tolist()) for i, x in enumerate(g.standard_normal((200, 16)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for size in (hnsw.SHARD_SIZE, 100):
        found = {}
        for r in hnsw.search_index(hnsw.build_index(frame, shard_size=size), frame.filter("vec_id in (0, 1000)")).collect():
            found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert sorted(found[0]) == [(i, i, 1.0) for i in range(1, 6)]
        others = {i: round(float(np.dot(w, x) / np.linalg.norm(w) / np.linalg.norm(x)), 12) for i, x in rows if i != 1000}
        assert [(i, s) for _, i, s in sorted(found[1000])] == sorted(others.items(), key=lambda x: (-x[1], x[0]))[:5]


# ---- mixing


def test_mix(spark):
    g = np.random.default_rng(3)
    rows = [(i, " ".join("w" * int(g.integers(0, 30))), ["a", "b", "c", None][int(g.choice(4, p=[0.6, 0.2, 0.1, 0.1]))], 1) for i in range(400)]
    rows += [(500, None, "a", 2), (None, "x y", "b", 3), (3, "again", "b", 4), (600, "", "empty", 5)]
    frame = docs(spark, rows, ", source string, target int")
    found = mix(frame).collect()
    again = mix(frame.repartition(7)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again)) and len(found) == len(rows)
    by, source = {}, {(i, len((t or "").split())): s for i, t, s, _ in rows}
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(source[r["doc_id"], r["size"]], []).append(r)
    total = sum(r["size"] for r in found)
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1e-6
    for v in by.values():
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v) + 2
        assert v[0]["target"] <= 2 * v[0]["source_size"] + 1e-9
    assert mix(frame.limit(0)).count() == 0
    assert {r["taken"] for r in mix(frame.filter("doc_id = 600")).collect()} == {0}
    copies = {(r["doc_id"], r["size"]): r["copies"] for r in found}
    want = sorted(repr(r) for r in rows for _ in range(copies[r[0], len((r[1] or "").split())]))
    assert sorted(repr(tuple(r)) for r in mixed(frame).collect()) == want
    few = mixing.BROADCAST_BYTES
    try:  # more sources than are broadcast
        mixing.BROADCAST_BYTES = 0
        assert sorted(map(repr, mix(frame).collect())) == sorted(map(repr, found))
    finally:
        mixing.BROADCAST_BYTES = few


def test_mixed_keeps_columns_that_clash(spark):
    rows = [(i, "a b c", "s", i, -1, "t", [1], 0.5, 7) for i in range(9)]
    kind = "doc_id long, text string, source string, size long, copies int, target string, _copy array<int>, upto double, _h long"
    frame = spark.createDataFrame(rows, kind)
    found = mixed(frame, weights=(1,), share=1.0)
    assert found.columns == frame.columns and sorted(tuple(r) for r in found.collect()) == rows


# ---- columns


def test_scores_beside_columns_that_clash(spark):
    frame = docs(spark, [(1, "some text", 7, 8, None), (2, None, 9, 1, "x")], ", _scored int, _score int, _text string")
    found = quality.with_score(frame, None)
    assert found.columns == [*frame.columns, "score"] and sorted(r[:5] for r in found.collect()) == sorted(frame.collect())
    labels = spark.createDataFrame([(9, 1)], "doc_id long, quality int")
    kept = quality.keep_good(frame, labels)
    assert kept.columns == frame.columns and sorted(kept.collect()) == sorted(frame.collect())


def test_lines_beside_columns_that_clash(spark):
    names = ("_text", "_th", "_lines", "_gid", "_gth", "_left", "_row", "_id", "h", "n_lines")
    rows = [(1, "a line that is here\nthe second one", *range(10)), (2, "a line that is here\n\nthird", *range(10, 20)), (3, " a line that is here \n", *range(10))]
    frame = docs(spark, rows, "".join(f", {c} int" for c in names))
    found = lines.dedup_lines(frame)
    want = [rows[0], (2, "\nthird", *range(10, 20)), (3, "", *range(10))]
    assert found.columns == frame.columns and sorted(tuple(r) for r in found.collect()) == want
    assert sorted(tuple(r) for r in lines.dedup_lines(frame, drop_emptied=True).collect()) == want[:2]
    counted = lines.dedup_lines(frame, counts=True)
    assert counted.columns == [*frame.columns[:-1], "n_lines", "n_exact", "n_near"]
    assert sorted((r["doc_id"], r["n_lines"], r["n_exact"]) for r in counted.collect()) == [(1, 2, 0), (2, 3, 1), (3, 2, 1)]
