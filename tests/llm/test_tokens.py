import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from treeweft.llm.chunks import cut, plain
from treeweft.llm.huffman import (
    canonical, code_lengths, decode_table, encode_documents, pack_block, read_ids, unpack_block, write_ids,
)
from treeweft.llm.packing import pack, pack_counts, slots
from treeweft.llm.token_count import count_texts, token_counts
from treeweft.llm.token_ids import encode_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n", "a", "aaaaaaaaaaaa", "a  b", "a \n b", "\n\na", "a\n\n", "a\n", " a", "x<|endoftext|>y", "x <|endoftext|> y z",
    "don't we'll", "a\x1cb", "a\x1c b", "a b\x1c", "a\x85b c\x85", "᠎a b", "a​ b﻿", "½ ² Ⅷ x2",
    "日本語 テ", "é à", "a\tb c\r\nd", "!!! ??? ...", "a\x00b \x00c", "x" * 3000, "ab" * 5000 + " c",
    "　a b", "a　 b", "\U0001f600\U0001f600 \U0001f600", "a\nb\nc ", "a \t",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, texts):
    ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert count_texts(texts, PATH) == [len(x) for x in ids]
    found, kind = encode_texts(texts, PATH, end=None)
    assert [np.frombuffer(x, dtype=kind).tolist() for x in found] == ids


def test_odd_texts(library):
    same(library, ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab1 .\n\t'sé\x85\x1c　<|", max_size=40), max_size=6))
def test_any_text(texts):
    same(Tokenizer.from_file(PATH), texts)


def test_special_names_of_any_kind(tmp_path):
    """Added tokens that don't begin with a bracket of one kind only."""
    from tokenizers import AddedToken

    made = Tokenizer.from_file(PATH)
    made.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in ("[PAD]", "@@end")])
    made.save(str(tmp_path / "more.json"))
    texts = ["ab[PAD]cd", "[PAD]", "x @@end y", "a[PA]b @@en", "<|endoftext|>[PAD]@@end"]
    assert count_texts(texts, str(tmp_path / "more.json")) == [len(made.encode(t, add_special_tokens=False).ids) for t in texts]


def test_chunks_make_up_the_text():
    for text in ["a b\nc d. e", "x", "a\n", ""]:
        assert "".join(map(plain, cut(text))) == text


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id long, text string{extra}")


def test_counts(spark, library):
    texts = [None, *ODD]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a b", "y", 2), (1, "", "z", 3)]
    found = token_counts(docs(spark, rows, ", n_tokens string, limit int"), PATH, limit=2).collect()
    assert len(found) == len(rows)
    want = {(i, len((t or "").encode()), len(library.encode(t or "").ids)) for i, t, *_ in rows}
    assert {(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2) for r in found)
    assert token_counts(docs(spark, []), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=80))
def test_code_lengths_are_optimal(counts):
    counts = np.array(counts)
    lengths = code_lengths(counts)
    used = counts > 0
    assert (lengths[~used] == 0).all()
    if used.sum() > 1:
        assert sum(2.0 ** -float(x) for x in lengths[used]) == 1
        import heapq

        heap, cost = sorted(counts[used].tolist()), 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        if lengths.max() < 16:
            assert (counts * lengths).sum() == cost


def test_length_limit():
    counts = np.array([1, 1] + [2**k for k in range(1, 30)])
    lengths = code_lengths(counts)
    assert lengths.max() == 16 and abs(sum(2.0 ** -float(x) for x in lengths) - 1) < 1e-12


@pytest.mark.parametrize("size", [1, 2, 3, 500, 40000])
def test_block_round_trip(size):
    g = np.random.default_rng(size)
    texts = [(np.minimum(g.zipf(1.2, n), size) - 1).astype("<u2") for n in [1, 127, 128, 129, *g.integers(1, 3000, 30)]]
    lengths = code_lengths(np.bincount(np.concatenate(texts), minlength=size))
    parts = list(encode_documents(texts, lengths, canonical(lengths)))
    block = pack_block([len(t) for t in texts], [a for a, _ in parts], [b for _, b in parts])
    sizes, ids = unpack_block(block, decode_table(lengths))
    assert sizes.tolist() == [len(t) for t in texts] and (ids == np.concatenate(texts)).all()


def test_files(spark, library):
    rows = [(5, None), (3, "a b c"), (None, "first"), (3, "a b c"), (9, "z " * 5000), (4, "")] + [(100 + i, t) for i, t in enumerate(ODD)]
    found = read_ids(spark, write_ids(docs(spark, rows).repartition(3), PATH)).collect()
    found.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in found][:4] == [None, 3, 3, 4] and len(found) == len(rows)
    at = 0
    texts = dict(rows)
    for r in found:
        ids = [*library.encode(texts[r["doc_id"]] or "").ids, 0]
        assert (r["start"], r["n_tokens"], r["ids"]) == (at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    assert read_ids(spark, write_ids(docs(spark, []), PATH)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40)))
def test_packing_counts(counts):
    patterns = pack_counts(counts, 30)
    held = {}
    for pattern, times in patterns:
        assert sum(pattern) <= 30 and times > 0
        for n in pattern:
            held[n] = held.get(n, 0) + times
    assert held == counts
    gaps = []  # first fit, longest first
    for k in sorted((k for k, c in counts.items() for _ in range(c)), reverse=True):
        at = next((i for i, g in enumerate(gaps) if g >= k), len(gaps))
        gaps[at:] = [gaps[at] - k, *gaps[at + 1 :]] if at < len(gaps) else [30 - k]
    assert sum(t for _, t in patterns) <= len(gaps) + 1
    assert {k: int(v[:, 3].sum()) for k, v in slots(patterns).items()} == counts


def test_pack(spark, library):
    rows = [(1, None), (2, "word " * 40), (2, "word " * 40), (3, "b"), (4, "c d e"), (None, "z")] + [(10 + i, "x y " * i) for i in range(9)]
    found = pack(docs(spark, rows, "").repartition(3), PATH, capacity=16).collect()
    by, pieces = {}, {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]), []).append(1)
    for spots in by.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 16
    want = {}
    for i, t in rows:
        ids = np.array([*library.encode(t or "").ids, 0], dtype="<u4")
        cuts = [0, *range(len(ids) % 16 or 16, len(ids), 16), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.setdefault((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), []).append(1)
    assert pieces == want
    assert pack(docs(spark, []), PATH).count() == 0
