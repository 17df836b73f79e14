"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch lie one after another in one array of symbol ids. In each round every
pre-token finds the lowest rank among its adjacent pairs, and all its occurrences of that pair are merged, for all
pre-tokens at once. A pre-token leaves when no pair of it has a rank; what it holds then is its token count.

* A null text counts as empty: 0 bytes, 0 tokens.
* Strings of added special tokens inside a text count as one token each, as the library does by default.
* Rows are independent: repeated rows, ties and very long texts need no special care. An empty table gives an
  empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeweft.llm.chunks import AT_ONCE_BYTES, ChunkTable
from treeweft.llm.common import gathered, small_batches, whole_text

#: The byte-level pre-token pattern (a fixed value of this tokenizer family).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.iinfo(np.int32).max
LIMIT = 512


def byte_symbols() -> list[str]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + n)
    return [names[b] for b in range(256)]


def byte_level(spec: dict) -> bool:
    """Whether a tokenizer file describes byte-level BPE over PRETOKEN, without anything that changes texts before."""
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    whole = not any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added)
    return bool(model["type"] == "BPE" and plain and whole and not spec.get("normalizer") and not model.get("ignore_merges"))


class RankMerger:
    """Counts the tokens of pre-tokens and of chunks under one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not byte_level(spec):
            raise ValueError(f"{path}: only byte-level BPE without normalizer is counted")
        model, added = spec["model"], spec.get("added_tokens") or []
        vocab = model["vocab"]
        self.first = np.array([vocab[s] for s in byte_symbols()], dtype=np.int64)
        self.base = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys := left * self.base + right, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.pattern = regex.compile(PRETOKEN)
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(regex.escape(n) for n in names)) if names else None
        self.marks = sorted({n[0] for n in names})

    def merged(self, pretokens: list[bytes]) -> np.ndarray:
        """The number of symbols that each pre-token has left after all merges."""
        sizes = np.fromiter(map(len, pretokens), dtype=np.int64, count=len(pretokens))
        counts = sizes.copy()
        live = np.flatnonzero(sizes > 1)
        if not len(live):
            return counts
        flat = self.first[np.frombuffer(b"".join(pretokens[i] for i in live.tolist()), dtype=np.uint8)]
        owner = np.repeat(live, sizes[live])
        while len(flat):
            inside = owner[:-1] == owner[1:]
            keys = flat[:-1] * self.base + flat[1:]
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            rank = np.where(inside & (self.keys[at] == keys), self.ranks[at], NO_RANK)
            starts = np.flatnonzero(np.r_[True, ~inside])
            lowest = np.minimum.reduceat(np.r_[rank, NO_RANK], starts)
            lengths = np.diff(np.r_[starts, len(flat)])
            best = np.repeat(lowest, lengths)[:-1]
            hit = (rank == best) & (rank != NO_RANK)
            # in a run of overlapping hits (a pair of equal symbols) every other one counts, from the left
            if (hit[1:] & hit[:-1]).any():
                index = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], index, 0))
                hit &= (index - begin) % 2 == 0
            where = np.flatnonzero(hit)
            flat[where] = self.made[at[where]]
            stay = np.ones(len(flat), dtype=bool)
            stay[where + 1] = False
            done = lowest == NO_RANK
            if done.any():
                counts[owner[starts[done]]] = lengths[done]
                stay &= ~np.repeat(done, lengths)
            flat, owner = flat[stay], owner[stay]
        return counts

    def chunk_counts(self, chunks: list[str]) -> list[int]:
        """The number of tokens of each chunk."""
        parts, extra = [], []
        for chunk in chunks:
            pieces = self.special.split(chunk) if any(map(chunk.__contains__, self.marks)) else [chunk]
            extra.append(len(pieces) - 1)
            parts.append([p for piece in pieces for p in self.pattern.findall(piece)])
        distinct = list(set(chain.from_iterable(parts)))
        of = dict(zip(distinct, self.merged([p.encode() for p in distinct]).tolist(), strict=True))
        return [n + sum(map(of.__getitem__, p)) for n, p in zip(extra, parts, strict=True)]


_TABLES: dict[str, ChunkTable] = {}


def chunk_table(path: str) -> ChunkTable:
    if path not in _TABLES:
        _TABLES[path] = ChunkTable(RankMerger(path).chunk_counts, pa.int64())
    return _TABLES[path]


def count_texts(texts: list[str], path: str) -> list[int]:
    table = chunk_table(path)
    found = table.look_up(texts)
    sums, ends = np.r_[0, np.cumsum(found.values.to_numpy())], np.cumsum(found.counts)
    counts = (sums[ends] - sums[ends - found.counts]).tolist()
    for i, n in zip(found.whole, table.work_out([texts[i] for i in found.whole]), strict=True):
        counts[i] = n
    return counts


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT):
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    rows = rows.withColumn("n_bytes", F.octet_length("_text").cast("long"))
    schema = T.StructType(
        [
            rows.schema["_id"],
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, AT_ONCE_BYTES):
            counts = pa.array(count_texts(batch["_text"].to_pylist(), path), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["n_bytes"], counts], ["_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(work, schema).select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
