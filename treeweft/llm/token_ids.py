"""Token ids of whole texts, as the tokenizers library gives them, with each distinct chunk encoded once."""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa

from treeweft.llm.chunks import ChunkTable
from treeweft.llm.token_count import byte_level, byte_symbols

_ENCODERS: dict[str, Encoder] = {}
#: Characters of chunks that the library gets as one text, and other chunks given to it in one call.
JOINED = 1 << 16
AT_ONCE = 1024
#: Letters below are letters for every version of the library's tables (Latin, Greek and Cyrillic script).
SETTLED = "԰"


class Encoder:
    """The ids of texts, as bytes.

    A chunk of letters with ASCII punctuation behind them has two pre-tokens, which go straight to the library's
    model. Other chunks that follow each other are encoded as one text: a chunk that begins with white space and
    goes on without ends before the next one, so that its ids are those of its bytes. The bytes that each id stands
    for tell where. What is not byte-level BPE is encoded text by text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.wide = np.zeros(size, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.wide[i] = len(token)  # a character for each byte
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.wide[i] = len(token.content.encode())
        with open(path, encoding="utf-8") as f:
            self.cuttable = byte_level(json.load(f))
        self.symbols = dict(enumerate(byte_symbols()))
        model, code = self.tokenizer.model, "H" if self.kind.itemsize == 2 else "I"
        self.piece = lambda x: array(code, [t.id for t in model.tokenize(x)]).tobytes()
        self.often = lru_cache(1 << 12)(self.piece)
        self.table = ChunkTable(self.encode, pa.binary())

    def encode(self, chunks: list[str]) -> list[bytes]:
        found: list = [None] * len(chunks)
        rest, pieces = [], {}
        for i, chunk in enumerate(chunks):
            body = chunk.rstrip(punctuation)
            letters = body[1:]
            if chunk[0] in " \n" and letters.isalpha() and (letters.isascii() or max(letters) < SETTLED):
                word = body if chunk[0] == " " else letters
                ids = pieces.get(word)
                if ids is None:
                    ids = pieces[word] = self.piece(word.encode().decode("latin-1").translate(self.symbols))
                if chunk[0] == "\n":
                    ids = self.often(self.symbols[10]) + ids
                found[i] = ids if len(body) == len(chunk) else ids + self.often(chunk[len(body) :])
            else:
                rest.append(i)
        self._others(chunks, rest, found)
        return found

    def _others(self, chunks: list[str], which: list[int], found: list) -> None:
        apart = [i for i in which if (c := chunks[i])[0] not in " \n" or len(c) < 2 or c[1].isspace() or c[-1].isspace()]
        for i, ids in zip(apart, self.alone([chunks[i] for i in apart]), strict=True):
            found[i] = ids
        held, size = [], 0
        for i in which:
            if found[i] is None:
                held.append(i)
                size += len(chunks[i])
                if size > JOINED:
                    self._joined(chunks, held, found)
                    held, size = [], 0
        if held:
            self._joined(chunks, held, found)

    def alone(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, encoded by itself."""
        found = []
        for i in range(0, len(texts), AT_ONCE):
            encoded = self.tokenizer.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)
            found += [np.array(e.ids, dtype=self.kind).tobytes() for e in encoded]
        return found

    def _joined(self, chunks: list[str], which: list[int], found: list) -> None:
        texts = [chunks[i] for i in which]
        ids = np.frombuffer(self.alone(["".join(texts)])[0], dtype=self.kind)
        ends = np.cumsum(self.wide[ids])
        edges = np.cumsum(np.fromiter((len(t.encode()) for t in texts), dtype=np.int64, count=len(texts)))
        cuts = np.searchsorted(ends, edges) + 1
        if cuts[-1] != len(ids) or (ends[cuts - 1] != edges).any():
            raise ValueError("this tokenizer's ids don't keep to the chunks")
        data, width, begin = ids.tobytes(), self.kind.itemsize, 0
        for i, end in zip(which, (cuts * width).tolist(), strict=True):
            found[i] = data[begin:end]
            begin = end

    def texts(self, texts: list[str]) -> list[bytes]:
        if not self.cuttable:
            return self.alone(texts)
        found = self.table.look_up(texts)
        _, ends, data = found.values.buffers()
        data = b"" if data is None else data.to_pybytes()
        ends = np.frombuffer(ends, dtype=np.int32)[: len(found.values) + 1] if len(found.values) else np.zeros(1, np.int32)
        cuts = ends[np.r_[0, np.cumsum(found.counts)]].tolist()
        out = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i, ids in zip(found.whole, self.alone([texts[i] for i in found.whole]), strict=True):
            out[i] = ids
        return out


def encode_texts(texts: list[str], path: str, end: int | None = 0) -> tuple[list[bytes], np.dtype]:
    """For each text the bytes of its ids, with the id ``end`` at the end unless that is None."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    encoder = _ENCODERS[path]
    found = encoder.texts(texts)
    if end is not None:
        last = np.array([end], dtype=encoder.kind).tobytes()
        found = [x + last for x in found]
    return found, encoder.kind
