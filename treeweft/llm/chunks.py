"""Cut texts into chunks that a byte-level BPE tokenizer treats independently of each other.

The pre-token pattern never lets a pre-token run from a non-space character into a space, and a single space
that follows one always starts the next pre-token. Where no two white-space characters touch, a text is therefore
the concatenation of its chunks: each a space or line feed with what follows up to the next one. Chunks repeat
far more often than texts do, so each distinct chunk is worked out once and looked up from then on. A text in
which white space touches white space, or that begins with it, is one chunk as a whole.

Chunks are told apart, looked up and put together as Arrow arrays; only new ones become Python strings.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOUCHING = re.compile(r"\s\s")
#: Bytes of chunks and their values beyond which a worker forgets the half that it has not met for longest.
MOST_BYTES = 32 << 20
#: Bytes of texts that are best looked up at once.
AT_ONCE_BYTES = 8 << 20


def line_up(text: str) -> str | None:
    """The keys of a text's chunks, in order, with a space between each two; None if the text can't be cut.

    A key without a leading line feed stands for itself after a space; with one, for itself; with two, for what
    follows them. They hold unless one of them is ``touching``.
    """
    body = text.rstrip("\n")
    if not body or body[0].isspace() or body[-1].isspace():
        return None
    keys = "\n\n" + body.replace("\n", " \n")
    return keys if len(body) == len(text) else f"{keys} \n\n{text[len(body) :]}"


def cut(text: str) -> list[str]:
    """The keys of a text's chunks, in order; one that stands for all of it if it can't be cut."""
    keys = line_up(text)
    if keys is not None and not any(map(touching, found := keys.split(" "))):
        return found
    return ["\n\n" + text] if text else []


def touching(key: str) -> bool:
    """Whether white space touches white space in the key or beside it, so that its text can't be cut there."""
    if key.isprintable():  # without any white space, as a key holds no space
        return not key
    if key.startswith("\n\n"):
        return False
    return key == "\n" or key[-1].isspace() or TOUCHING.search(plain(key)) is not None


def plain(key: str) -> str:
    """The text of the chunk that a key stands for."""
    if key[:1] != "\n":
        return " " + key
    return key[2:] if key.startswith("\n\n") else key


@dataclass
class Found:
    """The chunks of a batch of texts: their values one after another, and how many each text has. Texts in
    ``whole`` are one chunk and have none of these."""

    values: pa.Array
    counts: np.ndarray
    whole: list[int]


class ChunkTable:
    """What ``work_out`` makes of each chunk, kept for later batches; ``kind`` is the type of its values."""

    def __init__(self, work_out: Callable[[list[str]], list], kind: pa.DataType, most: int = MOST_BYTES):
        self.work_out, self.kind, self.most = work_out, kind, most
        self.keys, self.values = pa.array([], pa.large_string()), pa.array([], kind)
        self.met, self.time = np.zeros(0, dtype=np.int64), 0

    def look_up(self, texts: list[str]) -> Found:
        lined = [line_up(t) for t in texts]
        counts = np.array([0 if x is None else x.count(" ") + 1 for x in lined], dtype=np.int64)
        whole = [i for i, x in enumerate(lined) if x is None and texts[i]]
        if not counts.any():
            return Found(pa.array([], self.kind), counts, whole)
        chunks = pc.split_pattern(pa.array([" ".join(x for x in lined if x is not None)], pa.large_string()), " ").values
        coded = chunks.dictionary_encode()
        values, index = self._values(coded.dictionary), coded.indices
        if values.null_count:  # chunks that can't be cut off: their texts are one chunk each
            bad = np.asarray(values.is_null())[index.to_numpy()]
            owner = np.repeat(np.arange(len(texts)), counts)
            spoilt = np.zeros(len(texts), dtype=bool)
            spoilt[owner[bad]] = True
            whole += np.flatnonzero(spoilt).tolist()
            index, counts = index.filter(pa.array(~spoilt[owner])), np.where(spoilt, 0, counts)
        return Found(values.take(index), counts, whole)

    def _values(self, wanted: pa.Array) -> pa.Array:
        """The values of different keys, null for those that can't be cut off."""
        self.time += 1
        place = pc.index_in(wanted, value_set=self.keys)
        if place.null_count:
            new = wanted.filter(place.is_null())
            place = place.to_numpy(zero_copy_only=False)
            missing = np.isnan(place)
            place[missing] = len(self.keys) + np.arange(len(new))
            self.keys = pa.concat_arrays([self.keys, new])
            self.values = pa.concat_arrays([self.values, self._worked_out(new.to_pylist())])
            self.met = np.r_[self.met, np.zeros(len(new), dtype=np.int64)]
        place = np.asarray(place, dtype=np.int64)
        self.met[place] = self.time
        found = self.values.take(pa.array(place))
        self._forget()
        return found

    def _worked_out(self, keys: list[str]) -> pa.Array:
        good = [k for k in keys if not touching(k)]
        values = self.work_out([plain(k) for k in good])
        if len(good) < len(keys):
            of = dict(zip(good, values, strict=True))
            values = [of.get(k) for k in keys]
        return pa.array(values, self.kind)

    def _forget(self) -> None:
        if self.keys.nbytes + self.values.nbytes <= self.most:
            return
        order = np.argsort(-self.met, kind="stable")
        wide = pc.binary_length(self.keys).to_numpy(zero_copy_only=False) + 24
        if pa.types.is_binary(self.kind):
            wide = wide + pc.fill_null(pc.binary_length(self.values), 0).to_numpy(zero_copy_only=False)
        stay = np.sort(order[np.cumsum(wide[order]) <= self.most // 2])
        self.keys, self.values, self.met = self.keys.take(pa.array(stay)), self.values.take(pa.array(stay)), self.met[stay]
