"""Anchors of byte strings: which short string stands for each window of 100 bytes.

Of the ``GRAM``-byte strings within a window the one with the smallest hash, the leftmost of equals, is the
window's anchor. That depends on the window's bytes alone, so equal windows have equal anchors at equal places.
"""

from __future__ import annotations

import numpy as np

WINDOW = 100
GRAM = 24
ODD = 0x9E3779B97F4A7C15
PLACE_BITS = 24
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on, by doubling: of 1, 2, 4.. bytes, then what is missing."""
    wanted, have, h = gram, 1, data.astype(np.uint64) + np.uint64(1)
    while have * 2 <= wanted:
        h = h[:-have] * np.uint64(pow(ODD, have, 1 << 64)) + h[have:]
        have *= 2
    if have < wanted:
        more = wanted - have  # the last ``have`` bytes overlap the first
        h = h[:-more] * np.uint64(pow(ODD, 3 * have, 1 << 64)) + h[more:]
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` values in a row: suffix and prefix minima of blocks meet in every window."""
    n = len(x)
    padded = np.full(-(-n // size) * size, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - size + 1], ahead[size - 1 : n])


def anchors(texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """(owner, hash, place, first, last): each anchor of each text, and the first and last window start it stands for.

    Places are counted through all texts as if they were one. No anchor for fewer bytes than a window. A run of windows
    with one anchor is one row.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.cumsum(sizes) - sizes
    none = np.zeros(0, dtype=np.int64)
    if not len(sizes) or sizes.max() < window:
        return none, none.view(np.uint64), none, none, none
    h = gram_hashes(data, gram)
    held = np.repeat(np.maximum(sizes - window + 1, 0), sizes)  # windows of the text that a place lies in
    whole = np.arange(len(data)) - np.repeat(starts, sizes) < held
    found, begin = [], 0
    most = (1 << PLACE_BITS) - window
    while begin + window <= len(data):  # parts whose places fit beside the hash
        part = h[begin : begin + most + window - gram]
        mixed = (part >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(part), dtype=np.uint64)
        least = sliding_min(mixed, window - gram + 1)
        at = np.flatnonzero(whole[begin : begin + len(least)])  # windows that end in the text they begin in
        place = (least[at] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(at) else at
        last = np.r_[edges[1:], len(place)][: len(edges)] - 1
        found.append((h[place[edges] + begin], place[edges] + begin, at[edges] + begin, at[last] + begin))
        begin += len(least)
    h, place, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
    return np.searchsorted(starts, first, side="right") - 1, h, place, first, last
