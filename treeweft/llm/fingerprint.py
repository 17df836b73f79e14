"""SimHash fingerprints of whole texts."""

from __future__ import annotations

from itertools import repeat

import numpy as np
from xxhash import xxh64_intdigest

SEED = 42
#: Hashes that are counted at once; a byte holds as many.
AT_ONCE = 255


def shingles(text: str, words: int) -> list[bytes]:
    """All runs of ``words`` words, A-Z lower-cased, joined by spaces; of fewer words the one run there is."""
    found = text.encode().lower().split()  # on bytes: only A-Z change, only space and 09-0D separate
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*[found[k:] for k in range(words)], strict=False)))


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set, lowest bit first."""
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), AT_ONCE * 64):
        part = hashes[i : i + AT_ONCE * 64]
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64)
        whole = len(bits) // AT_ONCE * AT_ONCE
        if whole:
            total += bits[:whole].reshape(-1, AT_ONCE, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        if whole < len(bits):
            total += bits[whole:].sum(axis=0, dtype=np.uint8)
    return total


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """The XXH64 hash of each shingle, repeats included."""
    found = shingles(text, words)
    return np.fromiter(map(xxh64_intdigest, found, repeat(SEED)), dtype="<u8", count=len(found))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes; without hashes 0."""
    over = set_bits(hashes) * 2 > len(hashes)
    return int.from_bytes(np.packbits(over, bitorder="little").tobytes(), "little")


def simhash(text: str, words: int = 3) -> int:
    """The fingerprint of a text's shingles."""
    return fingerprint(shingle_hashes(text, words))


def signed(x: int) -> int:
    """The 64-bit number with the same bits."""
    return x - (1 << 64) if x >> 63 else x
