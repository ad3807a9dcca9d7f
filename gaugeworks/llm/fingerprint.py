"""SimHash of one text: three-word shingles, XXH64, a majority vote per bit."""

from __future__ import annotations

from itertools import repeat

import numpy as np
from xxhash import xxh64_intdigest

SEED = 42
SHINGLE_WORDS = 3
_AT_A_TIME = 1 << 16


def shingles_of(text: bytes) -> list[bytes]:
    """Shingles of UTF-8 text in order, repeats included; a text of fewer words is one shingle.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` cuts at space and 09-0D only, as asked.
    """
    words = text.lower().split()
    if len(words) < SHINGLE_WORDS:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(words, words[1:], words[2:])))


def fingerprint_of(text: bytes | None) -> int:
    """The unsigned 64-bit fingerprint; 0 for null and for texts without words."""
    shingles = shingles_of(text or b"")
    votes = np.zeros(64, dtype=np.int64)
    for start in range(0, len(shingles), _AT_A_TIME):
        part = shingles[start : start + _AT_A_TIME]
        hashes = np.fromiter(map(xxh64_intdigest, part, repeat(SEED)), dtype="<u8", count=len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * votes > len(shingles), bitorder="little").view("<u8")[0])
