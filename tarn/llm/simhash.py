"""SimHash fingerprints of word shingles."""

from __future__ import annotations

import numpy as np

SEED = 42
#: Shingle hashes whose bits are counted at once.
BLOCK = 1 << 15


def shingle_hashes(text: str | None, words_per_shingle: int) -> np.ndarray:
    """The hash of every shingle in order.

    A-Z are lower-cased; words are runs of anything but white space of ASCII; a shingle is
    ``words_per_shingle`` words joined by a space, or all words if there are fewer, and is
    hashed by XXH64 with seed 42.
    """
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    size = min(words_per_shingle, len(words))
    first, end = starts[:-size].tolist(), (starts[size:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(first, end, strict=True)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """64 bits: bit i is 1 if over half of ``hashes`` have it; zero if there are none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words_per_shingle: int = 4) -> int:
    """The majority of the shingles' hashes; no words: zero.

    Repeated shingles count as often as they occur.
    """
    return majority(shingle_hashes(text, words_per_shingle))
