"""The perfect binary Golay code of length 23: nearby codewords by syndrome tables.

Every 23-bit word lies within 3 bits of exactly one of the 4096 codewords.  Tables come
from the generator polynomial.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the fixed generator polynomial of the code.
GENERATOR = 0b101011100011
LENGTH, MESSAGE = 23, 12


def remainder(word: int) -> int:
    """The word modulo the generator: its 11-bit syndrome."""
    for bit in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - (LENGTH - MESSAGE))
    return word


@functools.cache
def syndrome_tables() -> list[np.ndarray]:
    """The syndrome of a word is the exclusive or of one entry for each of its three bytes."""
    single = [remainder(1 << bit) for bit in range(LENGTH)]
    tables = []
    for low in (0, 8, 16):
        own = np.zeros(256, dtype=np.int64)
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and low + bit < LENGTH:
                    own[value] ^= single[low + bit]
        tables.append(own)
    return tables


@functools.cache
def coset_patterns(radius: int) -> np.ndarray:
    """For each syndrome the error patterns of at most ``radius`` bits, padded by -1; lightest first."""
    found: list[list[int]] = [[] for _ in range(1 << (LENGTH - MESSAGE))]
    single = [remainder(1 << bit) for bit in range(LENGTH)]
    for weight in range(radius + 1):
        for bits in combinations(range(LENGTH), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= single[b]
            found[syndrome].append(sum(1 << b for b in bits))
    out = np.full((len(found), max(map(len, found))), -1, dtype=np.int64)
    for s, patterns in enumerate(found):
        out[s, : len(patterns)] = patterns
    return out


def syndromes(words: np.ndarray) -> np.ndarray:
    low, middle, high = syndrome_tables()
    return low[words & 255] ^ middle[words >> 8 & 255] ^ high[words >> 16 & 255]


def nearby(words: np.ndarray, radius: int) -> np.ndarray:
    """Indices (12 bits) of the codewords within ``radius`` of each word, nearest first, padded by -1."""
    patterns = coset_patterns(radius)[syndromes(words)]
    return np.where(patterns < 0, -1, (words[:, None] ^ patterns) >> (LENGTH - MESSAGE))
