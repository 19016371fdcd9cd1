"""Repeated substrings of a minimum length, by bounded interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

#: Bits of a symbol (a byte plus one; zero separates texts) and symbols that fit into a first sort key.
SYMBOL_BITS, FIRST = 9, 7


def sorted_suffixes(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by at least their first ``depth`` symbols, by prefix doubling, and their ranks.

    Only suffixes that still share their rank with another are sorted again.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(FIRST, symbols.dtype)]).astype(np.int64)
    key = np.zeros(n, dtype=np.int64)
    for j in range(FIRST):
        key = key << SYMBOL_BITS | padded[j : n + j]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    at = np.arange(n)  # places in the order that are not final yet
    length = FIRST
    while True:
        own = order[at]
        new = np.ones(len(own), bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        # A group's rank is the place of its first member.
        first = at[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))] if len(own) else at
        rank[own] = first
        alone = new & np.append(new[1:], True)
        at = at[~alone]
        if length >= depth or not len(at):
            return order, rank[:n]
        own = order[at]
        key = rank[own] * (n + 2) + rank[np.minimum(own + length, n)] + 1
        again = np.argsort(key, kind="stable")
        order[at] = own[again]
        sorted_key = key[again]
        length *= 2


def boundaries(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes, and for each whether it shares fewer than ``least`` symbols with the one before.

    Breadth-first over the strings without separators, shorter ones first: the interval of
    rows that start with a string is extended to the left by every symbol before its rows.
    The end of an interval whose common prefix is not known yet has exactly the current
    length in common with the row before it, and only then is the interval kept.  The search
    stops at ``least``.  Rows shorter than that up to their separator are boundaries too.
    """
    n = len(symbols)
    order, rank = sorted_suffixes(symbols, least + 1)
    inverse = np.empty(n, dtype=np.int64)
    inverse[order] = np.arange(n)
    before = symbols[order - 1]  # the transform; the text starts with a separator
    before[order == 0] = 0
    to_left = inverse[order - 1]  # row of the suffix one symbol longer
    to_right = inverse[np.minimum(order + 1, n - 1)]  # row of the suffix one symbol shorter
    head = symbols[order]
    known = np.zeros(n + 1, dtype=bool)
    known[0] = known[n] = True
    known[: int((symbols == 0).sum()) + 1] = True
    lows, highs = np.array([0]), np.array([n])
    for _ in range(least):
        sizes = highs - lows
        starts = np.cumsum(sizes) - sizes
        rows = np.arange(sizes.sum()) + np.repeat(lows - starts, sizes)
        low, high = np.repeat(lows, sizes), np.repeat(highs, sizes)
        real = before[rows] > 0
        rows, low, high = rows[real], low[real], high[real]
        target, symbol = to_left[rows], before[rows]
        # A target starts (ends) its interval if its neighbour does not come from the same interval and symbol.
        up = np.minimum(target + 1, n - 1)
        from_up = to_right[up]
        last = (target + 1 == n) | (head[up] != symbol) | (from_up >= high) | (from_up < low)
        ends = target[last] + 1
        fresh = ~known[ends]
        if not fresh.any():
            break
        down = np.maximum(target - 1, 0)
        from_down = to_right[down]
        first = (target == 0) | (head[down] != symbol) | (from_down >= high) | (from_down < low)
        begins, ends = np.sort(target[first]), np.sort(ends)
        fresh = ~known[ends]
        lows, highs = begins[fresh], ends[fresh]
        known[highs] = True
    separators = np.flatnonzero(symbols == 0)
    following = np.append(separators, n)[np.searchsorted(separators, np.arange(n), side="left")]
    short = (following - np.arange(n) < least)[order]
    out = known[:n] | short
    out[1:] |= short[:-1]
    return order, out


def repeated_starts(
    texts: list[bytes], windows: list[int], weights: list[int], least: int
) -> list[np.ndarray]:
    """For each text, which of its first ``windows`` positions start a repeated string of ``least`` bytes.

    A text stands for ``weights`` equal ones.  A string is repeated if the positions among all
    texts' first ``windows`` that it starts at weigh two or more together.
    """
    sizes = np.array([len(t) for t in texts])
    offsets = np.cumsum(sizes + 1) - sizes
    symbols = np.zeros(int(sizes.sum()) + len(texts) + 1, dtype=np.int16)
    for o, t in zip(offsets, texts, strict=True):
        symbols[o : o + len(t)] = np.frombuffer(t, np.uint8).astype(np.int16) + 1
    order, starts = boundaries(symbols, least)
    weight = np.zeros(len(symbols), dtype=np.int64)
    for o, w, times in zip(offsets, windows, weights, strict=True):
        weight[o : o + w] = times
    groups = np.cumsum(starts) - 1
    own = weight[order]
    total = np.bincount(groups, own)
    repeated = np.zeros(len(symbols), dtype=bool)
    repeated[order] = (own > 0) & (total[groups] >= 2)
    return [repeated[o : o + w] for o, w in zip(offsets, windows, strict=True)]
