"""Exact memoised tokenisation.

Every tokenizer here splits a text by a pattern before it merges anything, and no
match of those patterns runs from a non-space into a following space.  A text whose
only white space is blanks and line feeds therefore tokenises as the concatenation of
its chunks (white space, then a run of other characters), and chunks repeat, so their
ids are kept in bounded tables.  Texts with any other white space take the direct way.

Arrow numbers the chunks of a batch, so that each different one is looked up once and the ids
are gathered by number.  Where the pattern is known to part them, letters and the punctuation
that follows them are chunks of their own, and so is a line feed alone between other characters.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space, or what some pattern may take for it, other than blank and line feed.
ODD_ASCII = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
ODD_OTHER = "\x85\xa0 ᠎    　﻿" + "".join(map(chr, range(0x2000, 0x200C)))
#: What a byte is: white space of chunks, punctuation, a letter, or other.
OTHER, SPACE, STOP, LETTER = range(4)
KIND = np.full(256, OTHER, np.uint8)
KIND[list(b" \n")] = SPACE
KIND[list(string.punctuation.encode())] = STOP
KIND[list(string.ascii_letters.encode())] = LETTER
#: Entries of a generation of a table: with the one before it, they bound a worker's memory.
LIMIT = 300_000


def has_odd_space(text: str) -> bool:
    return any(c in text for c in ODD_ASCII) or (not text.isascii() and any(c in text for c in ODD_OTHER))


def cuts(data: np.ndarray, bounds: np.ndarray, whole: list[int], parts: bool, uncut: list[int]) -> np.ndarray:
    """Where chunks start in ``data``, the UTF-8 bytes of texts that start at ``bounds``, and the end.

    White space and the run of other characters after it are a chunk; a text of ``whole`` is one
    alone.  With ``parts``, except in the texts of ``uncut``, punctuation after a letter of ASCII
    or Latin-1 and what follows a single line feed start a chunk as well.
    """
    kind = KIND[data]
    space = kind == SPACE
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = space[1:] & ~space[:-1]
    if parts:
        letter = kind == LETTER
        latin = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # but for the signs of times and division
        letter[1:] |= latin
        own = np.zeros(len(cut), bool)
        own[1:-1] = (kind[1:] == STOP) & letter[:-1]
        own[2:-1] |= (data[1:-1] == 10) & ~space[:-2] & ~space[2:]
        for i in uncut:
            own[bounds[i] : bounds[i + 1]] = False
        cut |= own
    for i in whole:
        cut[bounds[i] : bounds[i + 1]] = False
    cut[bounds] = True
    return np.flatnonzero(cut)


class ChunkTable:
    """Chunk -> value tables; ``encode_many`` maps a list of unseen strings to their values.

    ``glue`` tells whether white space belongs to the chunk (it starts pieces) or only
    separates (it is dropped by the tokenizer).  ``parts`` tells that the pattern always parts
    letters from the punctuation after them, and a single line feed from both its neighbours,
    but for the strings in ``special``, which may lie across.
    """

    def __init__(
        self,
        encode_many: Callable[[list[str]], list],
        glue: bool = True,
        limit: int = LIMIT,
        parts: bool = False,
        special: list[str] | None = None,
    ):
        self.encode_many, self.glue, self.limit = encode_many, glue, limit
        self.parts, self.special = parts, special or []
        #: Values of chunks as they are, and of chunks that follow one blank (keyed without it);
        #: each has a young generation and the one before, from which what is used moves back.
        self.plain: list[dict[str, object]] = [{}, {}]
        self.after: list[dict[str, object]] = [{}, {}]

    def split(self, text: str) -> tuple[list[str], list[str]]:
        """Chunks as they are, then chunks that each follow one blank."""
        if has_odd_space(text):
            return [text], []
        if not self.glue:
            return text.replace("\n", " ").split(), []
        if "  " in text or "\n " in text:
            return CHUNK.findall(text), []
        parts = text.split(" ")
        return parts[:1], parts[1:]

    def _fill(self, lists: list[list[str]], generations: list[dict], before: str) -> list[list]:
        """The values of each list; unseen chunks are encoded together."""
        young, old = generations
        found = [list(map(young.get, chunks)) for chunks in lists]
        gaps = [i for i, values in enumerate(found) if None in values]
        unseen = list({c for i in gaps for c, v in zip(lists[i], found[i], strict=True) if v is None})
        fresh = {c: old[c] for c in unseen if c in old}
        unseen = [c for c in unseen if c not in fresh]
        for at in range(0, len(unseen), 4096):
            some = unseen[at : at + 4096]
            fresh.update(zip(some, self.encode_many([before + c for c in some] if before else some), strict=True))
        for i in gaps:
            found[i] = [fresh[c] if v is None else v for c, v in zip(lists[i], found[i], strict=True)]
        # A whole text, or a very long run without spaces, is not worth keeping.
        young.update((c, v) for c, v in fresh.items() if len(c) <= 200)
        if len(young) > self.limit:
            generations[:] = {}, young
        return found

    def values(self, batch: list[str]) -> list[list]:
        """For each text, the values of its chunks in order."""
        both = [self.split(t) for t in batch]
        plain = self._fill([b[0] for b in both], self.plain, "")
        after = self._fill([b[1] for b in both], self.after, " ") if self.glue else None
        return [p + a for p, a in zip(plain, after, strict=True)] if after else plain

    def _each(self, chunks: list[str]) -> list:
        """The values of different chunks; none is kept for the empty one, whose value is no bytes."""
        young, old = self.plain
        found = list(map(young.get, chunks))
        gaps = [i for i, v in enumerate(found) if v is None]
        unseen = []
        for i in gaps:
            chunk = chunks[i]
            value = found[i] = old.get(chunk) if chunk else b""
            if value is None:
                unseen.append(i)
            elif chunk:
                young[chunk] = value
        for at in range(0, len(unseen), 4096):
            some = unseen[at : at + 4096]
            for i, value in zip(some, self.encode_many([chunks[i] for i in some]), strict=True):
                found[i] = value
                if len(chunks[i]) <= 200:  # as in _fill
                    young[chunks[i]] = value
        if len(young) > self.limit:
            self.plain[:] = {}, young
        return found

    def _words(self, texts: list[str], odd: list[int], kind: pa.DataType) -> tuple[np.ndarray, np.ndarray, list]:
        """Number of each word of all texts, where each text's words end, the values; an odd text is one word."""
        whole = [texts[i] for i in odd]
        for i in odd:
            texts[i] = ""
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, kind), "\n", " "), " ")
        coded = lists.values.dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        bounds, codes = lists.offsets.to_numpy(), coded.indices.to_numpy().copy()
        # A whole text stands where its empty substitute was.
        codes[bounds[1:][odd] - 1] = len(different) + np.arange(len(odd))
        return codes, bounds[1:], self._each(different + whole)

    def _glued(self, texts: list[str], odd: list[int], kind: pa.DataType) -> tuple[np.ndarray, np.ndarray, list]:
        """Number of each chunk of all texts, where each text's chunks end, the values; an odd text is one chunk."""
        plain = pa.array(texts, kind)
        large = pa.types.is_large_string(plain.type)
        bounds = np.frombuffer(plain.buffers()[1], np.int64 if large else np.int32)[: len(plain) + 1]
        data = plain.buffers()[2]
        if not bounds[-1]:
            return np.empty(0, np.int32), np.zeros(len(plain), np.int64), []
        uncut = [i for i, t in enumerate(texts) if any(s in t for s in self.special)] if self.parts else []
        at = cuts(np.frombuffer(data, np.uint8)[: bounds[-1]], bounds, odd, self.parts, uncut)
        array = pa.LargeStringArray if large else pa.StringArray
        coded = array.from_buffers(len(at) - 1, pa.py_buffer(at.astype(bounds.dtype)), data).dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        return coded.indices.to_numpy(), np.searchsorted(at, bounds[1:]), self._each(different)

    def ids(self, batch: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, ``end`` after each (null: empty), and their number in each.

        For tables whose values are little-endian 32-bit ids.
        """
        texts = [t or "" for t in batch.to_pylist()]
        odd = [i for i, t in enumerate(texts) if has_odd_space(t)]
        numbers, stops, values = (self._glued if self.glue else self._words)(texts, odd, batch.type)
        del texts
        values.append(end)
        # Each text's chunks and its end.
        codes = np.full(len(numbers) + len(stops), len(values) - 1, np.int32)
        stops = stops + np.arange(len(stops))
        own = np.ones(len(codes), bool)
        own[stops] = False
        codes[own] = numbers
        sizes = np.array([len(v) // 4 for v in values], np.int64)
        starts, known = sizes.cumsum() - sizes, np.frombuffer(b"".join(values), "<i4")
        n = sizes[codes]
        ends = n.cumsum()
        at = np.repeat((starts[codes] - (ends - n)).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        return known[at], np.diff(ends[stops], prepend=0)
