"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can end its encoding:
the token whose pair with the last token of the remaining shorter prefix is left alone by
the merges.  ``PrefixTable`` stores that token for each prefix.  The encoding is read off
backwards, bytes are appended exactly by adding entries, and after an edit only entries
near it are computed again.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.llm.chunks import ChunkTable
from tarn.llm.common import id_type, small_batches, texts

#: Entries of the tables of checked pairs and known pieces in a worker before they start afresh.
PAIRS = 1_000_000
PIECES = 250_000
NEVER = 1 << 62


class BytePairVocabulary:
    """Tokens by rank; a lower rank merges earlier, and of equal merges the leftmost goes first."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.token = {rank: piece for piece, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._left: dict[int, list[int]] = {}
        self._right: dict[int, list[int]] = {}
        self._pairs: dict[int, bool] = {}
        self._made: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, rank in ranks.items():
            self.automaton.add_word(piece.decode("latin-1"), (len(piece), rank))
        self.automaton.make_automaton()

    def halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for one byte or a token merges never make."""
        if rank not in self._halves:
            parts = [bytes((b,)) for b in self.token[rank]]
            pair = None
            while len(parts) > 1:
                options = [(self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
                best, i = min(options)
                if best == NEVER:
                    pair = None
                    break
                pair = (self.ranks[parts[i]], self.ranks[parts[i + 1]])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._halves[rank] = pair
        return self._halves[rank]

    def made(self, rank: int) -> bool:
        """Whether merges make this token from its bytes."""
        return len(self.token[rank]) == 1 or self.halves(rank) is not None

    def _edge(self, rank: int, side: int, memo: dict[int, list[int]]) -> list[int]:
        """Tokens at one edge in the order in which merges make them, up to ``rank`` itself."""
        if rank not in memo:
            pair = self.halves(rank)
            memo[rank] = [*(self._edge(pair[side], side, memo) if pair else ()), rank]
        return memo[rank]

    def stands(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens together ends in just these two tokens.

        Both sides grow by their own merges in order of rank.  A merge across the border
        comes first if its rank is below the next merge of the left side's last token and not
        above the next merge of the right side's first token.
        """
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            a, b = self._edge(left, 1, self._right), self._edge(right, 0, self._left)
            i = j = 0
            known = True
            while True:
                next_a = a[i + 1] if i + 1 < len(a) else NEVER
                next_b = b[j + 1] if j + 1 < len(b) else NEVER
                across = self.ranks.get(self.token[a[i]] + self.token[b[j]])
                if across is not None and across < next_a and across <= next_b:
                    known = False
                    break
                if next_a == next_b == NEVER:
                    break
                if next_a <= next_b:
                    i += 1
                else:
                    j += 1
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece of a split text; a piece that is a token is that token."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        table = PrefixTable(self)
        table.data, table.last = piece, self.last_tokens(piece)
        return table.ids()

    def last_tokens(self, data: bytes) -> list[int]:
        """The last token of every prefix; matches may come in any order, as just one stands."""
        last = [-1] * len(data)
        pairs, made, stands = self._pairs, self._made, self.stands
        for end, (length, rank) in self.automaton.iter(data.decode("latin-1")):
            if last[end] < 0:
                own = made.get(rank)
                if own is None:
                    own = made[rank] = self.made(rank)
                if own:
                    before = end - length
                    if before < 0:
                        last[end] = rank
                    else:
                        known = pairs.get(last[before] << 32 | rank)
                        if known or known is None and stands(last[before], rank):
                            last[end] = rank
        if -1 in last:
            raise ValueError("the vocabulary lacks single bytes")
        return last


class PrefixTable:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: BytePairVocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _fill(self, first: int, stop: list[int] | None = None, shift: int = 0, settled: int = 0) -> None:
        """Compute ``last`` from position ``first``; with ``stop``, the old entries, end early.

        Position p is old position p - shift.  Once as many entries after ``settled`` as the
        longest token has bytes equal the old ones, all later ones do.
        """
        v, last = self.vocabulary, self.last
        start = max(0, first - v.longest + 1)
        same = 0
        window = self.data[start:].decode("latin-1")
        matches: list[list[tuple[int, int]]] = [[] for _ in window]
        found = v.automaton.iter(window)
        pending = next(found, None)
        for end in range(first, len(self.data)):
            while pending is not None and pending[0] + start <= end:
                matches[pending[0]].append(pending[1])
                pending = next(found, None)
            own = matches[end - start]
            own.sort(reverse=True)
            for length, rank in own:
                before = end - length
                if v.made(rank) and (before < 0 or v.stands(last[before], rank)):
                    last.append(rank)
                    break
            else:
                raise ValueError("the vocabulary lacks single bytes")
            matches[end - start] = []
            if stop is not None and end >= settled:
                same = same + 1 if last[end] == stop[end - shift] else 0
                if same >= v.longest:
                    last.extend(stop[end + 1 - shift :])
                    return

    def append(self, more: bytes) -> None:
        first = len(self.data)
        self.data += more
        self._fill(first)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Replace bytes start to end by ``new``."""
        old = self.last
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start]
        self._fill(start, old, start + len(new) - end, start + len(new))

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            rank = self.last[at - 1]
            out.append(rank)
            at -= len(self.vocabulary.token[rank])
        return out[::-1]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TextCodec:
    """Encodes texts piece by piece, as split by ``pattern``, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.vocabulary = BytePairVocabulary(ranks)
        self.pieces = regex.compile(pattern).findall
        #: Whether the pattern takes a run of letters, with a blank before it or not, as one match.
        self.words = r" ?\p{L}+" in pattern.split("|") and pattern.split("|")[0].startswith("'")
        self.known: dict[str, list[int]] = {}
        self.table = ChunkTable(lambda chunks: [self.encode_ids(c) for c in chunks])

    def encode_ids(self, text: str) -> bytes:
        out: list[int] = []
        word, stop = (text[:-1], text[-1]) if text[-1:] in (".", ",") else (text, "")
        if self.words and (word[1:] if word[:1] == " " else word).isalpha():
            pieces = [word, stop] if stop else [word]  # one word, and perhaps one stop: the pattern's matches
        else:
            pieces = self.pieces(text)
        for piece in pieces:
            ids = self.known.get(piece)
            if ids is None:
                ids = self.vocabulary.encode(piece.encode("utf-8", "replace"))
                if len(piece) < 100:
                    if len(self.known) >= PIECES:
                        self.known.clear()
                    self.known[piece] = ids
            out += ids
        return np.array(out, dtype="<i4").tobytes()

    def encode_batch(self, batch: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(parts), dtype="<i4") for parts in self.table.values(batch)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> TextCodec:
    return TextCodec(read_ranks(path), pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (binary, decoded from the ids) of every whole text.

    A null text counts as empty and gives no ids.  Rows are independent: repeated rows and
    null ids come back as they are.
    """
    small_batches(docs.sparkSession)
    docs = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            rows = own.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
            flat = np.concatenate([np.empty(0, "<i4"), *rows])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)),
                    pa.array([own.decode(r.tolist()) for r in rows], pa.binary()),
                ],
                names=["doc_id", "ids", "decoded"],
            )

    return docs.mapInArrow(run, f"doc_id {id_type(docs)}, ids array<int>, decoded binary")
