"""Token counts under a unigram vocabulary without building the tokens.

An Aho-Corasick automaton enumerates, at each position of a word, the vocabulary entries
that end there; a Viterbi pass keeps only the best score and the number of pieces of the
best segmentation of each prefix.  Ties go to the entry that starts first, and a character
that no entry covers alone costs the lowest score less ten, as in the tokenizers library's
Unigram model; such runs count once (fused) or, with byte fallback, once per byte.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.llm.common import id_type, small_batches, texts

#: What an unknown character costs below the lowest score of the vocabulary: a fixed value of the model.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"
#: Words kept per worker before the table starts afresh.
WORDS = 400_000


class UnigramCounter:
    """Counts the pieces of a text for a vocabulary of (piece, score)."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.singles = set()
        names = set()
        for piece, score in vocabulary:
            names.add(piece)
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), float(score)))
            if len(piece) == 1:
                self.singles.add(piece)
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.known: dict[str, int] = {}

    def count_word(self, word: str) -> int:
        """Pieces of the best segmentation of ``word``, which already has its space marks."""
        n = len(word)
        score, pieces = [0.0] * (n + 1), [0] * (n + 1)
        ends_unknown = bytearray(n + 1)
        found: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for last, match in self.automaton.iter(word):
            found[last].append(match)
        for last, char in enumerate(word):
            end, best = last + 1, None
            # The longest entry starts first, and only a strictly better score replaces it.
            for length, value in sorted(found[last], reverse=True):
                start = end - length
                total = score[start] + value
                if best is None or total > best:
                    best, score[end], pieces[end] = total, total, pieces[start] + 1
            if char not in self.singles:
                total = score[last] + self.unknown
                if best is None or total > best:
                    score[end], ends_unknown[end] = total, 1
                    if self.bytes:
                        pieces[end] = pieces[last] + len(char.encode("utf-8", "surrogatepass"))
                    else:
                        pieces[end] = pieces[last] + (not ends_unknown[last])
        return pieces[n]

    def count(self, text: str) -> int:
        """Pieces of ``text``: spaces become marks, one is put in front, and each starts a word."""
        if not text:
            return 0
        known, total = self.known, 0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:
            words = words[1:]  # the text has its mark already
        for word in words:
            got = known.get(word)
            if got is None:
                got = self.count_word(SPACE + word)
                if len(word) < 200:
                    if len(known) >= WORDS:
                        known.clear()
                    known[word] = got
            total += got
        return total


@functools.lru_cache(maxsize=2)
def counter_for(path: str) -> UnigramCounter:
    """The pieces and scores of a sentencepiece file, read as a unigram vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    return UnigramCounter([(model.id_to_piece(i), model.get_score(i)) for i in range(size)])


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens (long) and n_chars (long) of every whole text; null and empty texts have none.

    Rows are independent: repeated rows and null ids come back as they are.
    """
    small_batches(docs.sparkSession)
    docs = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(path)
        for batch in batches:
            rows = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.array([counter.count(t) for t in rows], dtype=np.int64)),
                    pa.array(np.array([len(t) for t in rows], dtype=np.int64)),
                ],
                names=["doc_id", "n_tokens", "n_chars"],
            )

    return docs.mapInArrow(run, f"doc_id {id_type(docs)}, n_tokens long, n_chars long")
