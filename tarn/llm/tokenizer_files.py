"""Tokenizers from public vocabulary files; their path is a parameter, nothing is trained."""

from __future__ import annotations

import functools
import json
import os
import struct

from tarn.llm.chunks import ChunkTable

#: Pieces kept in a worker before the table starts afresh.
PIECES = 400_000
#: Below this, letters, cases, composition and their Unicode properties are the same in all versions.
STEADY = "\u0250"


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def piece_pattern(steps: dict) -> tuple[str, bool] | None:
    """The pattern whose matches are encoded each alone and whether to lower-case first, for two known set-ups.

    Either no normalizer and the byte-level pre-tokenizer with its own pattern, or (NFC,
    white space, lower case) and matches of a given pattern as bytes.  None for any other.
    """
    normalizer, pre = steps.get("normalizer"), steps.get("pre_tokenizer") or {}
    if normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre["add_prefix_space"]:
        import public_tokenizers

        return public_tokenizers.PATTERN, False
    kinds = [n["type"] for n in (normalizer or {}).get("normalizers", [])]
    parts = pre.get("pretokenizers", [])
    if kinds == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"]:
        split, level = parts
        if split["invert"] and split["behavior"] == "Removed" and not level["use_regex"]:
            return split["pattern"]["Regex"], True
    return None


@functools.lru_cache(maxsize=4)
def id_bytes(path: str, glue: bool) -> ChunkTable:
    """Table from chunk to its ids (little-endian unsigned 32 bit) by the tokenizers library.

    One per worker and file, kept across tasks.  Unseen chunks of plain letters are split
    into their pieces, which go to the library's model one by one and are kept as well; any
    other chunk takes the library's whole way.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    with open(path, encoding="utf-8") as file:
        steps = json.load(file)
    known: dict[str, bytes] = {}
    letters = byte_letters()
    packed = [i.to_bytes(4, "little") for i in range(1 + max(tokenizer.get_vocab().values(), default=0))]
    found = piece_pattern(steps)
    pieces = regex.compile(found[0]).findall if found else None
    lower = bool(found and found[1])
    special = [t["content"] for t in steps.get("added_tokens", [])]
    if not all("<" in s for s in special):
        pieces = None  # such tokens could hide in any chunk

    def whole(chunk: str) -> bytes:
        ids = tokenizer.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_piece(piece: str) -> bytes:
        own = known.get(piece)
        if own is None:
            plain = piece.isascii() and piece.isprintable()
            tokens = model.tokenize(
                piece.replace(" ", letters[32]) if plain else "".join([letters[b] for b in piece.encode()])
            )
            own = b"".join([packed[t.id] for t in tokens])
            if len(piece) <= 100:
                if len(known) >= PIECES:
                    known.clear()
                known[piece] = own
        return own

    def by_piece(chunk: str) -> bytes:
        if lower:
            chunk = chunk.lower()
        word, stop = (chunk[:-1], chunk[-1]) if chunk[-1:] in (".", ",") else (chunk, "")
        if (word[1:] if word[:1] == " " else word).isalpha():  # one word, and perhaps one stop: two matches
            return encode_piece(word) + encode_piece(stop) if stop else encode_piece(word)
        return b"".join(map(encode_piece, pieces(chunk)))

    def encode_many(chunks: list[str]) -> list[bytes]:
        if pieces is None:
            return [whole(c) for c in chunks]
        return [
            by_piece(c)
            if (c.isascii() or max(c) < STEADY) and ("<" not in c or not any(s in c for s in special))
            else whole(c)
            for c in chunks
        ]

    return ChunkTable(encode_many, glue, parts=bool(pieces) and not lower, special=special)
