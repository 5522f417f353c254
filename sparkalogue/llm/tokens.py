"""Encoding whole texts with a public tokenizer file, with a worker-side memory of frequent chunks."""

from __future__ import annotations

import re
import sys
from array import array
from operator import attrgetter

import numpy as np

#: Two white-space characters beside each other: there a plain space needn't be where the tokenizer cuts.
_DOUBLE = re.compile(r"\s\s")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Pieces and chunks remembered by a worker before it starts over.
REMEMBER = 600_000
_id, _SWAP = attrgetter("id"), sys.byteorder == "big"
#: Letters that every version of Unicode agrees on, and marks that make a pre-token of their own after letters.
_LETTERS, _MARKS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+"), frozenset(".,;:!?")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to encoding each text in one piece.

    A byte-level tokenizer of this family always begins a new pre-token at a single space
    that stands between two other characters. Text between such spaces (a chunk) is cut by
    the tokenizer's published pattern into pre-tokens (pieces); the library's model encodes
    each piece once and the worker remembers it. Wherever white space touches white space
    it stays within one chunk, and texts that hold a special token go to the library whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.pattern = self.tokenizer.model, regex.compile(public_tokenizers.PATTERN)
        self.letters = _byte_letters()
        self.space = self.letters[0x20]
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        return self._spelled(piece.encode().decode("latin-1").translate(self.letters))

    def _spelled(self, letters: str) -> bytes:
        ids = array("I", map(_id, self.model.tokenize(letters)))
        if _SWAP:
            ids.byteswap()
        return ids.tobytes()

    def _pieces(self, chunk: str) -> bytes:
        known, out = self.pieces, []
        for p in self.pattern.findall(chunk):
            if p not in known:
                known[p] = self._ids(p)
            out.append(known[p])
        return b"".join(out)

    def _chunk(self, word: str) -> bytes:
        """Ids of a space and the word after it."""
        if _LETTERS.fullmatch(word):
            # ASCII letters stand for themselves
            ids = self._spelled(self.space + word) if word.isascii() else self._ids(" " + word)
        elif word[-1:] in _MARKS and _LETTERS.fullmatch(word, 0, len(word) - 1):
            ids = (self.chunks.get(word[:-1]) or self._chunk(word[:-1])) + self._pieces(word[-1])
        else:
            ids = self._pieces(" " + word)
        self.chunks[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if len(self.pieces) > REMEMBER:
                self.pieces.clear()
            if len(self.chunks) > REMEMBER:
                self.chunks.clear()
            if any(s in t for s in self.special):
                ids = self.tokenizer.encode(t, add_special_tokens=False).ids
                out.append(np.array(ids, dtype="<u4").tobytes())
                continue
            words = _SAFE.split(t) if _DOUBLE.search(t) else t.split(" ")
            known, make = self.chunks.get, self._chunk
            ids = [known(w) or make(w) for w in words]
            ids[0] = self._pieces(words[0])
            out.append(b"".join(ids))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
