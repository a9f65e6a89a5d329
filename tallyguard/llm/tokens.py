"""Token ids of whole texts with a byte-level BPE of the tokenizers library.

The merges of a byte-level BPE never cross the pieces of its splitting pattern, so the ids of a
text are the ids of its pieces one after another. Words repeat, and each worker remembers the
ids of the pieces it has met; only new pieces are given to the library.
"""

from __future__ import annotations

import os
import re
import struct

# The letters and numbers below U+0250, by Unicode category.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"

# Parts of these characters only are split here; all others are split by the library.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-ɏ]*")
_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+"
)
# One space between two characters that aren't white space always begins a new piece.
_WORDS = re.compile(r"(?<=\S)(?= \S)")
_SPACES = re.compile(r"\s\s")

_LETTERS = re.compile(f"[{_LETTER}]+")

CACHED_PIECES = 1_000_000
CACHED_LENGTH = 48

_encoders: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for
    themselves, the others follow from U+0100 on in their order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class _Remembered(dict):
    """Ids of pieces, as little-endian unsigned 32-bit numbers. It starts anew when it is full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes texts with the tokenizer file at ``path``; no special tokens are added, and the
    strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.pieces = _Remembered(self._piece)
        self.words = _Remembered(self._word)

    def _piece(self, piece: str) -> bytes:
        spelled = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        ids = [token.id for token in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """A word with the space before it; letters and what follows them are remembered apart."""
        letters = _LETTERS.match(word)
        if letters is None:
            return self._part(" " + word)
        end = letters.end()
        if end == len(word):
            return self._piece(" " + word)
        if word[end] in ".,;:!?)":
            return self.words[word[:end]] + self._part(word[end:])
        return self._part(" " + word)

    def _part(self, text: str) -> bytes:
        """A part of a text between two borders of pieces."""
        if _PLAIN.fullmatch(text):
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text)))
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a text; null counts as empty."""
        if not text:
            return b""
        if _SPACES.search(text) is None:
            first, *rest = text.split(" ")
        else:
            first, *rest = _WORDS.split(text)
            rest = [part[1:] for part in rest]
        return self._part(first) + b"".join(map(self.words.__getitem__, rest))


def encoder(path: str) -> Encoder:
    """The encoder of this worker for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    """The byte-level BPE with 50,257 ids that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
