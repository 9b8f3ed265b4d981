"""Encoding by the tokenizers library with a bounded memo of pieces, for use inside tasks.

A text is cut where its tokenizer always starts a new word, each new piece is encoded by the library, and the ids are joined. A
piece that is plainly one word and punctuation goes to the library's model directly; all others go through its whole encode."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable

MEMO_PIECES = 500_000
_held: dict[tuple, Encoder] = {}


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


_CUT = re.compile(r"(?= \S)")
_BLANKS = re.compile(r"[ \t\n\r\x0b\x0c]+")
#: Letters of the Latin blocks, then marks that are neither letters, digits, white space nor apostrophes.
_PLAIN = re.compile(r"( ?)([^\W\d_İɐ-\U0010ffff]*)([.,;:!?#$%&*|<>()\"-]*)")


def before_words(text: str) -> list[str]:
    """Pieces cut before each space that a non-space follows (and round lone line ends): a byte-level tokenizer always starts a word there."""
    plain = text.replace("\n", "").isprintable() and not text.endswith((" ", "\n")) and not any(x in text for x in ("  ", " \n", "\n ", "\n\n"))
    if plain:  # the only white space is single spaces and line ends; U+0001 isn't printable, so it isn't there
        return text.replace("\n", "\x01\n\x01").replace(" ", "\x01 ").split("\x01")
    return [x for x in _CUT.split(text) if x]


def between_blanks(text: str) -> list[str]:
    """Pieces between ASCII white space, which a tokenizer that drops white space never joins."""
    return text.split() if text.isascii() and "\x1c" not in text and "\x1d" not in text and "\x1e" not in text and "\x1f" not in text else _BLANKS.split(text)


def byte_letters() -> list[str]:
    """The printable letter that byte-level tokenizers write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Memo(dict):
    """Ids of pieces; what the last two generations of MEMO_PIECES each don't hold is encoded."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        self.make, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.make(piece)
        if len(self) >= MEMO_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class Encoder:
    """Ids of texts as little-endian integers. ``lower``: the tokenizer lower-cases and drops white space."""

    def __init__(self, path: str, cut: Callable[[str], list[str]], dtype: str, lower: bool) -> None:
        self.tokenizer, self.cut, self.lower = tokenizer(path), cut, lower
        self.code = {"<u2": "H", "<u4": "I"}[dtype]
        self.model, self.letters, self.memo = self.tokenizer.model, byte_letters(), Memo(self._piece)

    def _word(self, word: str) -> bytes:
        if word.isascii():
            text = "\u0120" + word[1:] if word[0] == " " else word
        else:
            text = "".join(map(self.letters.__getitem__, word.encode()))
        return array(self.code, [t.id for t in self.model.tokenize(text)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        plain = _PLAIN.fullmatch(piece)
        if not piece:
            return b""
        if plain is None or piece == " ":
            return array(self.code, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        space, word, marks = plain.groups()
        if self.lower:
            space, word = "", word.lower()
        if not word or not marks:
            return self._word(space + word + marks)
        return self.memo[space + word] + self.memo[marks]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        get = self.memo.__getitem__
        return [b"".join(map(get, self.cut(x))) for x in texts]


def encoder(path: str, cut: Callable[[str], list[str]], dtype: str, lower: bool) -> Encoder:
    """One of each kind in a worker process."""
    key = (path, cut.__name__, dtype, lower)
    if key not in _held:
        _held[key] = Encoder(path, cut, dtype, lower)
    return _held[key]
