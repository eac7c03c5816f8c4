"""Token ids by the tokenizers library, with a bounded memory of whitespace-delimited pieces.

Both supported tokenizer layouts never form a token across a piece border (a
piece is a run of non-space characters, with the single space before it where
the layout keeps spaces), so the ids of a text are the ids of its pieces in
order. Anything outside the layouts or characters for which that was shown goes
through the library's full encode.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Callable

from trifold.llm.common import release_memory

#: Characters whose class (letter, digit, other) and lower case are the same in every Unicode version.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIGNS = r"!-/:-@\[-`{-~"
_KNOWN = re.compile(f" ?[{_LETTERS}0-9{_SIGNS}]+")
#: The separators U+001C to U+001F are white space to Python only; "<|" may begin a special token.
_ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_SIGN_SET = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: A word with the space before it, or white space as the byte-level layout groups it.
_RUNS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Bytes that a generation of the main memory and of the small ones may hold, what an entry takes besides its
#: characters and ids, and the longest piece that is remembered.
_MAIN, _SMALL, _ENTRY, _LONGEST = 64 << 20, 4 << 20, 160, 64


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Memory(dict):
    """A cache of two generations, each bounded in bytes; recently used entries stay, and long pieces never enter."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit, self.old, self.size = make, limit, {}, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= _LONGEST:
            self.size += _ENTRY + len(piece) + len(ids)
            if self.size > self.limit:
                self.old, self.size = dict(self), 0
                self.clear()
            self[piece] = ids
        return ids


def _layout(path: str) -> dict:
    """The tokenizer file without its model, whose vocabulary would take tens of MB as Python objects."""
    with open(path, encoding="utf-8") as f:
        head, model, rest = f.read().partition('"model"')
    try:
        return json.loads(head.rstrip().rstrip(",") + "}")
    except ValueError:
        return json.loads(head + model + rest)


class _Odd(Exception):
    """A piece with white space inside, or an empty one: the text takes the general way."""


class Encoder:
    """text -> ids as little-endian unsigned 32-bit bytes, equal to Tokenizer.encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        layout = _layout(path)
        before, normal = layout["pre_tokenizer"] or {}, layout["normalizer"] or {}
        steps = [x["type"] for x in normal.get("normalizers", [])]
        pieces = [x["type"] for x in before.get("pretokenizers", [])]
        self.spaces = self.lower = False
        self.encode = self.whole
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not normal:
            self.spaces, self.encode = True, self._with_spaces
            self.parts = re.compile(f"{_CONTRACTIONS}| ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+").findall
        elif steps == ["NFC", "Replace", "Lowercase"] and pieces == ["Split", "ByteLevel"]:
            self.lower, self.encode = True, self._without_spaces
            self.parts = re.compile(f"{_CONTRACTIONS}|[{_LETTERS}]+|[0-9]|[{_SIGNS}]+").findall
        self.letters = dict(enumerate(_byte_letters()))
        self.tokenize = self.tokenizer.model.tokenize
        self.of_part = _Memory(self._part, _SMALL)
        self.of_piece = _Memory(self._piece, _SMALL if self.spaces else _MAIN)
        self.of_spaced = _Memory(lambda piece: self._piece(piece, " "), _MAIN)
        self.newline = self.whole("\n") if self.spaces else b""

    def _part(self, part: str) -> bytes:
        spelled = part.replace(" ", self.letters[32]) if part.isascii() else part.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(spelled)]).tobytes()

    def _piece(self, piece: str, before: str = "") -> bytes:
        if self.lower:
            if not piece.isascii() and _KNOWN.fullmatch(piece) is None:
                return self.whole(piece)
            if not piece.islower() and (lower := piece.lower()) != piece:
                return self.of_piece[lower]
        core = piece.rstrip(_SIGN_SET)
        if core.isalpha() and (core.isascii() or max(core) < "\u00ff" and _KNOWN.fullmatch(core)):
            if len(core) == len(piece):
                return self._part(before + core)
            return (self.of_spaced if before else self.of_piece)[core] + self.of_part[piece[len(core) :]]
        if piece.split() != [piece]:
            raise _Odd
        piece = before + piece
        if _KNOWN.fullmatch(piece) is None:
            return self.whole(piece)
        return b"".join(map(self.of_part.__getitem__, self.parts(piece)))

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _without_spaces(self, text: str) -> bytes:
        if any(map(text.__contains__, _ODD)):
            return self.whole(text)
        return b"".join(map(self.of_piece.__getitem__, text.split()))

    def _with_spaces(self, text: str) -> bytes:
        if any(map(text.__contains__, _ODD)):
            return self.whole(text)
        try:
            if "\n\n" in text:
                raise _Odd
            lines = []
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                lines.append(self.of_piece[first] + b"".join(map(self.of_spaced.__getitem__, rest)))
            return self.newline.join(lines)
        except _Odd:
            return b"".join(self.whole(x) if x[-1].isspace() else self.of_spaced[x[1:]] if x[0] == " " else self.of_piece[x] for x in _RUNS.findall(text))

    @property
    def largest_id(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True) - 1


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept between tasks."""
    made = Encoder(path)
    release_memory()
    return made


def forget_encoder() -> None:
    """Drop the worker's encoder, in stages that follow the encoding."""
    encoder.cache_clear()
    release_memory()
