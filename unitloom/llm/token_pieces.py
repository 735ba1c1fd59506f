"""Exact, cached encoding with public tokenizers.

Both tokenizers below split a text into pieces before they merge, and a piece's
ids depend on the piece alone. So the ids of a text are those of its chunks one
after another as long as chunk borders are piece borders, and a chunk that was
seen before need not be encoded again. Three ways, by what a text holds:

* plain prose (Latin letters, single spaces and line breaks, a comma or full
  stop after a word): chunks are words and marks;
* other texts: chunks end at white space;
* texts with strings of special tokens, or separators on which notions of white
  space differ: encoded whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: Chunks in each of a worker's two generations of cache. Bounds memory alone, never a result.
CACHE = 300_000
#: Chunks longer than this are not kept.
LONGEST = 48
_WHOLE = re.compile("[\x1c-\x1f]|<\\|")
_BYTE_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-ÿ]++[,.]?+[ \n])*+[A-Za-zÀ-ÖØ-öø-ÿ]++[,.]?+")
_SPACED_BREAK = re.compile(r"\s\n|\n\s")
_BREAK = "\x1f"
#: Latin letters, which normalization leaves as they are, and marks behind them, a piece of their own.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKED = re.compile(f"( ?[{_LETTERS}]+)([#$%&*]+)")


def _as_models() -> dict[int, str]:
    """A space and Latin letters as the characters that byte-level models have for their UTF-8 bytes."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}
    return {c: "".join(of[b] for b in chr(c).encode()) for c in (0x20, *range(0xC0, 0x100))}


_AS_MODELS = _as_models()


def _byte_words(text: str) -> list[str]:
    """Words with the space before them, marks, line breaks."""
    for mark in (" ", ",", "."):
        text = text.replace(mark, _BREAK + mark)
    return text.replace("\n", "\x1f\n\x1f").split(_BREAK)


def _lower_words(text: str) -> list[str]:
    return text.lower().replace(",", " ,").replace(".", " .").split()


class Encoder(dict):
    """packed(text) gives a text's ids as little-endian bytes of self.dtype, as the tokenizer itself would."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[str, bytes] = {}
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 65536 else np.dtype("<u4")
        # a byte-level tokenizer keeps white space and case; the one with word ends drops white space and lowers
        self.byte_level = not self.model.end_of_word_suffix
        self.latin = re.compile(f" ?[{_LETTERS}]+" if self.byte_level else "[a-zß-öø-ÿ]+").fullmatch
        self.words, self.chunks = (_byte_words, _BYTE_CHUNK.findall) if self.byte_level else (_lower_words, str.split)

    def whole(self, text: str) -> bytes:
        return array("H" if self.dtype.itemsize == 2 else "I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        out = self.old.get(chunk)
        if out is None:
            out = self.encoded(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[chunk] = out
        return out

    def encoded(self, chunk: str) -> bytes:
        if self.latin(chunk):
            return array("H" if self.dtype.itemsize == 2 else "I", [t.id for t in self.model.tokenize(chunk.translate(_AS_MODELS))]).tobytes()
        if marked := _MARKED.fullmatch(chunk):
            return self[marked[1]] + self[marked[2]]
        return self.whole(chunk) if chunk else b""

    def packed(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, self.words(text)))
        if _WHOLE.search(text):
            return self.whole(text)
        if "\n" not in text or self.byte_level and _SPACED_BREAK.search(text):
            return b"".join(map(self.__getitem__, self.chunks(text)))
        # line by line: a line break between other characters is a piece of its own, or is dropped
        lines = [b"".join(map(self.__getitem__, (self.words if _PLAIN.fullmatch(x) else self.chunks)(x))) for x in text.split("\n")]
        return (self["\n"] if self.byte_level else b"").join(lines)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
