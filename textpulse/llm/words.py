"""Token ids of whole texts by a tokenizer file, word by word through a bounded memory of words.

The tokenizer drops white space and never joins characters across it, so the ids of a text are those of its
words in turn. Words of plain letters, digits and marks are split as the file's own pattern says and their
parts go to the library's BPE model; any other word goes to the library as it is. Tests hold the ids against
the library's for whole texts.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: Words kept per process; beyond that, words are encoded anew in each batch.
KEPT_WORDS = 800_000
# Characters for which normalisation and classes are the same in any Unicode version.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
# The split pattern of the tokenizer file, over the plain characters above.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
# Python splits at these controls, the tokenizer doesn't.
_CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder(dict):
    """Word -> row of its ids. Looking a word up adds it."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.kept = kept
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.simple = self._is_simple()
        self.ids = array("I")
        self.start = array("q", [0])
        self.extra: list[str] = []

    def _is_simple(self) -> bool:
        """True if the file's own steps split a sample as the patterns here do; else words go to the library."""
        sample = "Ab'LL don't 12x3 -- É!ßý <b>&amp; Q'S÷×"
        return all(self._by_parts(w) == self._by_library(w) for w in sample.split() if _PLAIN.fullmatch(w))

    def _by_library(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _by_parts(self, word: str) -> list[int]:
        out = []
        for part in _PARTS.findall(word.lower()):
            if not part.isascii():
                part = part.encode().decode("latin-1").translate(self.letters)
            out.extend(t.id for t in self.model.tokenize(part))
        return out

    def __missing__(self, word: str) -> int:
        plain = self.simple and "<|" not in word and _PLAIN.fullmatch(word)
        self.ids.extend(self._by_parts(word) if plain else self._by_library(word))
        row = len(self.start) - 1
        self.start.append(len(self.ids))
        self[word] = row
        if row >= self.kept:
            self.extra.append(word)
        return row

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, unsigned 32-bit."""
        rows: list[np.ndarray | None] = []
        whole = {}
        look = self.__getitem__
        for k, text in enumerate(texts):
            if any(c in text for c in _CONTROLS):
                whole[k] = np.array(self._by_library(text), np.uint32)
                rows.append(None)
            else:
                rows.append(np.fromiter(map(look, text.split()), np.int64))
        out = []
        ids, start = np.frombuffer(self.ids, np.uint32) if self.ids else np.zeros(0, np.uint32), np.frombuffer(self.start, np.int64)
        for k, r in enumerate(rows):
            if r is None:
                out.append(whole[k])
                continue
            first = start[r]
            size = start[r + 1] - first
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            out.append(ids[np.repeat(first - (ends - size), size) + np.arange(total)])
        del ids, start  # arrays that are looked at can't grow
        self._forget()
        return out

    def _forget(self) -> None:
        """Keep the first words only, so that the memory stays bounded."""
        if self.extra:
            for word in self.extra:
                del self[word]
            del self.start[self.kept + 1 :]
            del self.ids[self.start[-1] :]
            self.extra = []


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, kept: int = KEPT_WORDS) -> WordEncoder:
    """One encoder per process and file."""
    if (path, kept) not in _ENCODERS:
        _ENCODERS[path, kept] = WordEncoder(path, kept)
    return _ENCODERS[path, kept]
