"""Exact, fast encoding with public tokenizer files: each distinct word is encoded once a worker.

The tokenizers library spends most of its time on words that it has met before. Both vocabularies
split a text at certain white space before they merge anything, so a text's ids are its words' ids
joined. A worker keeps encoded words (as little-endian 32-bit ids) in two generations, each bounded
in bytes; texts whose white space does not allow the shortcut go to the library whole. A worker
outlives its tasks, so it holds the encoder of one file only, the last one asked for.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

#: The files for which words alone are known to give a text's ids (fixed values).
KNOWN = ("byte_bpe_50k.json", "word_bpe_49k.json")
#: Bytes that one generation of the words of a kind may hold.
GENERATION = 48 << 20
#: Bytes of an entry besides its characters: two bytes objects' heads and its share of the table.
_ENTRY = 2 * 33 + 110
#: Longer words are not kept.
_LONGEST = 1 << 10
_SPACE = re.compile(r"\s|[\x1c-\x1f\x85]")
#: Latin letters in UTF-8: A-Z, a-z and U+00C0 to U+00FF but for the two signs among them.
_LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(24)]


def _shown() -> dict[int, int]:
    """Byte-level vocabularies write each byte as a visible character."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in kept]
    return {b: b for b in kept} | {b: 256 + k for k, b in enumerate(moved)}


_SHOWN = _shown()
_LOADED: dict[str, "Encoder"] = {}


class _Odd(Exception):
    """A word that needs its surroundings: white space other than a blank or line feed."""


class _Words(dict):
    """Ids by word; a word met for the first time is taken from the older words or made."""

    def __init__(self, make, old: dict[bytes, bytes]):
        super().__init__()
        self.make, self.old, self.held = make, old, 0

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= _LONGEST:
            self[word] = ids
            self.held += _ENTRY + len(word) + len(ids)
            if self.held >= GENERATION:
                self._age()
        return ids

    def _age(self) -> None:
        """What is held becomes the older generation; the one before it goes."""
        self.old = dict(self)
        self.clear()
        self.held = 0


class Encoder:
    """Encodes whole texts to bytes of little-endian 32-bit ids, equal to the library's result.

    ``spaced``: byte-level vocabularies that keep white space, where a blank belongs to the next
    word. Otherwise white space only parts words. Which one holds is read from the file.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        name = os.path.basename(path)
        #: Other files might not split at white space, or merge otherwise: their texts go to the library whole.
        self.known = name in KNOWN
        probe = self.tokenizer.encode("a a", add_special_tokens=False).ids
        self.spaced = probe[0] != probe[-1]
        self._merge = self.tokenizer.model.tokenize
        #: By kind of word: after a blank, first in its line.
        self.young = [_Words(self._after_blank, {}), _Words(self._first, {})]
        self.newline, *marks = self._ids(["\n", ".", ","])
        self.marks = dict(zip((b".", b","), marks))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _after_blank(self, word: bytes) -> bytes:
        return self._make(self.young[0], word, self.spaced)

    def _first(self, word: bytes) -> bytes:
        return self._make(self.young[1], word, False)

    def _make(self, words: _Words, word: bytes, blank: bool) -> bytes:
        """A word's ids. Of Latin letters alone the vocabulary's merges decide, without its other stages."""
        mark = word[-1:]
        stem = word[:-1] if mark in self.marks else word
        if stem.isalpha() or _LATIN.fullmatch(stem):
            if stem is not word:
                return words[stem] + self.marks[mark]
            if not self.spaced:
                stem = stem.decode().lower().encode()
            piece = stem.decode() if stem.isascii() else stem.decode("latin-1").translate(_SHOWN)
            ids = [t.id for t in self._merge("\u0120" + piece if blank else piece)]
            return _PACKERS[len(ids)](*ids) if len(ids) < len(_PACKERS) else struct.pack(f"<{len(ids)}I", *ids)
        text = word.decode("utf-8", "surrogatepass")
        if self.spaced and (not text or _SPACE.search(text)):
            raise _Odd
        return self._ids([" " + text if blank else text])[0]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; null counts as empty."""
        if not self.known:
            return self._ids([t or "" for t in texts])
        one = self._spaced if self.spaced else self._parted
        return [one(t or "") for t in texts]

    def _parted(self, text: str) -> bytes:
        return b"".join(map(self.young[0].__getitem__, text.encode("utf-8", "surrogatepass").split()))

    def _spaced(self, text: str) -> bytes:
        first, get, lines = self.young[1], self.young[0].__getitem__, []
        try:
            for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
                words = iter(line.split(b" "))
                lines.append(first[next(words)] + b"".join(map(get, words)))
        except _Odd:
            return self._ids([text])[0]
        return self.newline.join(lines)


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file; another file's goes first."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
