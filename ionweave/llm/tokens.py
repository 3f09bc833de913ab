"""Token ids of whole texts, encoded once per distinct word of a task.

A byte-pair vocabulary never merges across the pieces into which its pattern splits a text, so
the ids of a text are those of its pieces in a row. Pieces of texts in ASCII and Latin letters
are found here by the pattern narrowed to these characters; any other text is cut before each
run of white space. Each distinct piece is encoded once by the tokenizers library and kept.
Texts with white space that libraries see differently, or with a special token, are encoded as one.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

#: White space (or what some library counts as such) other than blanks, tabs and line ends.
OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿]")
WITH_SPACE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įı-ſ"
UNKNOWN = re.compile(rf"[^\t\n\r -~{LETTERS}]")
SUFFIX = "'(?:s|t|re|ve|m|ll|d)"
BYTE_PIECES = re.compile(rf"{SUFFIX}| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
WORD_PIECES = re.compile(rf"{SUFFIX}|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")
PROBES = ("It's  a\n\nTest,of 12 \xc9l\xe9ments;  we'LL see.\t(x)\r\n ", "a b", " \xfcber-all  'tis 3.14 ")


class Encoder:
    """Encodes texts to little-endian 32-bit ids; keeps at most ``keep`` pieces."""

    def __init__(self, path: str, keep: int = 1_200_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.half, self.words, self.old = keep // 2, {}, {}
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        usual = [chr(i) for i in (9, 10, 13, *range(32, 127), *range(0xC0, 0x180))]
        #: The characters under which the vocabulary lists the bytes of a character.
        self.shown = {ord(c): level.pre_tokenize_str(c)[0][0] for c in usual}
        self.leading = any(w[0] != "b" for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str("a b")[1:])
        self.pieces, self.lower = (BYTE_PIECES, False) if self.leading else (WORD_PIECES, True)
        # The narrowed pattern is used only for vocabularies that it reproduces.
        if any(self._fast(p) != self._whole([p])[0] for p in PROBES):
            self.pieces = None

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def _piece(self, piece: str) -> bytes:
        ids = array("I", [t.id for t in self.model.tokenize(piece.translate(self.shown))])
        return ids.tobytes()

    def _join(self, parts: list[str], encode) -> bytes:
        found = list(map(self.words.get, parts))
        if None in found:
            if len(self.words) > self.half:
                self.old, self.words = self.words, {}
            words, old = self.words, self.old
            missing = {p for p, b in zip(parts, found) if b is None}
            words.update([(p, old[p]) for p in missing if p in old])
            new = [p for p in missing if p not in words]
            words.update(zip(new, encode(new)))
            found = [words[p] if b is None else b for p, b in zip(parts, found)]
        return b"".join(found)

    def _fast(self, text: str) -> bytes:
        return self._join(self.pieces.findall(text.lower() if self.lower else text), lambda new: map(self._piece, new))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as bytes."""
        if any(s in text for s in self.special) or OTHER_SPACE.search(text):
            return self._whole([text])[0]
        if self.pieces is not None and not UNKNOWN.search(text):
            return self._fast(text)
        return self._join(WITH_SPACE.findall(text), self._whole)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
