"""Exact token ids from a public tokenizer, through a cache of its pre-tokens.

Both supported tokenizers cut a text by a fixed pattern and then merge every pre-token on its own, so the ids of a text are
the ids of its pre-tokens, joined. A pre-token is given to the library once per worker and then read from the cache.
The pattern is written here for the code points below U+0250 and some punctuation, where categories, case and composition are
settled; any text with another character, and any text that holds a special token's string, goes to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CACHE = 600_000  # pre-tokens kept per worker, about 120 MB; a full cache starts anew

_PLAIN = [c for c in range(0xA1, 0x250) if c not in (0xAD, 0x130)]


def _members(kind: str) -> str:
    return "".join(chr(c) for c in _PLAIN if unicodedata.category(chr(c))[0] == kind)


_L, _N = "A-Za-z" + _members("L"), "0-9" + _members("N")
_S = "\t\n\r "
UNUSUAL = re.compile("[^\t\n\r -~" + "".join(map(chr, _PLAIN)) + "‐-‧€]")
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
# Patterns of the two tokenizers (fixed values): they must cut exactly as the files say.
BYTE_PATTERN = re.compile(f"{_SHORT}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
WORD_PATTERN = re.compile(f"{_SHORT}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def resolve(vocabulary: str) -> str:
    """A file's path; a bare name is one of the public tokenizers installed on the machine at hand."""
    if os.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


class Encoder:
    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(resolve(vocabulary))
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        byte_level = self.library.normalizer is None
        self.pattern, self.lower = (BYTE_PATTERN, False) if byte_level else (WORD_PATTERN, True)
        self.cut = self.pattern.findall
        self.letters = _byte_letters()
        self.ids: dict[str, bytes] = {}

    def plain(self, text: str) -> bool:
        return (text.isascii() and text.isprintable() or not UNUSUAL.search(text)) and not any(s in text for s in self.specials)

    def pre_tokens(self, text: str) -> list[str]:
        """Of a `plain` text."""
        return self.cut(text.lower() if self.lower else text)

    def alone(self, pieces: Sequence[str]) -> list[list[int]]:
        """Ids of each pre-token by itself: the library's merges without its cutting."""
        merge, letters = self.library.model.tokenize, self.letters
        return [[t.id for t in merge(p.encode().decode("latin-1").translate(letters))] for p in pieces]

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not self.plain(text):
            return _pack(self.library.encode(text, add_special_tokens=False).ids)
        cut, ids = self.pre_tokens(text), self.ids
        try:
            return b"".join(map(ids.__getitem__, cut))
        except KeyError:
            pass
        if len(ids) > CACHE:
            ids.clear()
        new = [p for p in set(cut) if p not in ids]
        ids.update(zip(new, map(_pack, self.alone(new)), strict=True))
        return b"".join(map(ids.__getitem__, cut))


def _pack(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


@lru_cache(maxsize=4)
def encoder(vocabulary: str) -> Encoder:
    """One per worker process and vocabulary."""
    return Encoder(vocabulary)
