"""Token ids of whole texts with the public word vocabulary, cached per word.

The vocabulary's pre-tokenizer never joins two words across white space, so a text's
ids are its words' ids in order. Words repeat, so a worker keeps the ids of the words it
has seen (at most ``CACHE_WORDS``; the cache is emptied when full, which changes
the time and not the ids). Anything outside plain Latin words goes to the full tokenizer.
"""

from __future__ import annotations

import array
import os
import re
import sys
import unicodedata
from functools import lru_cache

CACHE_WORDS = 300_000
END_OF_TEXT = 49407

_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
# Words in which lower-casing, composition and letter classes are beyond doubt.
_PLAIN = re.compile(r"[!-~¡-¨«¬®¯°±´¶-¸»¿-ÖØ-öø-ÿŒœŸ]+")
# Control characters on which white space is read differently, and special tokens' strings.
_ODD = re.compile(r"[\x1c-\x1f]|<\|")


def _byte_letters() -> dict[int, int]:
    """The letter a byte-level vocabulary writes for each byte: itself if printable, else the next free code."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(hidden)}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens:
    """``encode(text)`` gives the text's ids as little-endian unsigned 32-bit integers.

    Without ``specials``, the strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, specials: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._full = Tokenizer.from_file(path)
        self._full.encode_special_tokens = not specials
        self._model = self._full.model
        self._letters = _byte_letters()
        self._words: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    @staticmethod
    def _packed(ids) -> bytes:
        out = array.array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _whole(self, text: str) -> bytes:
        return self._packed(self._full.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        known = self._pieces.get(piece)
        if known is None:
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._letters)
            known = self._packed([t.id for t in self._model.tokenize(letters)])
            if len(self._pieces) >= CACHE_WORDS:
                self._pieces.clear()
            self._pieces[piece] = known
        return known

    def _word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and unicodedata.is_normalized("NFC", word):
            known = b"".join([self._piece(p) for p in _PIECES.findall(word.lower())])
        else:
            known = self._whole(word)
        if len(self._words) >= CACHE_WORDS:
            self._words.clear()
        if len(word) <= 64:
            self._words[word] = known
        return known

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD.search(text):
            return self._whole(text)
        seen = self._words.get
        return b"".join([seen(w) or self._word(w) for w in text.split()])


@lru_cache(maxsize=2)
def word_tokens(path: str, specials: bool = True) -> WordTokens:
    """One tokenizer and cache for a worker process."""
    return WordTokens(path, specials)
