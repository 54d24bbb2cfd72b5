"""Token ids of whole columns of text: equal words of a part are looked up once, and known words stay in a dictionary.

The ids are those of ``tokens.WordTokens``, which encodes the words that the dictionary does not know. Words here end at ASCII white space; other
white space inside one is left to that encoder, and so are whole texts with control characters or strings that may be special tokens.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from sedge.llm.hashing import WHITE_SPACE, text_buffers
from sedge.llm.interning import Dictionary, Spans, interned
from sedge.llm.tokens import _PLAIN, word_tokens

KNOWN_WORDS = 1_200_000
PART_WORDS = 1 << 16
MARKS = ".,;:!?"


def _odd_rows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows with control characters on which white space is read differently, or with what may begin a special token."""
    odd = (data >= 0x1C) & (data <= 0x1F)
    odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    return np.unique(np.searchsorted(at, np.flatnonzero(odd), "right") - 1)


class ColumnTokens:
    """``encode(column)`` gives all ids one behind the other, and where each row begins (one more than rows)."""

    def __init__(self, vocabulary: str, specials: bool = True, known: int = KNOWN_WORDS):
        self._tokens, self._known = word_tokens(vocabulary, specials), Dictionary(known)
        self._piece = self._tokens._piece

    def _word(self, name: bytes) -> bytes:
        """Ids of a word that is not in the dictionary: letters, perhaps with one mark behind them, need no pattern."""
        text = name.decode()
        if text.isascii() or _PLAIN.fullmatch(text):
            low = text.lower()
            if low.isalpha():
                return self._piece(low)
            if low[:-1].isalpha() and low[-1] in MARKS:
                return self._piece(low[:-1]) + self._piece(low[-1])
        return self._tokens.encode(text)

    def _part(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of neighbouring words, and how many each has."""
        base = int(starts[0])
        part = data[base : int(starts[-1] + sizes[-1])]
        spans = Spans(part, starts - base, sizes)
        slots, first, _, hashes = interned(spans)
        entry = self._known.find(spans, first, hashes)
        missing = np.flatnonzero(entry < 0)
        raw, at, size = part.tobytes(), spans.at[first], spans.size[first]
        names = [raw[a : a + n] for a, n in zip(at[missing].tolist(), size[missing].tolist(), strict=True)]
        fresh = [self._word(name) for name in names]
        # Known values first, then those of the new words.
        many, begin = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        held = entry >= 0
        many[held], begin[held] = self._known.value_size[entry[held]], self._known.value_at[entry[held]]
        values = self._known.values
        many[missing] = [len(x) // 4 for x in fresh]
        begin[missing] = len(values) + np.cumsum(many[missing]) - many[missing]
        values = np.concatenate([values, np.frombuffer(b"".join(fresh), "<u4")]) if len(missing) else values
        counts = many[slots]
        place = np.arange(int(counts.sum())) + np.repeat(begin[slots] - (np.cumsum(counts) - counts), counts)
        ids = values[place]
        kept = [k for k, name in enumerate(names) if len(name) <= Dictionary.LONGEST]
        if kept:
            self._known.enter(hashes[missing[kept]], [names[k] for k in kept], [fresh[k] for k in kept])
        return ids, counts

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = text_buffers(column)
        data, at = data[at[0] : at[-1]], at - at[0]
        odd = _odd_rows(data, at) if len(data) else np.zeros(0, np.int64)
        word = ~WHITE_SPACE.separator[data]
        for row in odd.tolist():
            word[at[row] : at[row + 1]] = False
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        starts = np.flatnonzero(word & (~before | edge[:-1]))
        sizes = np.flatnonzero(word & (~after | edge[1:])) + 1 - starts
        parts, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(starts), PART_WORDS):
            ids, many = self._part(data, starts[k : k + PART_WORDS], sizes[k : k + PART_WORDS])
            parts.append(ids.astype(np.uint32))
            counts.append(many)
        rows = np.bincount(np.searchsorted(at, starts, "right") - 1, np.concatenate(counts), len(column)).astype(np.int64)
        ids = np.concatenate(parts)
        if len(odd):
            cut = np.split(ids, np.cumsum(rows)[odd])
            for k, row in enumerate(odd.tolist()):
                own = np.frombuffer(self._tokens.encode(data[at[row] : at[row + 1]].tobytes().decode()), "<u4")
                rows[row] = len(own)
                cut[k] = np.concatenate([cut[k], own])
            ids = np.concatenate(cut)
        return ids, np.concatenate([[0], np.cumsum(rows)])


@lru_cache(maxsize=2)
def column_tokens(vocabulary: str, specials: bool = True) -> ColumnTokens:
    """One dictionary for a worker process."""
    return ColumnTokens(vocabulary, specials)
