"""64-bit hashes of the words and word shingles of Arrow text columns, without a Python object per word.

A word's hash is a polynomial in its bytes, read off running sums over the whole slice of text;
shingle hashes combine neighbouring words. Equal words have equal hashes everywhere; different ones
collide with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
# Fixed odd numbers: the polynomial's base and the finaliser's factors.
BASE, FACTOR_1, FACTOR_2, STEP = (np.uint64(x) for x in (0x9E3779B97F4A7C55, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * FACTOR_1
    x = (x ^ (x >> np.uint64(27))) * FACTOR_2
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(x: int) -> np.uint64:
    return np.uint64(pow(int(x), -1, 1 << 64))


@dataclass(frozen=True)
class Alphabet:
    """Which bytes separate words, and what each byte counts as."""

    separator: np.ndarray
    value: np.ndarray
    latin: bool

    @classmethod
    def of(cls, separators: bytes, latin: bool) -> "Alphabet":
        """A-Z count as a-z; with ``latin``, so do the capitals of Latin-1."""
        value = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        value[ord("A") : ord("Z") + 1] = value[ord("a") : ord("z") + 1]
        separator = np.zeros(256, bool)
        separator[list(separators)] = True
        return cls(separator, value, latin)


WHITE_SPACE = Alphabet.of(b" \t\n\x0b\x0c\r", latin=False)
LETTERS = Alphabet.of(bytes(b for b in range(128) if not chr(b).isalnum()), latin=True)


class _Tables:
    """Powers of the base and of its inverse, grown when a slice is longer."""

    up = _powers(BASE, 1)
    down = _powers(_inverse(BASE), 1)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            up, down = _powers(BASE, n), _powers(_inverse(BASE), n)
            if n > 4 * SLICE_BYTES:  # for one very long word only
                return up, down
            cls.up, cls.down = up, down
        return cls.up[:n], cls.down[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and its rows' offsets; null is empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def _slices(data: np.ndarray, at: np.ndarray, separator: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about SLICE_BYTES that end at a row's end or behind a separator."""
    begin, last = int(at[0]), int(at[-1])
    while begin < last:
        end = min(begin + SLICE_BYTES, last)
        if end < last:
            row = int(np.searchsorted(at, end, "right")) - 1
            if at[row] > begin:
                end = int(at[row])
            else:
                stop = int(at[row + 1])
                while end < stop and not separator[data[end - 1]]:
                    ahead = np.flatnonzero(separator[data[end : min(end + SLICE_BYTES, stop)]])
                    end = end + int(ahead[0]) + 1 if len(ahead) else min(end + SLICE_BYTES, stop)
        yield begin, end
        begin = end


def word_hashes(column: pa.Array, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each row the number of words before it (one more than rows)."""
    hashes, begins, _, _ = words_of(column, alphabet)
    return hashes, begins


def words_of(column: pa.Array, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes``, with each word's number of bytes and its last byte."""
    data, at = text_buffers(column)
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    sizes, lasts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for begin, end in _slices(data, at, alphabet.separator):
        part = data[begin:end]
        word = ~alphabet.separator[part]
        if alphabet.latin:
            part = part.copy()
            capital = np.flatnonzero((part[1:] >= 0x80) & (part[1:] <= 0x9E) & (part[1:] != 0x97) & (part[:-1] == 0xC3)) + 1
            part[capital] += 0x20
        edge = np.zeros(len(part) + 1, bool)
        inside = at[np.searchsorted(at, begin) : np.searchsorted(at, end, "right")] - begin
        edge[inside] = True
        edge[0] = edge[-1] = True
        before = np.empty(len(part), bool)
        before[0] = False
        before[1:] = word[:-1]
        starts = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.empty(len(part), bool)
        after[-1] = False
        after[:-1] = word[1:]
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        up, down = _Tables.upto(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(alphabet.value[part] * up[:-1], out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        rows.append(np.searchsorted(at, starts + begin, "right") - 1)
        sizes.append(ends - starts)
        lasts.append(part[ends - 1])
    begins = np.searchsorted(np.concatenate(rows), np.arange(len(at)))
    return np.concatenate(hashes), begins, np.concatenate(sizes), np.concatenate(lasts)


def runs_of(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbouring words, rows disregarded."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    factors = _powers(STEP, n + 1)
    for k in range(n):
        out += words[k : len(words) - n + 1 + k] * factors[k + 1]
    return mix(out + np.uint64(n))


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its n-word shingles; with fewer words, of the whole sequence; without any, nothing."""
    words, begins = word_hashes(column, WHITE_SPACE)
    runs = runs_of(words, n)
    for k in range(len(column)):
        begin, end = int(begins[k]), int(begins[k + 1])
        if end - begin >= n:
            own = np.sort(runs[begin : end - n + 1])
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            yield own[fresh]
        else:
            yield runs_of(words[begin:end], end - begin) if end > begin else words[:0]
