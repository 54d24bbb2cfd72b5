"""Byte strings as numbers: an open-addressed table in numpy with xxhash64 keys and a comparison of the bytes themselves.

Strings are spans of one buffer. All spans are hashed, looked up and entered together: every round of probing handles all spans
that are not yet settled, so the number of numpy calls depends on the longest probe and not on the number of spans.
"""

from __future__ import annotations

import numpy as np
import xxhash

PRIME_1, PRIME_2, PRIME_3, PRIME_4, PRIME_5 = (
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)  # fmt: skip  # xxhash64's fixed numbers
# Spans of so many bytes or more take another form of the hash; they are rare and go to the library one by one.
LONG = 32
PAD = 8


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


class Spans:
    """A buffer's spans; ``at`` and ``size`` in bytes. The buffer is copied once, with some bytes behind it."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: np.ndarray):
        self.data = np.concatenate([data, np.zeros(PAD, np.uint8)])
        # Eight bytes from every place on, little-endian.
        self.words = np.ndarray((len(data) + 1,), "<u8", self.data.data, strides=(1,))
        self.at, self.size = at.astype(np.int64), size.astype(np.int64)

    def __getitem__(self, k: int) -> bytes:
        return self.data[self.at[k] : self.at[k] + self.size[k]].tobytes()

    def hashes(self) -> np.ndarray:
        """xxhash64 of every span, seed 0."""
        order = np.argsort(self.size, kind="stable")
        size = self.size[order]
        at = self.at[order]
        out = np.empty(len(order), np.uint64)
        out[:] = PRIME_5 + size.astype(np.uint64)
        from_long = int(np.searchsorted(size, LONG))
        begin = 0
        while begin < from_long:  # spans of one length together
            n = int(size[begin])
            end = int(np.searchsorted(size, n, "right"))
            h, where = out[begin:end], at[begin:end]
            for k in range(n // 8):
                h ^= _turn(self.words[where + 8 * k] * PRIME_2, 31) * PRIME_1
                h[:] = _turn(h, 27) * PRIME_1 + PRIME_4
            done = n // 8 * 8
            rest = self.words[where + done] if n > done else None
            if n - done >= 4:
                h ^= (rest & np.uint64(0xFFFFFFFF)) * PRIME_1
                h[:] = _turn(h, 23) * PRIME_2 + PRIME_3
                rest = rest >> np.uint64(32)
            for _ in range((n - done) % 4):
                h ^= (rest & np.uint64(0xFF)) * PRIME_5
                h[:] = _turn(h, 11) * PRIME_1
                rest = rest >> np.uint64(8)
            begin = end
        short = out[:from_long]
        short ^= short >> np.uint64(33)
        short *= PRIME_2
        short ^= short >> np.uint64(29)
        short *= PRIME_3
        short ^= short >> np.uint64(32)
        view = memoryview(self.data)
        for k in range(from_long, len(order)):
            out[k] = xxhash.xxh64_intdigest(view[int(at[k]) : int(at[k] + size[k])])
        back = np.empty_like(out)
        back[order] = out
        return back

    def same(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether pairs of spans, given by number, hold the same bytes."""
        out = self.size[one] == self.size[other]
        pairs = np.flatnonzero(out)
        out[pairs] = equal_bytes(self.words, self.at[one[pairs]], self.words, self.at[other[pairs]], self.size[one[pairs]])
        return out


# What counts of eight bytes, by the number of bytes left.
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def equal_bytes(one: np.ndarray, at: np.ndarray, other: np.ndarray, there: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether stretches of two buffers, given as eight bytes from every place on, are the same."""
    out, pairs, done = np.ones(len(size), bool), np.flatnonzero(size > 0), 0
    while len(pairs):
        left = size[pairs] - done
        differ = ((one[at[pairs] + done] ^ other[there[pairs] + done]) & MASKS[np.minimum(left, 8)]) != 0
        out[pairs[differ]] = False
        pairs = pairs[~differ & (left > 8)]
        done += 8
    return out


def intern(spans: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot of each span, first span of each slot, spans per slot): equal spans share a slot, different ones never do."""
    slots, first, counts, _ = interned(spans)
    return slots, first, counts


def interned(spans: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``intern``, with the hash of each slot.

    Slots are numbered from 0 in the order of the table; the table has at least twice as many places as there are spans.
    """
    n = len(spans.at)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    places = 1 << int(2 * n - 1).bit_length()
    hashes = spans.hashes()
    holder = np.full(places, -1, np.int64)
    settled = np.empty(n, np.int64)
    place = (hashes & np.uint64(places - 1)).astype(np.int64)
    open_ = np.arange(n)
    while len(open_):
        at = place[open_]
        empty = holder[at] < 0
        # Written from the back, so that the first of several spans holds the place.
        holder[at[empty][::-1]] = open_[empty][::-1]
        there = holder[at]
        equal = hashes[there] == hashes[open_]
        other = np.flatnonzero(equal & (there != open_))
        equal[other] = spans.same(open_[other], there[other])
        settled[open_[equal]] = at[equal]
        open_ = open_[~equal]
        place[open_] = (place[open_] + 1) & (places - 1)
    held = np.flatnonzero(holder >= 0)
    number = np.empty(places, np.int64)
    number[held] = np.arange(len(held))
    slots = number[settled]
    return slots, holder[held], np.bincount(slots, minlength=len(held)), hashes[holder[held]]


class Dictionary:
    """Strings of up to 64 bytes with a value of a few numbers each, kept from part to part; when full it starts anew."""

    LONGEST = 64

    def __init__(self, most: int):
        self.most, self.places = most, 1 << int(2 * most).bit_length()
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.hash, self.entry = np.zeros(self.places, np.uint64), np.full(self.places, -1, np.int32)
        self.at, self.size = np.zeros(self.most + 1, np.int64), np.zeros(self.most, np.int64)
        self.value_at, self.value_size = np.zeros(self.most + 1, np.int64), np.zeros(self.most, np.int64)
        self.bytes, self.values = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint32)

    def find(self, spans: Spans, picked: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Entry of each picked span, -1 where there is none."""
        found = np.full(len(picked), -1, np.int64)
        words = np.ndarray((len(self.bytes) - PAD,), "<u8", self.bytes.data, strides=(1,))
        place, open_ = (hashes & np.uint64(self.places - 1)).astype(np.int64), np.arange(len(picked))
        while len(open_):
            entry = self.entry[place[open_]]
            there = entry >= 0
            open_, entry = open_[there], entry[there]
            right = (self.hash[place[open_]] == hashes[open_]) & (self.size[entry] == spans.size[picked[open_]])
            at = np.flatnonzero(right)
            right[at] = equal_bytes(spans.words, spans.at[picked[open_[at]]], words, self.at[entry[at]], self.size[entry[at]])
            found[open_[right]] = entry[right]
            open_ = open_[~right]
            place[open_] = (place[open_] + 1) & (self.places - 1)
        return found

    @staticmethod
    def _room(array: np.ndarray, upto: int) -> np.ndarray:
        return array if len(array) >= upto else np.concatenate([array, np.zeros(max(upto - len(array), len(array)), array.dtype)])

    def enter(self, hashes: np.ndarray, names: list[bytes], values: list[bytes]) -> None:
        """New strings, each different, with values of unsigned 32-bit numbers."""
        if self.n + len(names) > self.most:
            self.clear()
            hashes, names, values = hashes[: self.most], names[: self.most], values[: self.most]
        new = np.arange(self.n, self.n + len(names))
        self.size[new], self.value_size[new] = [len(x) for x in names], [len(x) // 4 for x in values]
        self.at[new + 1] = self.at[self.n] + np.cumsum(self.size[new])
        self.value_at[new + 1] = self.value_at[self.n] + np.cumsum(self.value_size[new])
        begin, end = (int(self.at[k]) for k in (self.n, self.n + len(names)))
        self.bytes = self._room(self.bytes, end + 2 * PAD)
        self.bytes[begin:end] = np.frombuffer(b"".join(names), np.uint8)
        begin, end = (int(self.value_at[k]) for k in (self.n, self.n + len(names)))
        self.values = self._room(self.values, end)
        self.values[begin:end] = np.frombuffer(b"".join(values), "<u4")
        place, open_ = (hashes & np.uint64(self.places - 1)).astype(np.int64), np.arange(len(new))
        while len(open_):
            free = self.entry[place[open_]] < 0
            at = open_[free]
            self.entry[place[at]] = new[at]
            won = at[self.entry[place[at]] == new[at]]
            self.hash[place[won]] = hashes[won]
            open_ = open_[self.entry[place[open_]] != new[open_]]
            place[open_] = (place[open_] + 1) & (self.places - 1)
        self.n += len(names)
