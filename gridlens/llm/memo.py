"""A growing set of byte strings that numbers its members, looked up many at a time by 64-bit hashes and compared byte by byte."""

from __future__ import annotations

import numpy as np

from gridlens.llm import textkit as K

#: Bytes of a string up to which it is kept.
KEPT_BYTES = 256


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """At least n entries, by doubling."""
    if n <= len(x):
        return x
    out = np.zeros(max(n, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


class Memo:
    """Open addressing: ``slots`` holds numbers of ``keys``, at most a third of it in use; ``body`` holds the strings, eight bytes an entry."""

    def __init__(self):
        self.n = 0
        self.keys = np.zeros(1 << 12, np.uint64)
        self.slots = np.full(1 << 14, -1, np.int32)
        self.sizes = np.zeros(1 << 12, np.uint16)
        self.begin = np.zeros((1 << 12) + 1, np.int64)
        self.body = np.zeros(1 << 14, np.uint64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the members of these hashes; -1 of others."""
        mask = len(self.slots) - 1
        slot = (hashes & np.uint64(mask)).astype(np.int64)
        out = self.slots[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != hashes))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            out[todo] = self.slots[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[out[todo]] != hashes[todo])]
        return out

    def same(self, numbers: np.ndarray, view: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each span has the bytes of the member of its number; ``view`` is what ``eights`` makes of the data."""
        sizes = ends - starts
        out = self.sizes[numbers] == sizes
        base = self.begin[numbers]
        for k, (at, part) in enumerate(K.lanes(view, starts, np.where(out, sizes, 0))):
            out[at] &= self.body[base[at] + k] == part
        return out

    def add(self, hashes: np.ndarray, view: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """New members of distinct hashes, numbered on."""
        new, sizes = len(hashes), ends - starts
        self.keys, self.sizes = grown(self.keys, self.n + new), grown(self.sizes, self.n + new)
        self.keys[self.n : self.n + new] = hashes
        self.sizes[self.n : self.n + new] = sizes
        self.begin = grown(self.begin, self.n + new + 1)
        self.begin[self.n + 1 : self.n + new + 1] = self.begin[self.n] + np.cumsum((sizes + 7) // 8)
        self.body = grown(self.body, int(self.begin[self.n + new]))
        for k, (at, part) in enumerate(K.lanes(view, starts, sizes)):
            self.body[self.begin[self.n + at] + k] = part
        self.n += new
        if 3 * self.n > len(self.slots):
            self.slots = np.full(1 << (4 * self.n).bit_length(), -1, np.int32)
            self._place(np.arange(self.n))
        else:
            self._place(np.arange(self.n - new, self.n))

    def _place(self, numbers: np.ndarray) -> None:
        mask = len(self.slots) - 1
        slot = (self.keys[numbers] & np.uint64(mask)).astype(np.int64)
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            lost = self.slots[slot] != numbers
            numbers, slot = numbers[lost], (slot[lost] + 1) & mask


def numbered(memo: Memo, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, learn) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of spans in the memo, and which of them are not in it: those over ``KEPT_BYTES`` and those whose hash another string has.

    ``learn`` is given the indices of one span of each new hash; it works out what is kept beside the memo.
    """
    view = K.eights(data)
    hashes = K.span_hashes(data, starts, ends, view)
    hashes[ends - starts > KEPT_BYTES] = 0
    short = ends - starts <= KEPT_BYTES
    number = memo.find(hashes)
    missing = np.flatnonzero((number < 0) & short)
    if len(missing):
        one = missing[np.unique(hashes[missing], return_index=True)[1]]
        learn(one)
        memo.add(hashes[one], view, starts[one], ends[one])
        number[missing] = memo.find(hashes[missing])
    odd = ~short
    known = np.flatnonzero(short)
    odd[known] = ~memo.same(number[known], view, starts[known], ends[known])
    number[odd] = 0
    return number, np.flatnonzero(odd)
