"""Elias-Fano sequences and a two-level n-gram trie on them, in memory-mapped levels.

A monotone sequence keeps each value's low bits packed and its high bits in unary; the k-th zero of the unary part says
how many values have a high part of at most k, so a value is found in one select and a search among the few that share
its high part. The trie's levels are such sequences: contexts, pointers to their ranges of followers, and followers,
which are stored relative to their context's base so that the whole level ascends. A successor search for base + word
then finds a follower, which counts if it lies in the range that the pointers give the context. Followers have 16-bit codes
of smoothed probabilities, evenly spaced in logarithm, and contexts have such codes of what is left for the lower order.
Counts that travel have 16-bit codes too, exact up to ``EXACT`` and evenly spaced in logarithm beyond.

Levels are built one after the other and moved into one anonymous memory map; no file is written.
"""

from __future__ import annotations

import mmap

import numpy as np

U = np.uint64
#: Counts up to EXACT have codes of their own; beyond, there are STEPS codes to a factor of two.
EXACT, STEPS = 4096, 1024


def _lanes(width: int):
    """For each of 64 numbers of ``width`` bits, which together fill ``width`` words: its word and its shift there."""
    return [(j, j * width >> 6, U(j * width & 63), (j * width & 63) + width > 64) for j in range(64 if width else 0)]


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """``values`` of ``width`` bits one after the other, in 64-bit words with spare ones."""
    groups = len(values) // 64 + 1
    lanes = np.zeros(groups * 64, U)
    lanes[: len(values)] = values
    lanes, words = np.ascontiguousarray(lanes.reshape(groups, 64).T), np.zeros((width, groups), U)
    for j, word, shift, over in _lanes(width):
        words[word] |= lanes[j] << shift
        if over:
            words[word + 1] |= lanes[j] >> (U(64) - shift)
    return np.r_[words.T.ravel(), U(0)]


def _unpack(words: np.ndarray, width: int, n: int) -> np.ndarray:
    """The first n numbers of ``_pack``."""
    groups = n // 64 + 1
    words, lanes = np.ascontiguousarray(words[: groups * width].reshape(groups, width).T), np.zeros((64, groups), U)
    for j, word, shift, over in _lanes(width):
        lanes[j] = words[word] >> shift
        if over:
            lanes[j] |= words[word + 1] << (U(64) - shift)
    return lanes.T.ravel()[:n] & U((1 << width) - 1)


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
    """Place of the k-th set bit (clear bit, if ``flip``); ``before`` counts them ahead of each word."""
    word = np.searchsorted(before, k, "right") - 1
    rest = (k - before[word]).astype(U)
    bits, place = words[word], np.zeros(len(k), U)
    bits = ~bits if flip else bits
    for width in (32, 16, 8, 4, 2, 1):
        n = np.bitwise_count(bits & U((1 << width) - 1)).astype(U)
        up = rest >= n
        rest -= n * up
        bits = np.where(up, bits >> U(width), bits)
        place += U(width) * up
    return word * 64 + place.astype(np.int64)


class Sequence:
    """A non-decreasing sequence of unsigned numbers."""

    def __init__(self, values: np.ndarray):
        values = values.astype(U)
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.width = max(0, (top // n).bit_length() - 1) if n else 0
        self.low = _pack(values & U((1 << self.width) - 1), self.width)
        high = (values >> U(self.width)).astype(np.int64)
        self.highs = int(high[-1]) + 1 if n else 0
        bits = np.zeros(((n + self.highs) // 64 + 1) * 64, bool)
        bits[high + np.arange(n)] = True
        self.high = np.packbits(bits, bitorder="little").view(U)
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.ones = np.cumsum(ones) - ones
        self.zeros = np.arange(len(ones)) * 64 - self.ones

    ARRAYS = ("low", "high", "ones", "zeros")

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U)
        at = i.astype(U) * U(self.width)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        both = self.low[word] >> shift
        over = shift + U(self.width) > U(64)
        both[over] |= self.low[word[over] + 1] << (U(64) - shift[over])
        return both & U((1 << self.width) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return (_select(self.high, self.ones, i, False) - i).astype(U) << U(self.width) | self._low(i)

    def values(self) -> np.ndarray:
        """The whole sequence."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little").view(bool))
        return (ones - np.arange(self.n)).astype(U) << U(self.width) | _unpack(self.low, self.width, self.n)

    def _until(self, high: np.ndarray) -> np.ndarray:
        """How many values have a high part of at most ``high``."""
        out = np.where(high < 0, 0, self.n)
        inside = (high >= 0) & (high < self.highs)
        out[inside] = _select(self.high, self.zeros, high[inside], True) - high[inside]
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each x, or -1: a successor search that ends at an equal value.

        Many questions read the sequence in one go, and few by selects.
        """
        if not self.n:
            return np.full(len(x), -1, np.int64)
        x = x.astype(U)
        if len(x) * 16 > self.n:
            values = self.values()
            at = np.minimum(np.searchsorted(values, x), self.n - 1)
            return np.where(values[at] == x, at, -1)
        high = np.minimum(x >> U(self.width), U(self.highs)).astype(np.int64)
        low = x & U((1 << self.width) - 1)
        a, end = self._until(high - 1), self._until(high)
        b = end.copy()
        while len(open_ := np.flatnonzero(a < b)):
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < low[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
        hit = np.flatnonzero(a < end)
        hit = hit[self._low(a[hit]) == low[hit]]
        out = np.full(len(x), -1, np.int64)
        out[hit] = a[hit]
        return out


def encode(count: np.ndarray) -> np.ndarray:
    """16-bit codes of counts; code 0 says none."""
    beyond = EXACT + np.rint(np.log2(np.maximum(count, EXACT) / EXACT) * STEPS)
    return np.where(count <= EXACT, count, np.minimum(beyond, 65535)).astype(np.uint16)


def decode(code: np.ndarray) -> np.ndarray:
    code = code.astype(np.float64)
    return np.where(code <= EXACT, code, EXACT * np.exp2((np.maximum(code, EXACT) - EXACT) / STEPS))


def quantised(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities, STEPS to a factor of two, down to 2^-63; code 0 is none."""
    return np.minimum(1 + np.rint(-np.log2(np.maximum(p, 2.0**-63).astype(np.float32)) * np.float32(STEPS)), 65535).astype(np.uint16)


def probability(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, np.exp2((1 - code.astype(np.float64)) / STEPS), 0.0)


class Trie:
    """Followers of contexts with codes. Contexts ascend and are unique; so do the words of each.

    ``sizes`` says how many of ``word`` each context has, which may be none; ``left`` has a code for each context.
    """

    def __init__(self, contexts: np.ndarray, sizes: np.ndarray, word: np.ndarray, codes: np.ndarray, left: np.ndarray):
        pointers = np.r_[0, np.cumsum(sizes)]
        room = np.zeros(len(contexts), np.int64)
        some = np.flatnonzero(sizes)
        room[some] = word[pointers[some + 1] - 1].astype(np.int64) + 1
        base = np.cumsum(room) - room
        self.contexts = _mapped(Sequence(contexts))
        self.pointers = _mapped(Sequence(pointers))
        self.bases = _mapped(Sequence(base))
        self.followers = _mapped(Sequence(np.repeat(base, sizes) + word.astype(np.int64)))
        self.codes, self.left = _map(codes.astype(np.uint16)), _map(left.astype(np.uint16))

    def left_of(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each context, -1 where the trie lacks it, and its code, 0 there."""
        place, out = self.contexts.find(context), np.zeros(len(context), np.uint16)
        known = place >= 0
        out[known] = self.left[place[known]]
        return place, out

    def codes_of(self, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each word after the context at ``place``, 0 where the trie lacks it."""
        out = np.zeros(len(place), np.uint16)
        known = np.flatnonzero(place >= 0)
        k = place[known]
        many = len(k) * 16 > self.contexts.n
        bases, pointers = (self.bases.values(), self.pointers.values()) if many else (self.bases, self.pointers)
        at = self.followers.find(bases[k] + word[known].astype(U))
        hit = np.flatnonzero((at >= pointers[k].astype(np.int64)) & (at < pointers[k + 1].astype(np.int64)))
        out[known[hit]] = self.codes[at[hit]]
        return out


def _map(array: np.ndarray) -> np.ndarray:
    """The array in an anonymous memory map."""
    if not len(array):
        return array
    held = np.frombuffer(mmap.mmap(-1, array.nbytes), array.dtype)
    held[:] = array
    return held


def _mapped(s: Sequence) -> Sequence:
    for name in Sequence.ARRAYS:
        setattr(s, name, _map(getattr(s, name)))
    return s
