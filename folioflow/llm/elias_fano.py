"""Monotone sequences in Elias-Fano form, and n-gram levels made of them, as flat buffers that can be mapped from files.

A sequence of n values up to u keeps the low bits of each value packed, and the high parts as a bitset with a bit for each
value, about log2(u / n) + 2 bits a value. Values are read by select, the first value that isn't below a bound (the successor)
by a select of zeros and a binary search among the values of equal high part. All of it works on arrays of places or bounds.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit (from 0) of each word: halving, by popcounts of the lower half."""
    at, k = np.zeros(len(words), np.uint64), k.copy()
    for half in (32, 16, 8, 4, 2, 1):
        mask = (_ONE << np.uint64(half)) - _ONE
        low = np.bitwise_count((words >> at) & mask).astype(np.int64)
        over = k >= low
        k -= np.where(over, low, 0)
        at += over * np.uint64(half)
    return at.astype(np.int64)


class Packed:
    """Numbers of a fixed width, packed without gaps into words of 64 bits, and a word more."""

    def __init__(self, words: np.ndarray, width: int):
        self.words, self.width = words, width

    @classmethod
    def of(cls, values: np.ndarray, width: int) -> Packed:
        words = np.zeros(len(values) * width // 64 + 2, np.uint64)
        if width:
            values, at = values.astype(np.uint64), np.arange(len(values), dtype=np.int64) * width
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(words, at >> 6, values << shift)
            # the part that goes over into the next word; two shifts, as a shift by 64 isn't defined
            np.bitwise_or.at(words, (at >> 6) + 1, values >> _ONE >> (np.uint64(63) - shift))
        return cls(words, width)

    def __getitem__(self, k: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(k), np.int64)
        at = k * self.width
        shift = (at & 63).astype(np.uint64)
        both = self.words[at >> 6] >> shift | self.words[(at >> 6) + 1] << _ONE << (np.uint64(63) - shift)
        return (both & ((_ONE << np.uint64(self.width)) - _ONE)).astype(np.int64)


class Sequence:
    """n ascending values; equal ones are allowed."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low, self.high = n, Packed(low, width), high
        self.ones = np.r_[0, np.cumsum(np.bitwise_count(high), dtype=np.int64)]
        self.zeros = np.arange(len(high) + 1, dtype=np.int64) * 64 - self.ones

    @classmethod
    def of(cls, values: np.ndarray) -> Sequence:
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(1, n)).bit_length() - 1)
        flags = np.zeros(-(-(n + (top >> width) + 2) // 64) * 64, bool)
        flags[(values >> width) + np.arange(n)] = True
        return cls(n, width, Packed.of(values & ((1 << width) - 1), width).words, np.packbits(flags, bitorder="little").view(np.uint64))

    def __getitem__(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, k, "right") - 1
        at = word * 64 + _select(self.high[word], k - self.ones[word])
        return (at - k) << self.low.width | self.low[k]

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part: the ones before the zero that ends the part before."""
        found = np.zeros(len(high), np.int64)
        some = np.flatnonzero(high > 0)
        zero = high[some] - 1
        beyond = zero >= self.zeros[-1]
        word = np.minimum(np.searchsorted(self.zeros, zero, "right") - 1, len(self.high) - 1)
        at = word * 64 + _select(~self.high[word], np.where(beyond, 0, zero - self.zeros[word]))
        found[some] = np.where(beyond, self.n, at - zero)
        return found

    def successor(self, bounds: np.ndarray) -> np.ndarray:
        """The place of the first value that isn't below each bound; n if there is none."""
        high, low = bounds >> self.low.width, bounds & ((1 << self.low.width) - 1)
        first, last = self._below(high), self._below(high + 1)
        while (open_ := np.flatnonzero(first < last)).size:
            middle = (first[open_] + last[open_]) >> 1
            less = self.low[middle] < low[open_]
            first[open_] = np.where(less, middle + 1, first[open_])
            last[open_] = np.where(less, last[open_], middle)
        return first


class Level:
    """One level of an n-gram trie: contexts, pointers to the ranges of their successors, successors and a code for each.

    Contexts are ascending. Successors ascend within a range only; they are kept with the sum of the largest ones of all ranges
    before, which makes them one ascending sequence, and searched for relative to their context's.
    """

    def __init__(self, contexts: Sequence, pointers: Sequence, successors: Sequence, codes: np.ndarray, counts: Packed):
        self.contexts, self.pointers, self.successors, self.codes, self.counts = contexts, pointers, successors, codes, counts

    @classmethod
    def of(cls, contexts: np.ndarray, words: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> Level:
        """From distinct (context, word), ascending by both."""
        starts = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(contexts) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(contexts)] if len(starts) else starts
        base = np.r_[0, np.cumsum(words[ends - 1] + 1)] if len(starts) else np.zeros(1, np.int64)
        moved = words + np.repeat(base[:-1], ends - starts)
        width = int(counts.max(initial=0)).bit_length()
        return cls(Sequence.of(contexts[starts]), Sequence.of(np.r_[starts, len(contexts)]), Sequence.of(moved), codes.astype(np.uint8), Packed.of(counts, width))

    def find(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The place of each (context, word), -1 if it isn't there."""
        found = np.full(len(contexts), -1, np.int64)
        if not self.contexts.n:
            return found
        at = self.contexts.successor(contexts)
        known = np.flatnonzero(at < self.contexts.n)
        known = known[self.contexts[at[known]] == contexts[known]]
        at = at[known]
        start, end = self.pointers[at], self.pointers[at + 1]
        # the sum before a range: the last value of the range before, and one
        base = np.where(start > 0, self.successors[np.maximum(start - 1, 0)] + 1, 0)
        bounds = base + words[known]
        place = self.successors.successor(bounds)
        inside = np.flatnonzero(place < end)
        inside = inside[self.successors[place[inside]] == bounds[inside]]
        found[known[inside]] = place[inside]
        return found

    def to_bytes(self) -> bytes:
        """A head of places and widths, and all buffers, each at a multiple of 8 bytes."""
        parts, head = [], []
        for s in (self.contexts, self.pointers, self.successors):
            head += [s.n, s.low.width, len(s.low.words), len(s.high)]
            parts += [s.low.words.tobytes(), s.high.tobytes()]
        head += [len(self.codes), self.counts.width, len(self.counts.words)]
        parts += [self.counts.words.tobytes(), self.codes.tobytes()]
        return np.array(head, np.int64).tobytes() + b"".join(parts)

    @classmethod
    def at(cls, buffer) -> Level:
        """The level in a buffer, a mapped file's or an Arrow column's, which isn't copied."""
        flat = np.frombuffer(buffer, np.uint8)
        head = flat[: 15 * 8].view(np.int64).tolist()
        at = 15 * 8

        def words(n: int) -> np.ndarray:
            nonlocal at
            at += 8 * n
            return flat[at - 8 * n : at].view(np.uint64)

        sequences = []
        for k in range(0, 12, 4):
            n, width, low, high = head[k : k + 4]
            sequences.append(Sequence(n, width, words(low), words(high)))
        counts = Packed(words(head[14]), head[13])
        return cls(*sequences, flat[at : at + head[12]], counts)

    @classmethod
    def mapped(cls, path: str) -> Level:
        """The level in a file, of which only what is read gets into memory."""
        return cls.at(np.memmap(path, np.uint8, "r"))
