"""Elias-Fano sequences and n-gram tries on them, laid out in one memory map.

A monotone sequence keeps its low bits packed and its high parts as a bit vector with
a one for each value and a zero for each step of the high part. Counts of ones in 64-bit
words give rank and select, vectorised over many queries at once; a batch of queries that is not much smaller than
the sequence decodes it once, in a few passes, and looks there.

The trie: the first level holds tokens (sorted ids). Every further level holds pointers from the places of the level before to
their runs of successors, the successors, and a quantised probability each. A run is
kept relative to where the run before it ended, which makes the level one monotone sequence; a successor is searched
within its context's run, between two pointers, and nowhere else. The place of an n-gram is its number as a context of the next level.
"""

from __future__ import annotations

import mmap

import numpy as np

ONE = np.uint64(1)
#: A probability code c > 0 stands for 10 ** (-(c - 1) / STEPS); 0 for none.
STEPS = 26.0


def quantise(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) * STEPS), 0, 254) + 1, 0).astype(np.uint8)


DECODED = np.concatenate([[0.0], 10.0 ** (-np.arange(255) / STEPS)])


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of every value, one after another."""
    n = len(values)
    out = np.zeros((n * width + 63) // 64 + 2, dtype=np.uint64)
    if width and n:
        at = np.arange(n, dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        # values of one word are neighbours
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[heads]] = np.bitwise_or.reduceat(values << shift, heads)
        spill = np.flatnonzero(shift.astype(np.int64) + width > 64)  # at most one a word
        out[word[spill] + 1] |= values[spill] >> (np.uint64(64) - shift[spill])
    return out


def _unpack(words: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(i), dtype=np.uint64)
    at = i * width
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & ((ONE << np.uint64(width)) - ONE)


def _select(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Positions of the i-th set bits; before[k]: set bits in words[:k]."""
    word = np.searchsorted(before, i, "right") - 1
    left = i - before[word].astype(np.int64)
    bits, at = words[word].copy(), np.zeros(len(i), dtype=np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(bits & ((ONE << np.uint64(half)) - ONE)).astype(np.int64)
        up = left >= ones
        left = np.where(up, left - ones, left)
        at = np.where(up, at + half, at)
        bits = np.where(up, bits >> np.uint64(half), bits)
    return word * 64 + at


class Sequence:
    """A non-decreasing sequence of numbers below ``universe``."""

    def __init__(self, n: int, width: int, universe: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.width, self.universe, self.low, self.high = n, width, universe, low, high
        counts = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(counts)])
        self.zeros = np.arange(len(high) + 1) * 64 - self.ones
        self.flipped = ~high

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> Sequence:
        n = len(values)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        at = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        size = n + (universe >> width) + 2
        bits = np.zeros((size + 63) // 64 * 64, dtype=bool)
        bits[at] = True
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        return cls(n, width, universe, _pack(values & ((ONE << np.uint64(width)) - ONE), width), high)

    def dense(self, queries: int) -> bool:
        return queries * 8 >= self.n

    def values(self) -> np.ndarray:
        """All values, in one pass over the bits."""
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)) | _unpack(self.low, self.width, np.arange(self.n))

    def get(self, i: np.ndarray) -> np.ndarray:
        if self.dense(len(i)):
            return self.values()[i]
        high = _select(self.high, self.ones, i) - i
        return (high.astype(np.uint64) << np.uint64(self.width)) | _unpack(self.low, self.width, i)

    def find(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """The place of each value, or -1; with ``first`` and ``last``, only within [first, last).

        The values with its high part lie between two zeros, in order of their low bits, and are searched by halves.
        """
        out = np.full(len(values), -1, dtype=np.int64)
        values = values.astype(np.uint64)
        if self.n and self.dense(len(values)):
            own = self.values()
            at = np.searchsorted(own, values)
            if first is not None:
                at = np.maximum(at, first)
            stop = np.minimum(self.n, self.n if last is None else last)
            inside = at < stop
            hit = np.flatnonzero(inside)
            hit = hit[own[at[hit]] == values[hit]]
            out[hit] = at[hit]
            return out
        ok = np.flatnonzero(values < np.uint64(self.universe)) if self.n else np.zeros(0, np.int64)
        high = (values[ok] >> np.uint64(self.width)).astype(np.int64)
        low = values[ok] & ((ONE << np.uint64(self.width)) - ONE)
        begin = np.where(high > 0, _select(self.flipped, self.zeros, np.maximum(high - 1, 0)) - high + 1, 0)
        end = _select(self.flipped, self.zeros, high) - high
        if first is not None:
            begin, end = np.maximum(begin, first[ok]), np.minimum(end, last[ok])
        stop = end
        while len(ok):
            live = begin < end
            done = ~live
            here = begin[done]
            hit = here < stop[done]
            rows, here = ok[done][hit], here[hit]
            same = _unpack(self.low, self.width, here) == low[done][hit]
            out[rows[same]] = here[same]
            ok, begin, end, low, stop = ok[live], begin[live], end[live], low[live], stop[live]
            half = (begin + end) // 2
            below = _unpack(self.low, self.width, half) < low
            begin, end = np.where(below, half + 1, begin), np.where(below, end, half)
        return out

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width, self.universe, len(self.low), len(self.high)], dtype=np.uint64), self.low, self.high]

    @classmethod
    def load(cls, data: np.ndarray, at: int) -> tuple[Sequence, int]:
        n, width, universe, low, high = (int(x) for x in data[at : at + 5])
        at += 5
        return cls(n, width, universe, data[at : at + low], data[at + low : at + low + high]), at + low + high


class Trie:
    """Tokens, and levels of pointers, successors and codes, over one buffer of 64-bit words. Levels below the tokens count from 0."""

    def __init__(self, data: np.ndarray) -> None:
        self.tokens, at = Sequence.load(data, 1)
        self.pointers, self.successors, self.codes = [], [], []
        for _ in range(int(data[0])):
            pointers, at = Sequence.load(data, at)
            successors, at = Sequence.load(data, at)
            self.pointers.append(pointers)
            self.successors.append(successors)
            self.codes.append(data[at:].view(np.uint8)[: successors.n])
            at += -(-successors.n // 8)

    @staticmethod
    def levels(tokens: np.ndarray, *below: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The words of a trie: sorted distinct tokens; for each further level the places of the contexts in the level before, the successors, sorted by both and distinct, and their codes."""
        parts = [np.array([len(below)], dtype=np.uint64), *Sequence.of(tokens, int(tokens[-1]) + 1 if len(tokens) else 1).parts()]
        n = len(tokens)
        for context, successor, code in below:
            pointers = np.searchsorted(context, np.arange(n + 1))
            tops = np.zeros(n, dtype=np.uint64)  # the largest successor of each context
            some = pointers[1:] > pointers[:-1]
            tops[some] = successor[pointers[1:][some] - 1].astype(np.uint64)
            ends = np.cumsum(tops, dtype=np.uint64)
            values = (ends - tops)[context] + successor.astype(np.uint64)
            parts += Sequence.of(pointers, len(context) + 1).parts() + Sequence.of(values, int(ends[-1]) + 1 if n else 1).parts()
            tail = np.zeros(-(-len(code) // 8) * 8, dtype=np.uint8)
            tail[: len(code)] = code
            parts.append(tail.view(np.uint64))
            n = len(context)
        return np.concatenate(parts)

    @classmethod
    def mapped(cls, levels: np.ndarray) -> Trie:
        """The trie in an anonymous memory map."""
        room = mmap.mmap(-1, max(8, levels.nbytes))
        room[: levels.nbytes] = levels.tobytes()
        return cls(np.frombuffer(room, np.uint64, len(levels)))

    @classmethod
    def open(cls, path: str) -> Trie:
        """The trie in a file that ``levels`` was written to with tofile()."""
        return cls(np.memmap(path, np.uint64, "r"))

    def runs(self, level: int, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of successors [first, last) of contexts by their places in the level before; empty for place -1."""
        n = self.pointers[level].n
        if self.pointers[level].dense(2 * len(context)):
            ends = self.pointers[level].values().astype(np.int64)
            first, last = ends[np.maximum(context, 0)], ends[np.minimum(context + 1, n - 1)]
        else:
            first, last = (self.pointers[level].get(np.clip(context + i, 0, n - 1)).astype(np.int64) for i in (0, 1))
        return first, np.where(context >= 0, last, first)

    def child(self, level: int, context: np.ndarray, successor: np.ndarray, often: np.ndarray | None = None) -> np.ndarray:
        """The place of each successor in the run of its context, or -1; with ``often``, a context goes with so many successors."""
        first, last = self.runs(level, context)
        start = np.zeros(len(first), dtype=np.uint64)  # where the run before ended
        some = np.flatnonzero((first > 0) & (first < last))
        start[some] = self.successors[level].get(first[some] - 1)
        if often is not None:
            first, last, start = np.repeat(first, often), np.repeat(last, often), np.repeat(start, often)
        return self.successors[level].find(start + successor.astype(np.uint64), first, last)

    def code(self, level: int, place: np.ndarray) -> np.ndarray:
        """Codes by place, 0 for place -1."""
        out = np.zeros(len(place), dtype=np.uint8)
        out[place >= 0] = self.codes[level][place[place >= 0]]
        return out

    def fan_out(self, level: int, context: np.ndarray) -> np.ndarray:
        """How many successors each context has; 0 for place -1."""
        first, last = self.runs(level, context)
        return last - first
