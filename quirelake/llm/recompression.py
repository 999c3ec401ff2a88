"""Recompression of word sequences: rounds that name runs and pairs of symbols.

Runs of one word are named first, by (word, length). Each round then splits the alphabet in two by a
bit of each symbol's hash and names every neighbouring pair (left kind, right kind). Names are
64-bit hashes of what they stand for, so they are the same in all documents without a dictionary that
would have to be shared: equal substrings get equal symbols inside, and only what touches their ends differs.

``Symbols`` keeps, for each symbol, the words it covers and the words that its naming looked at (its context).
If the context lies inside a window of words, every equal window holds the same symbol.
"""

from __future__ import annotations

import numpy as np

from .common import mix

_SEED = np.uint64(0x9E3779B97F4A7C15)


class Symbols:
    """Symbols after ``rounds`` rounds over words given by hash and by row (first: index of each row's first word)."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, rounds: int):
        n = len(hashes)
        self.name = hashes.copy()
        self.row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.start, self.end = np.arange(n), np.arange(1, n + 1)
        self.seen_from, self.seen_to = self.start.copy(), self.end.copy()
        self._runs(np.uint64(1))
        for r in range(rounds):
            self._pairs(np.uint64(r + 2))

    def _group(self, head: np.ndarray, name: np.ndarray, seen_from: np.ndarray, seen_to: np.ndarray) -> None:
        at = np.flatnonzero(head)
        last = np.append(at[1:], len(head)) - 1
        self.end = self.end[last]
        self.start, self.row, self.name = self.start[at], self.row[at], name
        self.seen_from, self.seen_to = seen_from, seen_to

    def _runs(self, salt: np.uint64) -> None:
        n = len(self.name)
        if not n:
            return
        head = np.ones(n, bool)
        head[1:] = (self.name[1:] != self.name[:-1]) | (self.row[1:] != self.row[:-1])
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, n))
        name = np.where(size > 1, mix(self.name[at] * _SEED + size.astype(np.uint64) + (salt << np.uint64(40))), self.name[at])
        # that a run ends is known from the symbols on both sides
        left, right = self._beside(at, at + size - 1)
        self._group(head, name, left, right)

    def _beside(self, at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context of runs at .. last with the neighbours on both sides; past a row's end it is one word beyond."""
        n = len(self.name)
        before, after = at - 1, last + 1
        has = (before >= 0) & (self.row[np.maximum(before, 0)] == self.row[at])
        left = np.where(has, self.seen_from[np.maximum(before, 0)], self.start[at] - 1)
        has = (after < n) & (self.row[np.minimum(after, n - 1)] == self.row[at])
        right = np.where(has, self.seen_to[np.minimum(after, n - 1)], self.end[last] + 1)
        return np.minimum(left, self.seen_from[at]), np.maximum(right, self.seen_to[last])

    def _pairs(self, salt: np.uint64) -> None:
        n = len(self.name)
        if not n:
            return
        left_kind = (mix(self.name + (salt << np.uint64(48))) & np.uint64(1)).astype(bool)
        joined = np.zeros(n, bool)  # with the next one
        joined[:-1] = left_kind[:-1] & ~left_kind[1:] & (self.row[1:] == self.row[:-1])
        head = np.ones(n, bool)
        head[1:] = ~joined[:-1]
        at = np.flatnonzero(head)
        pair = joined[at]
        other = np.minimum(at + 1, n - 1)
        name = np.where(pair, mix(mix(self.name[at] + _SEED + salt) * _SEED + self.name[other]), self.name[at])
        low, high = self._beside(at, at)
        # a symbol of the left kind only looks right, one of the right kind only looks left
        seen_from = np.where(pair | left_kind[at], self.seen_from[at], low)
        seen_to = np.where(pair, np.maximum(self.seen_to[other], self.seen_to[at]), np.where(left_kind[at], high, self.seen_to[at]))
        seen_from = np.where(pair, np.minimum(seen_from, self.seen_from[other]), seen_from)
        self._group(head, name, seen_from, seen_to)


def open_windows(symbols: Symbols, good: np.ndarray, window: int, n: int) -> np.ndarray:
    """Windows of ``window`` words (by first word, of n words) that hold no symbol that isn't ``good``.

    A window holds a symbol if its context lies inside. Windows across rows are the caller's to leave out.
    """
    bad = ~good
    lo = symbols.seen_to[bad] - window  # first window start that holds it
    hi = symbols.seen_from[bad]  # last one
    fits = (lo <= hi) & (hi >= 0)
    count = np.bincount(np.clip(lo[fits], 0, n), minlength=n + 2) - np.bincount(np.clip(hi[fits] + 1, 0, n + 1), minlength=n + 2)
    return np.cumsum(count)[:n] == 0
