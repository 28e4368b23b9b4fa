"""Suffix arrays by induced sorting, in NumPy, and permuted common prefixes.

Suffixes are classified (smaller or larger than their successor); leftmost-smaller substrings
are sorted by one induction and named; the string of names, as far as names occur again, is
sorted recursively in the same way; a second induction over the sorted leftmost-smaller
suffixes gives the suffix array. An induction goes through the buckets of
first symbols in order and places all predecessors of a bucket's suffixes at once, so its
Python steps depend on the alphabet and the longest run of a symbol, not on the length.

Common prefixes are computed in text order: where a suffix and its predecessor in the array
are preceded by the same symbol, the prefix is one shorter than at the position before; only
the others are compared, four symbols at a time.
"""

from __future__ import annotations

import math

import numpy as np

#: Suffixes that are placed one by one.
FEW = 64
END, SEPARATOR, FIRST = 0, 1, 2  # symbols: the end, between texts, and byte b as FIRST + b


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one that follows it (the end symbol's too)."""
    n = len(s)
    rise = (s[1:] > s[:-1]).astype(np.int8) - (s[1:] < s[:-1])
    at = np.where(rise != 0, np.arange(n - 1, dtype=np.int32), n - 2)
    decided = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(rise[decided] > 0, True)


class _Inducer:
    """Induces the order of all suffixes from that of the leftmost-smaller ones."""

    def __init__(self, s: np.ndarray, small: np.ndarray):
        self.s = s
        self.size = int(s.max()) + 1
        counts = np.bincount(s, minlength=self.size)
        self.end = np.cumsum(counts)
        self.start = self.end - counts
        # the symbol before each position, or -1 where the suffix there is not of the kind that a pass places
        before = np.append(-1, s[:-1]).astype(np.int32)
        small_before = np.append(True, small[:-1])
        self.before_larger = np.where(small_before, -1, before)
        small_before[0] = False
        self.before_smaller = np.where(small_before, before, -1)

    def _place(self, sa: np.ndarray, fill: np.ndarray, batch: np.ndarray, before: np.ndarray, step: int) -> None:
        """Puts the predecessors of a batch into their buckets, in the batch's order, from fill on by step."""
        if len(batch) <= FEW:
            for j, c in zip(batch.tolist(), before[batch].tolist(), strict=True):
                if c >= 0:
                    at = fill[c]
                    sa[at - (step < 0)] = j - 1
                    fill[c] = at + step
            return
        symbol = before[batch]
        taken = symbol >= 0
        batch, symbol = batch[taken], symbol[taken].astype(np.uint16)
        if not len(batch):
            return
        order = np.argsort(symbol, kind="stable")
        symbol = symbol[order]
        counts = np.bincount(symbol, minlength=self.size)
        at = (fill - step * (np.cumsum(counts) - counts))[symbol] + step * np.arange(len(symbol))
        sa[at if step > 0 else at - 1] = batch[order] - 1
        fill += step * counts

    def __call__(self, smaller: np.ndarray) -> np.ndarray:
        """smaller: positions of the leftmost-smaller suffixes; within a bucket they keep their order."""
        s, start, end, top = self.s, self.start, self.end, self.size - 1
        sa = np.zeros(len(s), np.int32)
        order = np.argsort(s[smaller], kind="stable")
        smaller = smaller[order]
        symbol = s[smaller]
        counts = np.bincount(symbol, minlength=self.size)
        lms = end - counts
        sa[lms[symbol] + np.arange(len(smaller)) - (np.cumsum(counts) - counts)[symbol]] = smaller
        head = start.copy()
        for c in range(self.size):
            at = start[c]
            while at < head[c]:
                batch, at = sa[at : head[c]], head[c]
                self._place(sa, head, batch, self.before_larger, 1)
            if lms[c] < end[c]:
                self._place(sa, head, sa[lms[c] : end[c]], self.before_larger, 1)
        tail = end.copy()
        for c in range(top, -1, -1):
            at = end[c]
            while tail[c] < at:
                batch, at = sa[tail[c] : at][::-1], tail[c]
                self._place(sa, tail, batch, self.before_smaller, -1)
            if start[c] < head[c]:
                self._place(sa, tail, sa[start[c] : head[c]][::-1], self.before_smaller, -1)
        return sa


def _words(s: np.ndarray) -> np.ndarray:
    """Four symbols from each position on, as one number; past the end are zeros."""
    x = np.zeros(len(s) + 3, np.uint64)
    x[: len(s)] = s
    x = x[:-1] | x[1:] << np.uint64(16)
    return x[:-2] | x[2:] << np.uint64(32)


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, `limit` at most."""
    out = limit.copy()
    active = np.flatnonzero(limit > 0)
    offset = 0
    while len(active):
        differ = words[a[active] + offset] ^ words[b[active] + offset]
        hit = differ != 0
        d = differ[hit]
        found = active[hit]
        out[found] = np.minimum(limit[found], offset + np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 16)
        offset += 4
        active = active[~hit]
        active = active[limit[active] > offset]
    return out


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of dense names, the last of them unique and least, by the suffix array of a shorter string.

    A unique name decides on its suffix, and on any that reaches it, so only names that occur again
    and the unique ones right behind them go into that string. Names are written as two digits, so
    that the alphabet, for which an induction takes a step a symbol, stays near the root of their number.
    """
    counts = np.bincount(names)
    start = np.cumsum(counts) - counts
    tied = counts[names] > 1
    order = np.empty(len(names), np.int64)
    order[start[names[~tied]]] = np.flatnonzero(~tied)
    kept = np.flatnonzero(tied | np.append(False, tied[:-1]))
    if not len(kept):
        return order
    used = np.zeros(len(counts), bool)
    used[names[kept]] = True
    dense = (np.cumsum(used) - 1)[names[kept]]
    base = math.isqrt(int(used.sum())) + 1
    digits = np.full(2 * len(dense) + 1, END, np.uint16)
    digits[0:-1:2] = dense // base + 1
    digits[1::2] = dense % base + 1
    at = suffix_array(digits)[1:]
    at = kept[at[at % 2 == 0] // 2]
    at = at[tied[at]]
    at = at[np.argsort(names[at], kind="stable")]
    within = np.arange(len(at)) - np.searchsorted(names[at], names[at])
    order[start[names[at]] + within] = at
    return order


def suffix_array(s: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Suffix array of symbols that end with END, which occurs nowhere else."""
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    words = _words(s) if words is None else words
    small = classify(s)
    is_lms = np.append(False, small[1:] & ~small[:-1])
    lms = np.flatnonzero(is_lms)
    induce = _Inducer(s, small)
    if len(lms) < 2:
        return induce(lms)
    by_substring = induce(lms)
    by_substring = by_substring[is_lms[by_substring]].astype(np.int64)
    length = np.zeros(n, np.int32)
    length[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = by_substring[:-1], by_substring[1:]
    equal = length[a] == length[b]
    equal[equal] = _common(words, a[equal], b[equal], length[a[equal]]) == length[a[equal]]
    name = np.zeros(n, np.int32)
    name[by_substring] = np.append(0, np.cumsum(~equal))
    names = name[lms]
    order = by_substring if names.max() + 1 == len(lms) else lms[_sort_names(names)]
    return induce(order)


def common_prefixes(s: np.ndarray, sa: np.ndarray, stop: np.ndarray, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(predecessor in the array, length of the common prefix with it) by text position.

    stop: by position, the symbols up to the end of its own text; no prefix goes beyond that.
    """
    n = len(s)
    words = _words(s) if words is None else words
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n, dtype=np.int32)
    anew = np.ones(n, bool)
    anew[1:] = (stop[:-1] == 0) | (before[1:] <= 0) | (s[:-1] != s[np.maximum(before[1:], 1) - 1])
    at = np.flatnonzero(anew & (before >= 0))
    value = np.zeros(n, np.int32)
    value[at] = _common(words, at, before[at], stop[at])
    last = np.maximum.accumulate(np.where(anew, i, 0))
    return before, np.maximum(value[last] - (i - last), 0)


def repeated_windows(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each of the texts, by start: does its window of `width` bytes occur at another place of any text?"""
    lengths = np.array([len(t) for t in texts], np.int64)
    total = int((lengths + 1).sum())
    s = np.full(total + 1, SEPARATOR, np.uint16)
    s[-1] = END
    ends = np.cumsum(lengths + 1) - 1
    inside = np.ones(total + 1, bool)
    inside[ends] = False
    inside[-1] = False
    s[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + FIRST
    stop = np.zeros(total + 1, np.int32)
    stop[:total] = np.repeat(ends.astype(np.int32), lengths + 1) - np.arange(total, dtype=np.int32)
    words = _words(s)
    sa = suffix_array(s, words)
    before, prefix = common_prefixes(s, sa, stop, words)
    hit = prefix >= width
    repeated = hit.copy()
    repeated[before[hit]] = True
    return [repeated[e - n : e - width + 1] if n >= width else np.zeros(0, bool) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
