"""A run-length index over many short strings: the Burrows-Wheeler transform in runs, with samples at the ends of runs.

Matching statistics are streamed from the samples alone. Where a position's rank is inside a run, the same symbol
precedes its neighbour in suffix order, so the two positions before are neighbours too and their match is longer by
one: only at the heads (or ends) of runs is a match measured, every other follows from the last sample to its left.
The neighbour itself follows in the same way, so positions that match by a given length are found from the samples, too.
Repetitive corpora have few runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _ranked(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs of ranks."""
    key = one.astype(np.int64) * (len(one) + 2) + (two + 1)
    order = np.argsort(key)
    key = key[order]
    new = np.zeros(len(key), np.int32)
    new[1:] = key[1:] != key[:-1]
    out = np.empty(len(key), np.int32)
    out[order] = np.cumsum(new)
    return out


def _shifted(rank: np.ndarray, by: int) -> np.ndarray:
    out = np.full(len(rank), -1, np.int32)
    out[: len(rank) - by] = rank[by:]
    return out


@dataclass
class RunIndex:
    """runs, lengths: the transform, a symbol and a number for each run. head_at, head_match (end_at, end_match): the
    sampled positions, in order, and how far the suffix there matches the one before (after) it in suffix order;
    head_before: where that one before stands, -1 for the first of all."""

    runs: np.ndarray
    lengths: np.ndarray
    head_at: np.ndarray
    head_match: np.ndarray
    head_before: np.ndarray
    end_at: np.ndarray
    end_match: np.ndarray
    size: int

    def _last(self, at: np.ndarray) -> np.ndarray:
        """For each position the number of the last sample to its left (or there)."""
        last = np.zeros(self.size, np.int64)
        last[at] = np.arange(len(at))
        return np.maximum.accumulate(last)

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of its longest match with any other position."""
        out = np.zeros(self.size, np.int32)
        for at, match in ((self.head_at, self.head_match), (self.end_at, self.end_match)):
            last = self._last(at)
            out = np.maximum(out, match[last] - (np.arange(self.size) - at[last]))
        return out

    def groups(self, at: np.ndarray, length: int) -> np.ndarray:
        """For each of the positions `at` the position that stands for all that match it by `length`: stepping to the
        suffix before, in suffix order, as long as the match is so long. Steps are doubled until none is left."""
        last = self._last(self.head_at)
        step = np.arange(self.size)
        back = np.arange(self.size) - self.head_at[last]
        same = self.head_match[last] - back >= length
        step[same] = (self.head_before[last] + back)[same]
        while True:
            two = step[step]
            if (two == step).all():
                return step[at]
            step = two


def build(symbols: np.ndarray, longest: int) -> RunIndex:
    """The index of a sequence of symbols in which no match is longer than `longest`, as unique symbols end its
    strings. Suffixes are put in order by the ranks of substrings of 1, 2, 4, ... symbols, which go with this call."""
    n = len(symbols)
    ranks, m = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)], 1
    while m <= longest:
        ranks.append(_ranked(ranks[-1], _shifted(ranks[-1], m)))
        m *= 2
    suffixes = np.argsort(ranks[-1], kind="stable")
    before = ranks[0][suffixes - 1]  # the text counts as a ring, which a unique symbol closes
    border = np.flatnonzero(before[1:] != before[:-1]) + 1
    heads = np.concatenate([[0], border])
    ends = np.concatenate([border - 1, [n - 1]])

    def match(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int32)
        for k in range(len(ranks) - 1, -1, -1):
            inside = (i < n) & (j < n)
            same = np.zeros(len(i), bool)
            same[inside] = ranks[k][i[inside]] == ranks[k][j[inside]]
            out[same] += 1 << k
            i[same] += 1 << k
            j[same] += 1 << k
        return out

    head_match = np.zeros(len(heads), np.int32)
    head_match[1:] = match(suffixes[heads[1:]], suffixes[heads[1:] - 1])
    end_match = np.zeros(len(ends), np.int32)
    end_match[:-1] = match(suffixes[ends[:-1]], suffixes[ends[:-1] + 1])
    before_head = np.full(len(heads), -1, np.int64)
    before_head[1:] = suffixes[heads[1:] - 1]
    by_head, by_end = np.argsort(suffixes[heads]), np.argsort(suffixes[ends])
    return RunIndex(before[heads], np.diff(np.append(heads, n)), suffixes[heads][by_head], head_match[by_head], before_head[by_head], suffixes[ends][by_end], end_match[by_end], n)
