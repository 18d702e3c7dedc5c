"""User dictionaries: words that are never cut."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import _col, let, word_tags
from ..functions.unicode import normalize
from .features import POINTS, code_points


def prepare(entries: Iterable[str]) -> list[str]:
    """Entries as they are looked for: of two characters or more as given, normalised like texts, each once, the
    longest first. They are literal."""
    made = {normalize(x) for x in entries if len(x) > 1}
    return sorted((x for x in made if x), key=lambda x: (-len(x), x))


class Trie:
    """Finds leftmost-longest words without overlap."""

    END = ""

    def __init__(self, entries: Iterable[str]):
        self.root: dict = {}
        for word in prepare(entries):
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[self.END] = True
        #: Characters with which words begin, and those that are words; pairs with which words begin, as keys.
        self.first, self.single = np.zeros(POINTS, bool), np.zeros(POINTS, bool)
        self.first[[ord(c) for c in self.root]] = True
        self.single[[ord(c) for c, node in self.root.items() if self.END in node]] = True
        self.second = np.array(sorted(ord(a) << 21 | ord(b) for a, node in self.root.items() for b in node if b), np.int64)

    def all_spans(self, texts: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the found words of texts that stand one after the other."""
        points, whole, stops = code_points(texts), "".join(texts), np.cumsum(lengths)
        at = np.flatnonzero(self.first[points])
        pair = points[at] << 21 | np.append(points, 0)[at + 1]
        at = at[self.single[points[at]] | np.isin(pair, self.second)]
        starts, sizes, free = [], [], 0
        for i, stop in zip(at.tolist(), stops[np.searchsorted(stops, at, "right")].tolist(), strict=True):
            if i < free:
                continue
            node, longest, j = self.root, 0, i
            while j < stop and (node := node.get(whole[j])) is not None:
                j += 1
                if self.END in node:
                    longest = j - i
            if longest:
                starts.append(i)
                sizes.append(longest)
                free = i + longest
        return np.array(starts, np.int64), np.array(sizes, np.int64)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, length) of each found word, in code points."""
        out, i, n = [], 0, len(text)
        while i < n:
            node, longest, j = self.root, 0, i
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                if self.END in node:
                    longest = j - i
            if longest:
                out.append((i, longest))
            i += longest or 1
        return out


def pattern(entries: Iterable[str]) -> str:
    """A regular expression that matches a forced word, the longest first, or else one character."""
    return "(?s)" + "|".join([*(_literal(w) for w in prepare(entries)), "."])


def _literal(word: str) -> str:
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}-" else c for c in word)


def pieces(text: Column | str, entries: Iterable[str]) -> Column:
    """A normalised text as forced words and single characters, in order."""
    return F.regexp_extract_all(_col(text), F.lit(pattern(entries)), F.lit(0))


def find_forced(text: Column | str, entries: Iterable[str]) -> Column:
    """For each character of a normalised text the tag that forced words give it, or -1."""
    singles = F.array(*[F.lit(w) for w in prepare(entries) if len(w) == 1]).cast("array<string>")
    return F.flatten(F.transform(pieces(text, entries), lambda p: F.when((F.length(p) > 1) | F.array_contains(singles, p), word_tags(F.length(p))).otherwise(F.array(F.lit(-1)))))


def find_spans(text: Column | str, entries: Iterable[str]) -> Column:
    """array<struct<start, length>> of forced words in a normalised text, in code points."""
    placed = F.transform(find_forced(text, entries), lambda t, i: F.struct(t.alias("t"), i.alias("i")))

    def both(found: Column) -> Column:
        starts = F.filter(found, lambda x: x["t"].isin(0, 3))
        ends = F.filter(found, lambda x: x["t"].isin(2, 3))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a["i"].alias("start"), (b["i"] - a["i"] + 1).alias("length")))

    return let(placed, both)


def force_tags(tags: list[int], found: list[tuple[int, int]]) -> list[int]:
    """BMES tags in which each found span is one word and its neighbours agree; for the batched kernel."""
    out = list(tags)
    for start, length in found:
        end = start + length
        out[start:end] = [3] if length == 1 else [0, *[1] * (length - 2), 2]
        if start:
            out[start - 1] = {0: 3, 1: 2}.get(out[start - 1], out[start - 1])
        if end < len(out):
            out[end] = {1: 0, 2: 3}.get(out[end], out[end])
    return out


def force_all(tags: np.ndarray, trie: Trie, texts: list[str], lengths: np.ndarray) -> np.ndarray:
    """force_tags() for the tags of texts that stand one after the other."""
    start, size = trie.all_spans(texts, lengths)
    if not len(start):
        return tags
    end, stops = start + size, np.cumsum(lengths)
    edge = np.zeros(len(tags) + 1, np.int8)
    edge[start] += 1
    np.subtract.at(edge, end, 1)
    forced = np.cumsum(edge[:-1]) > 0
    out = np.where(forced, 1, tags)
    out[start], out[end - 1] = 0, 2
    out[start[size == 1]] = 3
    after = end[~np.isin(end, stops)]
    after = after[~forced[after]]
    out[after] = np.array([0, 0, 3, 3, 4, 5])[out[after]]
    before = start[~np.isin(start, stops - lengths)] - 1
    before = before[~forced[before]]
    out[before] = np.array([3, 2, 2, 3, 4, 5])[out[before]]
    return out
