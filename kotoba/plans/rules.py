"""A network whose weights are set by hand, so that what it gives can be said in a few rules: an exact check of every part
of the path on any text. It knows no language."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

import numpy as np

from ..operators.features import END_MARK
from ..schema import NOUN, POS_ID
from ..sources.model import TAGGER_SHAPES, Vocabularies
from .nn import BEGIN, END, Network

#: What a unit that is on or off gives.
H = math.tanh(1.0)
STEEP = 100.0
#: Where the blocks of a character's 200 features and of a word's 64 begin.
UNI, BI, TYPE, STARTS, ENDS = 0, 96, 144, 168, 184
OWN, THERE, BACK, LABELS = 0, 16, 32, 48
UNKNOWN, PARTICLE, MARK = POS_ID["未知語"], POS_ID["助詞"], POS_ID["補助記号"]
AFTER_MARK, BEFORE_MARK = POS_ID["接続詞"], POS_ID["副詞"]


class _Half:
    """One direction of an LSTM with units that look at the present step, or at a unit one step before."""

    def __init__(self, inputs: int, hidden: int):
        self.hidden, self.used = hidden, 0
        self.wx, self.wh, self.b = np.zeros((inputs, 4 * hidden), np.float32), np.zeros((hidden, 4 * hidden), np.float32), np.zeros(4 * hidden, np.float32)
        # open gates of input and output, nothing remembered
        self.b[:hidden], self.b[hidden : 2 * hidden], self.b[2 * hidden : 3 * hidden] = 30, -40, 30

    def _next(self) -> tuple[int, int]:
        self.used += 1
        return self.used - 1, 3 * self.hidden + self.used - 1

    def above(self, limit: float, *features: int, sign: int = 1) -> int:
        """A unit that is on where the sum of features is over the limit (under it, with sign -1)."""
        unit, column = self._next()
        self.wx[list(features), column] = sign * STEEP
        self.b[column] = -sign * STEEP * limit
        return unit

    def before(self, other: int) -> int:
        """A unit that is on where the other was a step before; off at the first step."""
        unit, column = self._next()
        self.wh[other, column] = STEEP
        self.b[column] = -STEEP / 4
        return unit

    def put(self, weights: dict[str, np.ndarray], name: str) -> None:
        for k, values in enumerate((self.wx, self.wh, self.b)):
            weights[f"/{name}/_{k}"] = values


def _add(out: np.ndarray, bias: np.ndarray, unit: int, score: Mapping[int, float]) -> None:
    """Adds scores where a unit is on."""
    for k, x in score.items():
        out[unit, k] += x / (2 * H)
        bias[k] += x / 2


def rule_network(words: Mapping[str, str | None], particles: Iterable[str], pairs: Iterable[str], ahead: str, marks: str) -> Network:
    """A word begins at the start, where the character type changes, where a vocabulary word begins or one has just ended,
    between the two characters of a pair, and before a character whose next is one of `ahead`; all of it by lower case.
    The label of a word: after one that ends in a mark, a conjunction; one that ends in a mark, a symbol; before one, an
    adverb; else what `words` gives for it; else a particle, if it is one; else a noun, if it is of letters and digits;
    else unknown."""
    weights = {name: np.zeros([d or 0 for d in shape[::-1]], np.float32) for name, shape in TAGGER_SHAPES.items()}
    particles, pairs = list(particles), list(pairs)
    uni = {"oov": 0, "pad": 1} | {c: i + 2 for i, c in enumerate(dict.fromkeys(ahead + marks))}
    bi = {"oov": 0, "pad": 1} | {p: i + 2 for i, p in enumerate(pairs)}
    word = {"oov": 0, "pad": 1} | {w: i + 2 for i, w in enumerate(words)}
    assert not any(END_MARK in p for p in pairs)
    weights["/_0"], weights["/_1"], weights["/_2"] = (np.zeros((len(v), n), np.float32) for v, n in ((uni, 32), (bi, 16), (word, 16)))
    weights["/_3"][np.arange(7), np.arange(7)] = 1
    for c in ahead:
        weights["/_0"][uni[c], 0] = 1
    for c in marks:
        weights["/_0"][uni[c], 1] = 1
    weights["/_1"][2:, 0] = 1
    weights["/_2"][2:, 0] = 1
    # "oov" and "pad" are keys, and so found in texts that spell them, but no words by the rules: where one of them ends
    # next to a word, the word counts
    weights["/_2"][:2, 15] = 1
    weights["/_2"][2:, 15] = -1
    given = sorted({x for x in words.values() if x})
    for w, label in words.items():
        if label:
            weights["/_2"][word[w], 1 + given.index(label)] = 1

    there, back = _Half(200, 50), _Half(200, 50)
    same = [there.above(1.5, TYPE + t, TYPE + 8 + t) for t in range(6)]
    begins = [there.above(0.5, STARTS), there.before(there.above(0.5, ENDS + 15, sign=-1)), there.above(0.5, BI)]
    begins.append(50 + back.before(back.above(0.5, UNI + 32)))
    there.put(weights, "birnn/vanilla-lstm-builder")
    back.put(weights, "birnn/vanilla-lstm-builder_1")
    for k, sign in ((0, 1), (3, 1), (1, -1), (2, -1)):
        weights["/_6"][k] = sign * 4
        for unit in same:
            _add(weights["/_5"], weights["/_6"], unit, {k: -8 * sign})
        for unit in begins:
            _add(weights["/_5"], weights["/_6"], unit, {k: 8 * sign})
    weights["/_6"][[BEGIN, END]] = -1000
    allowed = {(BEGIN, 0), (BEGIN, 3), (0, 1), (0, 2), (1, 1), (1, 2), (2, 0), (2, 3), (3, 0), (3, 3), (2, END), (3, END)}
    weights["/_7"][:] = [[0 if (a, b) in allowed else -1e5 for a in range(6)] for b in range(6)]

    for name in ("", "_1"):
        spelt = _Half(32, 16)
        spelt.above(0.5, 1)
        spelt.put(weights, f"birnn_2/vanilla-lstm-builder{name}")
    weights["/_4"][NOUN, 0] = weights["/_4"][PARTICLE, 1] = 1
    there, back = _Half(64, 50), _Half(64, 50)
    out, bias = weights["/_8"], weights["/_9"]
    bias[UNKNOWN] = 0.5
    _add(out, bias, there.above(0.5, LABELS), {NOUN: 2})
    _add(out, bias, there.above(0.5, LABELS + 1), {PARTICLE: 4})
    for k, label in enumerate(given):
        _add(out, bias, there.above(0.5, OWN + 1 + k), {POS_ID[label]: 8})
    marked = there.above(0, THERE)
    _add(out, bias, marked, {MARK: 32})
    _add(out, bias, there.before(marked), {AFTER_MARK: 64})
    _add(out, bias, 50 + back.before(back.above(0, BACK)), {BEFORE_MARK: 16})
    there.put(weights, "birnn_1/vanilla-lstm-builder")
    back.put(weights, "birnn_1/vanilla-lstm-builder_1")
    tags = {w: [0] for w in words} | {w: [0, PARTICLE] for w in particles}
    return Network(Vocabularies(uni, bi, word, dict(POS_ID), tags), weights, tagger=True)
