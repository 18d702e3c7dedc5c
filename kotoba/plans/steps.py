"""The network step by step, for states that don't recur: all sequences of a group take a step together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .automata import parts, traced

#: Decoding runs long sequences in parts at once: a part begins with the scores that WARM steps before it lead to, and is
#: run again where those aren't, bit by bit, the scores with which the part before it ends.
PART, WARM = 1024, 32
#: So many sequences take their steps together, as many as a core's cache has room for; with fewer, several steps' inputs are
#: gathered at once, ROWS at most.
WIDE, ROWS = 384, 1024


def going(size: np.ndarray) -> list[int]:
    """How many of descending sizes are over 0, 1, 2 and so on."""
    return np.searchsorted(-size, -np.arange(size[0]), "left").tolist()


def stretches(size: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Steps (the first, how many) during which the same number of sequences of descending sizes, given third, goes on."""
    ends = [0, *np.unique(size).tolist()]
    for t, end, n in zip(ends, ends[1:], np.searchsorted(-size, -np.array(ends[:-1]), "left").tolist(), strict=False):
        most = max(1, ROWS // n)
        for first in range(t, end, most):
            yield first, min(most, end - first), n


def scores(features: np.ndarray, x: np.ndarray, lengths: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """What weights and bias make of both directions' states at each place of sequences that stand one after the other. x:
    which row of features a place has; rows are multiplied with the input weights once. A gate is half of 1 + tanh of half
    its sum, so one call does all of a step; the halves are in the weights, and states stand doubled. Each gate has a table
    and sums of its own, so that calls go over memory without gaps."""
    hidden, kinds = sides[0][1].shape[0], len(features)
    table = np.empty((4, 2 * kinds, hidden), np.float32)
    inner = np.empty((4, 2, hidden, hidden), np.float32)
    for gate in range(4):
        at, half = slice(gate * hidden, (gate + 1) * hidden), np.float32(1 if gate == 3 else 0.5)
        for side, (wx, wh, b) in enumerate(sides):
            rows = np.matmul(features, wx[:, at] * half, out=table[gate, side * kinds : (side + 1) * kinds])
            rows += (b[at] + np.float32(gate == 1)) * half  # the forget gates' bias is one more
            inner[gate, side] = wh[:, at] * half / 2
    out = weights.reshape(2, hidden, -1) / 2
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    begin = (np.cumsum(lengths) - lengths)[order]
    stop = begin + size - 1
    total = np.tile(bias, (len(x), 1))
    for a in range(0, len(size), WIDE):
        h, c = np.zeros((2, 2, len(size[a : a + WIDE]), hidden), np.float32)
        for t, count, n in stretches(size[a : a + WIDE]):
            step = np.arange(t, t + count)[:, None]
            places = np.stack([begin[a : a + n] + step, stop[a : a + n] - step], axis=1)
            rows = x[places]
            rows[:, 1] += kinds
            inputs, states = table.take(rows, axis=1), np.empty((2, count, n, hidden), np.float32)
            sums, cell, h = np.empty((4, 2, n, hidden), np.float32), c[:, :n], h[:, :n]
            gates, (enter, keep, leave, candidate) = sums[:3], sums
            for k in range(count):
                np.matmul(h, inner, out=sums)
                sums += inputs[:, k]
                np.tanh(sums, out=sums)
                gates += 1
                cell *= keep
                candidate *= enter
                cell += candidate
                cell *= 0.5
                h = np.multiply(leave, np.tanh(cell, out=enter), out=states[:, k])
            made = states.reshape(2, count * n, hidden) @ out
            total[places[:, 0].ravel()] += made[0]
            total[places[:, 1].ravel()] += made[1]
    return total


def decode(observed: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, begin_state: int, end_state: int, low: float) -> np.ndarray:
    """The best tag paths of sequences that stand one after the other, by scores less the best one; the first of equal
    predecessors wins."""
    states = len(transitions)
    back = np.zeros((len(observed), states), np.int8)
    initial = np.full(states, low)
    initial[begin_state] = 0

    def steps(begin: np.ndarray, size: np.ndarray, first: np.ndarray, keep: bool) -> np.ndarray:
        score = first.T.copy()
        for t, n in enumerate(going(size)):
            at, now = begin[:n] + t, score[:, :n]
            best, by = now[0] + transitions[:, :1], np.zeros((states, n), np.int8)
            for p in range(1, states):
                option = now[p] + transitions[:, p : p + 1]
                np.copyto(by, p, where=option > best)
                np.maximum(best, option, out=best)
            best += observed[at].T
            best -= best.max(axis=0)
            score[:, :n] = best
            if keep:
                back[at] = by.T
        return score.T.copy()

    owner, nth, begin, size = parts(lengths, PART)
    start = np.repeat(initial[None], len(owner), axis=0)
    end = start.copy()
    later = np.flatnonzero(nth > 0)
    if len(later):
        start[later] = steps(begin[later] - WARM, np.full(len(later), WARM), start[later], False)
    todo = np.arange(len(owner))
    while len(todo):
        todo = todo[np.argsort(-size[todo], kind="stable")]
        end[todo] = steps(begin[todo], size[todo], start[todo], True)
        todo = later[(start[later].view(np.int64) != end[later - 1].view(np.int64)).any(axis=1)]
        start[todo] = end[todo - 1]
    last = (end[np.cumsum(np.bincount(owner)) - 1] + transitions[end_state]).argmax(axis=1)
    return traced(back.astype(np.int32), np.arange(len(observed)), lengths, last)
