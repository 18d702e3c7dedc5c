"""The network as automata: states of an LSTM that recur bit by bit are numbered, and a step from a state by an input is
computed once and looked up from then on. It serves networks whose states forget; one with too many states is
told by StatesExceeded, and goes on step by step (nn.py)."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: More states than these aren't numbered; up to FEW, new inputs are stepped from all states at once.
STATES, FEW = 1024, 32
#: Sequences are run in parts of so many steps, all at once, each from the state that WARM steps before it lead to; a part
#: that began in a wrong state is run again.
PART, WARM = 256, 6
#: Numbered inputs: beyond these a new numbering begins.
INPUTS = 1 << 18


class StatesExceeded(Exception):
    """The states don't recur."""


class Numbering:
    """Dense numbers for 64-bit keys (or strings), in the order of their first appearance."""

    def __init__(self) -> None:
        self.known: dict = {}

    def __len__(self) -> int:
        return len(self.known)

    def of(self, keys: np.ndarray | pa.Array) -> tuple[np.ndarray, list]:
        """The numbers of keys, and the keys that are new, in their order."""
        found = (keys if isinstance(keys, pa.Array) else pa.array(keys)).dictionary_encode()
        known, size = self.known, len(self.known)
        numbers = np.array([known.setdefault(k, len(known)) for k in found.dictionary.to_pylist()], np.int64)
        new = list(known)[size:] if len(known) > size else []
        return (numbers[found.indices.to_numpy()] if len(found) else np.zeros(0, np.int64)), new


def parts(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts of sequences that stand one after the other: of which sequence, the how manieth, where it begins, its size."""
    count = -(-lengths // most)
    owner = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    return owner, nth, (np.cumsum(lengths) - lengths)[owner] + nth * most, np.minimum(lengths[owner] - nth * most, most)


class Automaton:
    """Numbered states and their steps. step(states, inputs): the vectors that follow vectors by numbers of inputs."""

    def __init__(self, initial: np.ndarray, step: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.step, self.width = step, 8
        self.vectors, self.known = initial[None].copy(), {initial.tobytes(): 0}
        self.to = np.full((0, self.width), -1, np.int32)

    def _number(self, vectors: np.ndarray) -> np.ndarray:
        raw = np.ascontiguousarray(vectors)
        kinds, first, back = np.unique(raw.view(np.dtype((np.void, raw.itemsize * raw.shape[1]))).ravel(), return_index=True, return_inverse=True)
        numbers, new = np.empty(len(kinds), np.int32), []
        for k, (kind, i) in enumerate(zip(kinds.tolist(), first.tolist(), strict=True)):
            number = self.known.setdefault(bytes(kind), len(self.known))
            if number >= len(self.vectors) + len(new):
                new.append(i)
            numbers[k] = number
        if new:
            if len(self.known) > STATES:
                raise StatesExceeded
            self.vectors = np.concatenate([self.vectors, raw[new]])
        return numbers[back.ravel()]

    def _fill(self, inputs: np.ndarray, states: np.ndarray) -> bool:
        """Steps; whether the table has become wider."""
        self.to[inputs, states] = self._number(self.step(self.vectors[states], inputs))
        if len(self.vectors) <= self.width:
            return False
        wider = np.full((len(self.to), max(2 * self.width, len(self.vectors))), -1, np.int32)
        wider[:, : self.width] = self.to
        self.to, self.width = wider, wider.shape[1]
        return True

    def grow(self, inputs: int) -> None:
        """Inputs up to this number are known."""
        old = len(self.to)
        if inputs > old:
            self.to = np.concatenate([self.to, np.full((max(inputs, old + old // 2) - old, self.width), -1, np.int32)])
            if len(self.vectors) <= FEW:
                states = np.arange(len(self.vectors))
                for a in range(old, inputs, 4096):
                    new = np.arange(a, min(a + 4096, inputs))
                    self._fill(np.repeat(new, len(states)), np.tile(states, len(new)))

    def _steps(self, x: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray, out: np.ndarray | None) -> np.ndarray:
        """Runs parts of x (the longest first) from their states; the states they end in."""
        state = state.copy()
        going = np.searchsorted(-size, -np.arange(size[0]) if len(size) else [], "left")
        for t, n in enumerate(going.tolist()):
            at = begin[:n] + t
            here = x[at]
            after = self.to.ravel()[here * self.width + state[:n]]
            while (bad := np.flatnonzero(after < 0)).size:
                pairs = np.unique(here[bad] * self.width + state[:n][bad])
                self._fill(pairs // self.width, pairs % self.width)
                after = self.to.ravel()[here * self.width + state[:n]]
            state[:n] = after
            if out is not None:
                out[at] = after
        return state

    def run(self, x: np.ndarray, lengths: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """The state after each input of sequences that stand one after the other, from the states `first` (else 0)."""
        x = x.astype(np.int64)
        owner, nth, begin, size = parts(lengths, PART)
        out = np.empty(len(x), np.int32)
        start = np.zeros(len(owner), np.int64)
        if first is not None:
            start[:] = first[owner]
        later = np.flatnonzero(nth > 0)
        start[later] = self._steps(x, begin[later] - WARM, np.full(len(later), WARM), start[later], None)
        todo = np.arange(len(owner))
        while len(todo):
            todo = todo[np.argsort(-size[todo], kind="stable")]
            self._steps(x, begin[todo], size[todo], start[todo], out)
            right = out[begin[later] - 1]
            wrong = right != start[later]
            todo = later[wrong]
            start[todo] = right[wrong]
        return out

    def run_back(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.run(x[::-1], lengths[::-1])[::-1]


def lstm_automaton(side: tuple[np.ndarray, np.ndarray, np.ndarray], projected: Callable[[np.ndarray], np.ndarray]) -> Automaton:
    """One direction of an LSTM. projected: for numbers of inputs, their products with the input weights plus the bias, one
    more for the forget gates. A state is what goes out, next to what is remembered."""
    wh = side[1]
    hidden = wh.shape[0]

    def step(states: np.ndarray, inputs: np.ndarray) -> np.ndarray:
        z = projected(inputs) + states[:, :hidden] @ wh
        with np.errstate(over="ignore"):
            gates = 1 / (1 + np.exp(-z[:, : 3 * hidden]))
        c = gates[:, hidden : 2 * hidden] * states[:, hidden:] + gates[:, :hidden] * np.tanh(z[:, 3 * hidden :])
        return np.concatenate([gates[:, 2 * hidden :] * np.tanh(c), c], axis=1).astype(np.float32)

    return Automaton(np.zeros(2 * hidden, np.float32), step)


class Rows:
    """A table of rows by number, which grows."""

    def __init__(self, width: int, dtype: type = np.float32):
        self.rows, self.size = np.empty((1024, width), dtype), 0

    def add(self, new: np.ndarray) -> None:
        if self.size + len(new) > len(self.rows):
            more = np.empty((max(2 * len(self.rows), self.size + len(new)), self.rows.shape[1]), self.rows.dtype)
            more[: self.size] = self.rows[: self.size]
            self.rows = more
        self.rows[self.size : self.size + len(new)] = new
        self.size += len(new)


class Pair:
    """Both directions over numbered inputs. add(x): the features of new inputs; inputs with the same ones (by their
    digest) are one to the automata."""

    def __init__(self, sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.sides, self.hidden = sides, sides[0][1].shape[0]
        self.tables = [Rows(4 * self.hidden) for _ in sides]
        self.automata = [lstm_automaton(s, lambda i, t=t: t.rows[i]) for s, t in zip(sides, self.tables, strict=True)]
        self.ends, self.digests, self.kinds = Numbering(), {}, Rows(1, np.int64)

    def add(self, x: np.ndarray) -> None:
        known, size = self.digests, len(self.digests)
        kinds = np.array([known.setdefault(blake2b(row, digest_size=16).digest(), len(known)) for row in np.ascontiguousarray(x)], np.int64)
        self.kinds.add(kinds[:, None])
        x = x[np.searchsorted(np.maximum.accumulate(kinds), np.arange(size, len(known)))]
        for (wx, _, b), table in zip(self.sides, self.tables, strict=True):
            bias = b.copy()
            bias[self.hidden : 2 * self.hidden] += 1
            table.add(x @ wx + bias)

    def run(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pairs of states at each place, and the new pairs' outputs next to each other."""
        there, back = self.automata
        x = self.kinds.rows[x, 0]
        for a, table in zip(self.automata, self.tables, strict=True):
            a.grow(table.size)
        numbers, new = self.ends.of(there.run(x, lengths).astype(np.int64) * STATES + back.run_back(x, lengths))
        new = np.array(new, np.int64)
        return numbers, np.concatenate([there.vectors[new // STATES, : self.hidden], back.vectors[new % STATES, : self.hidden]], axis=1)


class Decoder:
    """The best tag paths over numbered emissions: numbered scores, less the best one, and numbered rows of predecessors."""

    def __init__(self, transitions: np.ndarray, begin: int, end: int, low: float):
        states = len(transitions)
        self.transitions, self.end = transitions, end
        initial = np.full(states, low)
        initial[begin] = 0
        self.emissions = Rows(states, np.float64)
        self.scores = Automaton(initial, self._step)
        self.steps = Numbering()
        self.back = np.zeros((0, states), np.int32)

    def _step(self, scores: np.ndarray, inputs: np.ndarray) -> np.ndarray:
        made = (scores[:, None, :] + self.transitions).max(axis=2) + self.emissions.rows[inputs]
        return made - made.max(axis=1, keepdims=True) + 0.0

    def run(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The tags of sequences that stand one after the other."""
        self.scores.grow(self.emissions.size)
        after = self.scores.run(x, lengths)
        before = np.empty_like(after)
        before[1:] = after[:-1]
        stop = np.cumsum(lengths)
        before[stop - lengths] = 0
        numbers, new = self.steps.of(before.astype(np.int64))
        if new:
            scores = self.scores.vectors[np.array(new)]
            self.back = np.concatenate([self.back, (scores[:, None, :] + self.transitions).argmax(axis=2).astype(np.int32)])
        last = (self.scores.vectors[after[stop - 1]] + self.transitions[self.end]).argmax(axis=1)
        return traced(self.back, numbers, lengths, last)


def traced(back: np.ndarray, numbers: np.ndarray, lengths: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The paths that end in the tags `last`: numbers tell each place's row of back, the best predecessor of each tag."""
    tags = Automaton(np.zeros(1), None)
    tags.width, tags.to = back.shape[1], back
    path = np.empty(len(numbers), np.int32)
    path[:] = tags.run(numbers[::-1], lengths[::-1], last[::-1])[::-1]
    path[:-1] = path[1:]
    path[np.cumsum(lengths) - 1] = last
    return path
