"""The network in NumPy, over batches of texts: embeddings, BiLSTM, tag decoding, and the labeller."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from ..functions.unicode import alnum
from ..operators.features import END_MARK, MAX_WORD, PAD_ID, PAD_TYPE, POINTS, WordTree, code_points, find, groups, sorted_keys
from ..schema import NOUN
from ..sources.model import SEGMENTER_SHAPES, TAGGER_SHAPES, Vocabularies, check_vocabularies, check_weights
from . import steps
from .automata import INPUTS, Decoder, Numbering, Pair, Rows, StatesExceeded

#: Characters of a batch, the padding of its decoding included: bounds its memory.
BATCH_CHARS = 65_536
LOW = -1e10
#: Words that are labelled together by automata.
GROUP_WORDS = 1 << 18
#: Paths that are traced one by one.
FEW = 16
BEGIN, END = 4, 5


def lstm(x: np.ndarray, lengths: np.ndarray, *sides: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """States of sequences that stand one after the other in x, in descending order of length: those of a forward pass
    with the first side's weights (inputs, states, bias) and, if there is a second, of a backward one, next to each
    other. Both passes take their steps together, and a step is a slice of what is still going on. Gates in order input,
    forget (its bias one more), output, candidate."""
    hidden = sides[0][1].shape[0]
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(len(x)) - starts[row]
    forward = np.argsort(step, kind="stable")
    places = [forward, (starts + lengths - 1)[row[forward]] - step[forward]][: len(sides)]
    z = np.empty((len(sides), len(x), 4 * hidden), np.float32)
    sign = np.repeat(np.array([-1, 1], np.float32), [3 * hidden, hidden])  # the gates need exp(-x)
    for k, ((wx, _, b), at) in enumerate(zip(sides, places, strict=True)):
        bias = b.copy()
        bias[hidden : 2 * hidden] += 1
        z[k] = (x @ (wx * sign) + bias * sign)[at]
    wh = np.stack([s[1] for s in sides]) * sign
    going = np.searchsorted(-lengths, -np.arange(lengths[0]) if len(lengths) else [], "left")
    c = np.zeros((len(sides), len(lengths), hidden), np.float32)
    states = np.empty((len(sides), len(x), hidden), np.float32)
    done = 0
    for n in going.tolist():
        a = z[:, done : done + n]
        if done:
            a += states[:, done - last : done - last + n] @ wh
        gates = a[:, :, : 3 * hidden]
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        candidate = a[:, :, 3 * hidden :]
        np.tanh(candidate, out=candidate)
        cell = c[:, :n]
        cell *= gates[:, :, hidden : 2 * hidden]
        candidate *= gates[:, :, :hidden]
        cell += candidate
        np.multiply(gates[:, :, 2 * hidden :], np.tanh(cell), out=states[:, done : done + n])
        last, done = n, done + n
    out = np.empty((len(x), len(sides) * hidden), np.float32)
    for k, at in enumerate(places):
        out[at, k * hidden : (k + 1) * hidden] = states[k]
    return out


def padded(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sequences one after the other as rows of equal length."""
    out = np.zeros((len(lengths), lengths[0], flat.shape[1]), flat.dtype)
    out[np.arange(lengths[0]) < lengths[:, None]] = flat
    return out


def viterbi_batch(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> list[list[int]]:
    """Best paths of padded emissions (rows in descending order of length) in doubles; transitions[next][prev]; the
    first of equal predecessors wins."""
    rows, steps, states = emissions.shape
    score = np.full((rows, states), LOW)
    score[:, BEGIN] = 0
    back = np.zeros((steps, rows, states), np.intp)
    going = np.searchsorted(-lengths, -np.arange(steps), "left").tolist()
    observed = np.ascontiguousarray(emissions.transpose(1, 0, 2))
    for t, n in enumerate(going):
        options = score[:n, None, :] + transitions
        options.argmax(axis=2, out=back[t, :n])
        np.add(options.max(axis=2), observed[t, :n], out=score[:n])
    at = (score + transitions[END]).argmax(axis=1)
    if rows <= FEW:
        return [_traced(back[:n, i].tolist(), k) for i, (n, k) in enumerate(zip(lengths.tolist(), at.tolist(), strict=True))]
    path = np.zeros((rows, steps), np.int8)
    for t in range(steps - 1, -1, -1):
        n = going[t]
        path[:n, t] = at[:n]
        at[:n] = back[t, np.arange(n), at[:n]]
    return [path[i, : lengths[i]].tolist() for i in range(rows)]


def _traced(back: list[list[int]], at: int) -> list[int]:
    """A path from its end, by the best predecessors of each step."""
    path = []
    for step in reversed(back):
        path.append(at)
        at = step[at]
    return path[::-1]


def cut(text: str, tags: list[int]) -> list[str]:
    """The words of a text by its tags: one begins at the start, at S (3), and after E (2) or S."""
    begins = [i for i, t in enumerate(tags) if i == 0 or t == 3 or tags[i - 1] in (2, 3)]
    return [text[a:b] for a, b in zip(begins, [*begins[1:], len(text)], strict=True)]


def batches(lengths: list[int], limit: int = BATCH_CHARS) -> list[list[int]]:
    """Places of items, the longest first, in groups whose padded size is limited."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    out: list[list[int]] = []
    for i in order:
        if out and lengths[out[-1][0]] * (len(out[-1]) + 1) <= limit:
            out[-1].append(i)
        else:
            out.append([i])
    return out


#: What stands for the end of a text in a key of two code points.
LAST = 0x1FFFFF


class Tables:
    """The vocabularies as arrays over code points, so that whole batches are looked up at once: characters and their
    types by their code points, pairs by sorted keys, words by a tree."""

    def __init__(self, v: Vocabularies):
        self.kinds = np.full(POINTS, 5, np.int8)
        for kind, first, last in ((0, 0x3040, 0x309F), (1, 0x30A1, 0x30FA), (2, 0x4E00, 0x9FA5), (3, 65, 90), (3, 97, 122), (4, 48, 57)):
            self.kinds[first : last + 1] = kind
        self.uni = np.full(POINTS, v.uni["oov"], np.int32)
        for c, i in v.uni.items():
            if len(c) == 1:
                self.uni[ord(c)] = i
        pairs = {ord(k[0]) << 21 | (ord(k[1]) if len(k) == 2 else LAST): i for k, i in v.bi.items() if len(k) == 2 or (len(k) == 1 + len(END_MARK) and k.endswith(END_MARK))}
        self.bi = sorted_keys(pairs or {-1: 0})
        self.spelt = [w for w in v.word if 0 < len(w) <= MAX_WORD]
        self.places = {w: i for i, w in enumerate(self.spelt)}
        self.word_ids = np.array([v.word[w] for w in self.spelt], np.int32)
        self.words = WordTree(self.places).words


class Contexts:
    """What the features of a character depend on, numbered: the pairs of characters that begin before it, at it and after
    it, and the longest words that begin and end there (the shorter ones are parts of them). Features are made once for
    each number."""

    def __init__(self, net: Network, tables: Tables):
        self.net, self.tables = net, tables
        self.pairs, self.triples, self.all = Numbering(), Numbering(), Numbering()
        self.pair_ids, self.triple_pairs = Rows(3, np.int64), Rows(3, np.int64)
        self.pair_ids.add(np.array([[PAD_ID, PAD_ID, PAD_TYPE]]))
        self.sums: dict[tuple[int, bool], np.ndarray] = {}

    def _sum(self, place: int, at_end: bool) -> np.ndarray:
        """The summed vectors of the words at a place whose longest one is given by its place in the list, from 1; 0: none."""
        found = self.sums.get((place, at_end))
        if found is None:
            t, table = self.tables, self.net.weights["/_2"]
            if place:
                w = t.spelt[place - 1]
                parts = (w[-n:] if at_end else w[:n] for n in range(1, len(w) + 1))
                found = table[t.word_ids[[t.places[x] for x in parts if x in t.places]]].sum(axis=0)
            else:
                found = table[self.net.vocabularies.word["oov"]]
            self.sums[place, at_end] = found
        return found

    def of(self, lows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each character of lower-cased texts, none of them empty, and the 200 features of the new ones."""
        tables = self.tables
        points = code_points(lows)
        stop = np.cumsum([len(x) for x in lows])
        begin = np.concatenate([[0], stop[:-1]])
        following = np.append(points[1:], LAST)
        following[stop - 1] = LAST
        here, new = self.pairs.of(points << 21 | following)
        if new:
            keys = np.array(new)
            self.pair_ids.add(np.stack([tables.uni[keys >> 21], find(tables.bi, keys, self.net.vocabularies.bi["oov"]), tables.kinds[keys >> 21]], axis=1))
        here += 1  # 0 is outside the text
        before, after = np.append(0, here[:-1]), np.append(here[1:], 0)
        before[begin] = 0
        after[stop - 1] = 0
        three, new = self.triples.of(before << 42 | here << 21 | after)
        if new:
            keys = np.array(new)
            self.triple_pairs.add(np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF], axis=1))
        start, size, word = tables.words(points, np.repeat(stop, stop - begin))
        first, last = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        first[start] = word + 1  # the longer ones come later
        last[start + size - 1] = word + 1
        numbers, new = self.all.of(three << 42 | first << 21 | last)
        keys = np.array(new, np.int64)
        out, column = np.empty((len(keys), 200), np.float32), 0
        ids = self.pair_ids.rows[self.triple_pairs.rows[keys >> 42]]
        for k, name in enumerate(("/_0", "/_1", "/_3")):
            table = self.net.weights[name]
            out[:, column : column + 3 * table.shape[1]] = table[ids[:, :, k]].reshape(len(keys), 3 * table.shape[1])
            column += 3 * table.shape[1]
        for places, at_end in ((keys >> 21 & 0x1FFFFF, False), (keys & 0x1FFFFF, True)):
            kinds, back = np.unique(places, return_inverse=True)
            if len(kinds):
                out[:, column : column + 16] = np.stack([self._sum(int(x), at_end) for x in kinds])[back]
            column += 16
        return numbers, out


class Compiled:
    """A network whose states recur, by automata."""

    def __init__(self, net: Network, tables: Tables):
        w = net.weights
        self.net, self.contexts = net, Contexts(net, tables)
        self.cut = Pair(net._sides("birnn"))
        self.decoder = Decoder(w["/_7"].astype(np.float64), BEGIN, END, LOW)
        if net.tagger:
            self.spellings, self.label, self.best = Numbering(), Pair(net._sides("birnn_1")), Rows(1, np.int8)

    def full(self) -> bool:
        return max(map(len, (self.contexts.pairs, self.contexts.all, *([self.spellings] if self.net.tagger else [])))) > INPUTS

    def tags(self, lows: list[str]) -> np.ndarray:
        lengths = np.array([len(x) for x in lows])
        numbers, new = self.contexts.of(lows)
        self.cut.add(new)
        ends, states = self.cut.run(numbers, lengths)
        self.decoder.emissions.add(states @ self.net.weights["/_5"] + self.net.weights["/_6"])
        return self.decoder.run(ends, lengths)

    def labels(self, words: pa.Array, lengths: np.ndarray) -> np.ndarray:
        numbers, new = self.spellings.of(words)
        self.label.add(self.net.word_vectors(new))
        ends, states = self.label.run(numbers, lengths)
        self.best.add((states @ self.net.weights["/_8"] + self.net.weights["/_9"]).argmax(axis=1)[:, None])
        return self.best.rows[ends, 0]


@dataclass
class Network:
    """Vocabularies and weights; `tagger` says whether the labelling half is there."""

    vocabularies: Vocabularies
    weights: dict[str, np.ndarray]
    tagger: bool = False
    _char_vectors: dict = field(default_factory=dict, repr=False)
    _tables: Tables | None = field(default=None, repr=False)
    _compiled: Compiled | None = field(default=None, repr=False)
    _recurs: bool = field(default=True, repr=False)

    def __post_init__(self) -> None:
        check_weights(self.weights, TAGGER_SHAPES if self.tagger else SEGMENTER_SHAPES)
        check_vocabularies(self.vocabularies, self.weights, self.tagger)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_char_vectors": {}, "_tables": None, "_compiled": None, "_recurs": True}

    def _sides(self, name: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return [tuple(self.weights[f"/{name}/vanilla-lstm-builder{side}/_{k}"] for k in range(3)) for side in ("", "_1")]

    def _looked_up(self) -> Tables:
        if self._tables is None:
            self._tables = Tables(self.vocabularies)
        return self._tables

    def recurs(self) -> bool:
        """Whether states recur, as far as texts have shown."""
        return self._recurs

    def _by_automata(self, ask: Callable[[Compiled], np.ndarray]) -> np.ndarray | None:
        """What the automata give, or None where states don't recur."""
        if not self._recurs:
            return None
        if self._compiled is None or self._compiled.full():
            self._compiled = Compiled(self, self._looked_up())
        try:
            return ask(self._compiled)
        except StatesExceeded:
            self._compiled, self._recurs = None, False
            return None

    def flat_tags(self, lows: list[str]) -> np.ndarray:
        """BMES tags of lower-cased texts, none of them empty, one text after the other."""
        if not lows:
            return np.zeros(0, np.int32)
        found = self._by_automata(lambda c: c.tags(lows))
        if found is not None:
            return found
        w, lengths, contexts = self.weights, np.array([len(x) for x in lows]), Contexts(self, self._looked_up())
        some = list(groups(lows))
        each = [(x.astype(np.int32), new) for x, new in (contexts.of(lows[a:b]) for a, b in some)]
        numbers, features = np.concatenate([x for x, _ in each]), np.concatenate([x for _, x in each])
        del contexts, each
        observed = steps.scores(features, numbers, lengths, self._sides("birnn"), w["/_5"], w["/_6"])
        stop = np.cumsum([0, *lengths])
        return np.concatenate([steps.decode(observed[stop[a] : stop[b]].astype(np.float64), lengths[a:b], w["/_7"].astype(np.float64), BEGIN, END, LOW).astype(np.int8) for a, b in some])

    def flat_labels(self, words: pa.Array, lengths: np.ndarray) -> np.ndarray:
        """Label ids of the words of texts, none of them without words, one text after the other."""
        if not len(lengths):
            return np.zeros(0, np.int64)
        stop = np.cumsum([0, *lengths])
        cuts = np.unique([0, *np.searchsorted(stop, np.arange(GROUP_WORDS, stop[-1], GROUP_WORDS)), len(lengths)])
        found = self._by_automata(lambda c: np.concatenate([c.labels(words.slice(stop[a], stop[b] - stop[a]), lengths[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]))
        if found is not None:
            return found
        numbers, spelt = Numbering().of(words)
        return steps.scores(self._known_vectors(spelt), numbers, lengths, self._sides("birnn_1"), self.weights["/_8"], self.weights["/_9"]).argmax(axis=1)

    def inputs(self, lows: list[str]) -> np.ndarray:
        """The 200 features of each character of lower-cased texts, one text after the other."""
        v, w, tables = self.vocabularies, self.weights, self._looked_up()
        points = code_points(lows)
        sizes = np.array([len(x) for x in lows])
        text = np.repeat(np.arange(len(lows)), sizes)
        ends = np.cumsum(sizes)[text]
        following = np.append(points[1:], LAST)
        following[np.cumsum(sizes) - 1] = LAST
        uni, bi, kind = tables.uni[points], find(tables.bi, points << 21 | following, v.bi["oov"]), tables.kinds[points]
        out = np.empty((len(points), 200), np.float32)
        here, column = np.arange(len(points)) + 2 * text, 0
        for table, ids, pad in ((w["/_0"], uni, PAD_ID), (w["/_1"], bi, PAD_ID), (w["/_3"], kind, PAD_TYPE)):
            around = np.full(len(points) + 2 * len(lows), pad, np.int32)
            around[here + 1] = ids
            for d in range(3):
                out[:, column : column + table.shape[1]] = table[around[here + d]]
                column += table.shape[1]
        start, size, word = tables.words(points, ends)
        word = tables.word_ids[word]
        for place in (start, start + size - 1):
            sums = out[:, column : column + 16]
            sums[:] = w["/_2"][v.word["oov"]]
            if len(place):
                order = np.argsort(place, kind="stable")
                found, first = np.unique(place[order], return_index=True)
                sums[found] = np.add.reduceat(w["/_2"][word[order]], first)
            column += 16
        return out

    def tags(self, lows: list[str]) -> list[list[int]]:
        """BMES tags of lower-cased texts."""
        out: list[list[int]] = [[] for _ in lows]
        for group in batches([len(x) for x in lows]):
            group = [i for i in group if lows[i]]
            if not group:
                continue
            lengths = np.array([len(lows[i]) for i in group])
            states = lstm(self.inputs([lows[i] for i in group]), lengths, *self._sides("birnn"))
            observed = (states @ self.weights["/_5"] + self.weights["/_6"]).astype(np.float64)
            paths = viterbi_batch(padded(observed, lengths), lengths, self.weights["/_7"].astype(np.float64))
            for i, path in zip(group, paths, strict=True):
                out[i] = path
        return out

    def word_vectors(self, words: list[str]) -> np.ndarray:
        """The 64 features of words: their embeddings, those of their characters, and the sums over their candidate labels."""
        if not words:
            return np.zeros((0, 64), np.float32)
        v, w = self.vocabularies, self.weights
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        there, back = self._sides("birnn_2")
        out = np.zeros((len(words), 64), np.float32)
        for a, b in groups([words[i] for i in order], BATCH_CHARS):
            some = order[a:b]
            lengths = np.array([len(words[i]) for i in some])
            spelt = w["/_0"][[v.uni.get(c, v.uni["oov"]) for i in some for c in words[i]]]
            last = np.cumsum(lengths) - 1
            # the state at the last character: the backward half has seen only that one
            out[some, 16:32] = lstm(spelt, lengths, there)[last]
            out[some, 32:48] = lstm(spelt[last], np.ones(len(some), np.int64), back)
        for i, word in enumerate(words):
            if wid := v.word.get(word, v.word["oov"]):
                out[i, :16] = w["/_2"][wid]
            for k in candidates(v.word_tags.get(word, [0]), alnum(word)):
                if k:
                    out[i, 48:] += w["/_4"][k]
        return out

    def _known_vectors(self, words: list[str]) -> np.ndarray:
        if new := list(dict.fromkeys(x for x in words if x not in self._char_vectors)):
            if len(self._char_vectors) >= 100_000:
                self._char_vectors.clear()
                new = list(dict.fromkeys(words))
            self._char_vectors.update(zip(new, self.word_vectors(new), strict=True))
        return np.stack([self._char_vectors[x] for x in words])

    def label_ids(self, texts: list[list[str]]) -> list[list[int]]:
        """Label ids of the words of each text; the first of equally good ones."""
        out: list[list[int]] = [[] for _ in texts]
        for group in batches([len(x) for x in texts], BATCH_CHARS):
            group = [i for i in group if texts[i]]
            if not group:
                continue
            lengths = np.array([len(texts[i]) for i in group])
            x = self._known_vectors([word for i in group for word in texts[i]])
            best = (lstm(x, lengths, *self._sides("birnn_1")) @ self.weights["/_8"] + self.weights["/_9"]).argmax(axis=1)
            for i, ids in zip(group, np.split(best, np.cumsum(lengths)[:-1]), strict=True):
                out[i] = ids.tolist()
        return out


def candidates(ids: list[int], noun: bool) -> list[int]:
    """Candidate label ids in the order of a set of them; a word of letters and digits may be a noun, not unknown."""
    found = set(ids)
    if noun:
        found.discard(0)
        found.add(NOUN)
    return list(found)


def synthetic(seed: int = 0, tagger: bool = True, sample: str = "", more: int = 0) -> Network:
    """A network with random weights over a small vocabulary: for checks of arithmetic and for timing, not for real
    words or labels. With a sample, its characters and parts of up to four are in the vocabularies; `more` made-up pairs
    and words join them."""
    from ..schema import POS_ID

    rng = np.random.default_rng(seed)
    letters = [chr(c) for c in (*range(0x3041, 0x3097), *range(0x30A1, 0x30FB), *range(97, 123), *range(48, 58))] + list("東京都渋谷区民暮猫野家簡単使楽。、　.")
    uni = {"oov": 0, "pad": 1} | {c: i + 2 for i, c in enumerate(letters)}
    bi = {"oov": 0, "pad": 1} | {a + b: i + 2 for i, (a, b) in enumerate((a, b) for a in letters[:60] for b in [*letters[:40], END_MARK])}
    some = ["東京", "東京都", "京都", "渋谷区", "python", "the", "of", "and", "de", "la", "der", "die", "で", "が", "ツール", "使える", "です", "簡単"]
    if sample or more:
        letters += sorted(set(sample) - set(letters))
        uni = {"oov": 0, "pad": 1} | {c: i + 2 for i, c in enumerate(letters)}
        some += sorted({sample[i : i + k] for i in range(len(sample)) for k in range(1, 5)} - set(some))
        made = ["".join(chr(0x4E00 + x) for x in row) for row in rng.integers(0, 2000, (more, 3))]
        some += sorted({m[: 2 + i % 2] for i, m in enumerate(made)})
        bi = {"oov": 0, "pad": 1} | {p: i + 2 for i, p in enumerate(dict.fromkeys([*(sample[i : i + 2] for i in range(len(sample) - 1)), *list(bi)[2:], *(m[:2] for m in made)]))}
    word = {"oov": 0, "pad": 1} | {w: i + 2 for i, w in enumerate(some)}
    shapes = TAGGER_SHAPES if tagger else SEGMENTER_SHAPES
    sizes = {"/_0": len(uni), "/_1": len(bi), "/_2": len(word)}
    weights = {name: rng.normal(0, 0.3, [sizes.get(name) if d is None else d for d in shape[::-1]]).astype(np.float32) for name, shape in shapes.items()}
    tags = {w: [2 + i % 5, (3 * i) % 24] for i, w in enumerate(some)}
    return Network(Vocabularies(uni, bi, word, dict(POS_ID) if tagger else None, tags if tagger else None), weights, tagger)
