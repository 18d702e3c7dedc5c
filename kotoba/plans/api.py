"""Segmenter and Tagger: words and labels of a text column."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WIDE_SPACE, drop_labels, take_labels
from ..functions.unicode import check_version, lower_kept, normalize
from ..operators.dictionary import Trie, force_all
from ..operators.features import code_points, groups
from ..schema import POS_LABELS, TAGGED, WORDS, EmptyToken, KotobaError, parse_label, postags
from ..sources.model import MAGIC, SEGMENTER_SHAPES, TAGGER_SHAPES, check_digest, read_vocabularies, read_weights
from .nn import Network, synthetic


def _find(directory: str | Path, suffix: str) -> Path:
    found = sorted(Path(directory).glob(f"*{suffix}"))
    if not found:
        raise FileNotFoundError(f"no {suffix} file in {directory}")
    return found[0]


#: Characters of texts that are cut together (one longer text is a group of its own), by automata and step by step.
GROUP_CHARS, STEP_CHARS = 1 << 19, 1 << 22
#: Rows in an Arrow batch: bounds the memory of a batch of ordinary documents.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, as a row may hold a long text. Plans read the setting when they run, so it stays; it is
    only ever lowered."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _strings(lists: list[list[str] | None]) -> pa.Array:
    return pa.array(lists, pa.list_(pa.field("element", pa.string(), nullable=False)))


def _lists(values: pa.Array, counts: np.ndarray, known: np.ndarray) -> pa.Array:
    """Lists of so many values each, one after the other; null where not known."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, type=_strings([]).type, mask=pa.array(~known))


@dataclass(frozen=True)
class Cut:
    """The words of texts, one text after the other: how many each has, and whether it is one."""

    words: pa.Array
    counts: np.ndarray
    known: np.ndarray

    def lists(self) -> pa.Array:
        return _lists(self.words, self.counts, self.known)


def pieces(text: str, begins: np.ndarray) -> pa.Array:
    """A text cut where a piece begins, of which one does at its start."""
    data, at = text.encode(), np.flatnonzero(begins)
    if len(data) > len(text):
        points = code_points([text])
        size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        at = (np.cumsum(size) - size)[at]
    offsets = np.append(at, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))


def segment(net: Network, trie: Trie | None, column: pa.Array, lower: bool) -> Cut:
    """Words of texts; the empty text has none."""
    check_version()
    texts = column.to_pylist()
    counts, words = np.zeros(len(texts), np.int64), [pa.array([], pa.string())]
    for a, b in groups(texts, GROUP_CHARS if net.recurs() else STEP_CHARS):
        whole = [normalize(t) if t else "" for t in texts[a:b]]
        some = [i for i, t in enumerate(whole) if t]
        if not some:
            continue
        whole = [whole[i] for i in some]
        lows = [lower_kept(t) for t in whole]
        lengths = np.array([len(t) for t in lows])
        starts = np.cumsum(lengths) - lengths
        tags = net.flat_tags(lows)
        if trie:
            tags = force_all(tags, trie, whole, lengths)
        begins = tags == 3
        begins[1:] |= (tags[:-1] == 2) | (tags[:-1] == 3)
        begins[starts] = True
        counts[[a + i for i in some]] = np.add.reduceat(begins, starts, dtype=np.int64)
        words.append(pieces("".join(lows if lower else whole), begins))
    return Cut(pa.concat_arrays(words), counts, np.array([t is not None for t in texts], bool))


def tokens(words: list[str], lower: bool) -> list[str]:
    """Given tokens as they are labelled."""
    made = [WIDE_SPACE if w in (" ", WIDE_SPACE) else normalize(w) for w in words]
    for i, w in enumerate(made):
        if not w:
            raise EmptyToken(i)
    return [lower_kept(w) for w in made] if lower else made


@dataclass(frozen=True, repr=False)
class Segmenter:
    """Cuts texts into words. The model is broadcast once and shared by all rows; objects don't change."""

    spark: SparkSession
    model: object  # a broadcast Network
    forced: tuple[str, ...] = ()

    @classmethod
    def of(cls, spark: SparkSession, net: Network):
        bounded_batches(spark)
        return cls(spark, spark.sparkContext.broadcast(net))

    @classmethod
    def load(cls, spark: SparkSession, model_dir: str | Path, digests: Mapping[str, str] | None = None, magic: bytes = MAGIC):
        """A model from its directory: one vocabulary file (.dict) and one of weights (.model, or .bin.gz). digests: the
        SHA-256 that files must have, by name. magic: how binary weights begin."""
        weights = next((p for s in (".model", ".bin.gz") for p in sorted(Path(model_dir).glob(f"*{s}"))), None)
        if weights is None:
            raise FileNotFoundError(f"no weights in {model_dir}")
        for name, sha256 in (digests or {}).items():
            check_digest(Path(model_dir) / name, sha256)
        shapes = TAGGER_SHAPES if cls._labels() else SEGMENTER_SHAPES
        return cls.of(spark, Network(read_vocabularies(_find(model_dir, ".dict"), cls._labels()), read_weights(weights, shapes, magic), cls._labels()))

    @classmethod
    def synthetic(cls, spark: SparkSession, seed: int = 0):
        """Random weights, for checks and timing."""
        return cls.of(spark, synthetic(seed, cls._labels()))

    @classmethod
    def _labels(cls) -> bool:
        return False

    def with_words(self, words: Iterable[str]):
        """The same, with these words (and no others) never cut."""
        return replace(self, forced=tuple(words))

    def vocabulary_sizes(self) -> tuple[int, int, int]:
        v = self.model.value.vocabularies
        return len(v.uni), len(v.bi), len(v.word)

    def __repr__(self) -> str:
        return f"{type(self).__name__}(vocabularies={self.vocabulary_sizes()}, forced={len(self.forced)})"

    def _trie(self) -> Trie | None:
        return Trie(self.forced) if self.forced else None

    def words(self, text: Column | str, lower: bool = False) -> Column:
        """The words of a text column, array<string>."""
        model, trie = self.model, self._trie()

        def run(column: pa.Array) -> pa.Array:
            return segment(model.value, trie, column, lower).lists()

        return F.arrow_udf(run, WORDS)(text)

    def register(self, prefix: str = "ja") -> None:
        """SQL functions: <prefix>_words(text) and <prefix>_words_lower(text)."""
        model, trie = self.model, self._trie()

        def function(lower: bool):
            def run(column: pa.Array) -> pa.Array:
                return segment(model.value, trie, column, lower).lists()

            return F.arrow_udf(run, WORDS)

        for tail, lower in (("", False), ("_lower", True)):
            self.spark.udf.register(f"{prefix}_words{tail}", function(lower))


@dataclass(frozen=True, repr=False)
class Tagger(Segmenter):
    """Cuts texts and labels their words. Its words() never runs the labelling half."""

    @classmethod
    def _labels(cls) -> bool:
        return True

    def postags(self) -> DataFrame:
        return postags(self.spark)

    def tagging(self, text: Column | str, lower: bool = False) -> Column:
        """struct<words, postags> of a text column; both halves in one pass."""
        model, trie = self.model, self._trie()

        def run(column: pa.Array) -> pa.Array:
            return _tagged(model.value, segment(model.value, trie, column, lower))

        return F.arrow_udf(run, TAGGED)(text)

    def postagging(self, words: Column | str, lower: bool = False, strict: bool = True) -> Column:
        """Labels of given tokens. A token that is empty after normalisation stops the query, or, if not strict, makes
        the row null."""
        model = self.model

        def run(column: pa.Array) -> pa.Array:
            return _postags(model.value, column, lower, strict)

        return F.arrow_udf(run, WORDS)(words)

    def register(self, prefix: str = "ja") -> None:
        """SQL functions: words(text), tagging(text), postagging(words), filter(text, labels) and extract(text, labels)
        after <prefix>_, and each with _lower after its name. An unknown label stops the query."""
        super().register(prefix)
        model, trie = self.model, self._trie()

        def tagging(lower: bool):
            def run(column: pa.Array) -> pa.Array:
                return _tagged(model.value, segment(model.value, trie, column, lower))

            return F.arrow_udf(run, TAGGED)

        def postagging(lower: bool):
            def run(column: pa.Array) -> pa.Array:
                return _postags(model.value, column, lower, True)

            return F.arrow_udf(run, WORDS)

        def chosen(lower: bool, keep: bool):
            def run(column: pa.Array, labels: pa.Array) -> pa.Array:
                found = segment(model.value, trie, column, lower)
                ids = _label_ids(model.value, found)
                chosen = [frozenset(parse_label(x) for x in some or ()) for some in labels.to_pylist()]
                kinds = {c: k for k, c in enumerate(dict.fromkeys(chosen))}
                kept = np.array([[(p in c) == keep for p in POS_LABELS] for c in kinds], bool).reshape(-1, len(POS_LABELS))
                row = np.repeat(np.arange(len(chosen)), found.counts)
                stay = kept[np.array([kinds[c] for c in chosen], np.int64)[row], ids]
                some = Cut(found.words.filter(pa.array(stay)), np.bincount(row[stay], minlength=len(chosen)), found.known)
                return _pairs(some, ids[stay])

            return F.arrow_udf(run, TAGGED)

        for tail, lower in (("", False), ("_lower", True)):
            made = {"tagging": tagging(lower), "postagging": postagging(lower), "filter": chosen(lower, False), "extract": chosen(lower, True)}
            for name, function in made.items():
                self.spark.udf.register(f"{prefix}_{name}{tail}", function)

    def filter(self, text: Column | str, labels: Iterable[str], lower: bool = False) -> Column:
        """Tagged text without tokens of these labels; the whole text is tagged first."""
        return drop_labels(self.tagging(text, lower), labels)

    def extract(self, text: Column | str, labels: Iterable[str], lower: bool = False) -> Column:
        """Tagged text with only tokens of these labels."""
        return take_labels(self.tagging(text, lower), labels)


def _postags(net: Network, column: pa.Array, lower: bool, strict: bool) -> pa.Array:
    flat = column.flatten().dictionary_encode()
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    spelt = flat.dictionary.to_pylist()
    made: list[str] = []
    for w in spelt:
        try:
            made += tokens([w], lower)
        except KotobaError:
            made.append("")
    row = np.repeat(np.arange(len(counts)), counts)
    at = flat.indices.to_numpy(zero_copy_only=False)
    if len(empty := np.flatnonzero(np.array([not w for w in made], bool)[at]) if len(at) else at):
        if strict:
            raise EmptyToken(int(empty[0] - (np.cumsum(counts) - counts)[row[empty[0]]]))
        known[row[empty]] = False
    stay = known[row]
    counts = np.where(known, counts, 0)
    words = pa.array(made, pa.string()).take(pa.array(at[stay]))
    return _lists(_names(net.flat_labels(words, counts[counts > 0])), counts, known)


def _names(ids: np.ndarray) -> pa.Array:
    return pa.array(POS_LABELS, pa.string()).take(pa.array(ids.astype(np.int64)))


def _label_ids(net: Network, found: Cut) -> np.ndarray:
    return net.flat_labels(found.words, found.counts[found.counts > 0])


def _pairs(found: Cut, ids: np.ndarray) -> pa.Array:
    fields = [pa.field(name, _strings([]).type) for name in ("words", "postags")]
    return pa.StructArray.from_arrays([found.lists(), _lists(_names(ids), found.counts, found.known)], fields=fields, mask=pa.array(~found.known))


def _tagged(net: Network, found: Cut) -> pa.Array:
    return _pairs(found, _label_ids(net, found))
