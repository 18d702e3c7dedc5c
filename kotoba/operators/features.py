"""Segmentation features in relational form: characters, windows and look-ups in small vocabularies."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import char_type, chars

#: The longest word that is looked up, the ids that stand for places outside a text, the mark of its end.
MAX_WORD = 8
PAD_ID = 1
PAD_TYPE = 6
END_MARK = "<E>"
#: Code points.
POINTS = 0x110000
#: Texts are searched in groups of so many characters (one longer text is a group of its own).
GROUP_CHARS = 1 << 19


def characters(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, ch, type) for each character of a (lower-cased) text."""
    return texts.select(key, F.posexplode(chars(text)).alias("pos", "ch")).withColumn("type", char_type(F.col("ch")))


def bigrams(text: Column | str) -> Column:
    """Each character with the next one, the last with the end mark."""
    c = chars(text)
    following = F.concat(F.slice(c, 2, F.size(c)), F.array(F.lit(END_MARK)))
    return F.zip_with(c, F.slice(following, 1, F.size(c)), lambda a, b: F.concat(a, b))


def look_up(rows: DataFrame, key: str, vocabulary: DataFrame, oov: int, out: str) -> DataFrame:
    """rows with the id of their key in a vocabulary (key, id), else that of oov. Spark broadcasts a vocabulary that is
    small enough by its own measure, as those of a model are (82,000 entries at most), and shuffles else."""
    small = vocabulary.select(F.col("key").alias(key), F.col("id").alias(out))
    return rows.join(small, key, "left").withColumn(out, F.coalesce(out, F.lit(oov)))


def windows(rows: DataFrame, key: str, ids: list[tuple[str, int]]) -> DataFrame:
    """For each of the id columns (and their pads) its value one place before and after within the text."""
    w = Window.partitionBy(key).orderBy("pos")
    for name, pad in ids:
        rows = rows.withColumn(f"{name}_before", F.lag(name, 1, pad).over(w)).withColumn(f"{name}_after", F.lead(name, 1, pad).over(w))
    return rows


def sorted_keys(keys: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    at = np.fromiter(keys, np.int64, len(keys))
    order = np.argsort(at)
    return at[order], np.fromiter(keys.values(), np.int32, len(keys))[order]


def find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, none: int) -> np.ndarray:
    known, values = table
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], none)


class WordTree:
    """Vocabulary words as a tree over code points, whose edges are sorted keys: all places are searched at once."""

    def __init__(self, words: Mapping[str, int]):
        nodes: dict[str, int] = {"": 0}
        edges: dict[int, int] = {}
        for word in words:
            for k in range(1, len(word) + 1 if len(word) <= MAX_WORD else 1):
                if word[:k] not in nodes:
                    nodes[word[:k]] = len(nodes)
                    edges[nodes[word[: k - 1]] << 21 | ord(word[k - 1])] = nodes[word[:k]]
        self.edges = sorted_keys(edges or {-1: 0})
        self.ids = np.full(len(nodes), -1, np.int32)
        for word, node in nodes.items():
            self.ids[node] = words.get(word, -1)
        self.ids[0] = -1
        self.first = np.zeros(POINTS, np.int32)
        roots = {key: node for key, node in edges.items() if key < 1 << 21}
        self.first[list(roots)] = list(roots.values())

    def words(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vocabulary words at all places: where they begin, their lengths and ids, the shorter ones first. ends: where the
        text of each character ends."""
        node = self.first[points]
        at = np.flatnonzero(node)
        node = node[at]
        starts, sizes, ids = [], [], []
        for length in range(1, MAX_WORD + 1):
            word = self.ids[node]
            hit = word >= 0
            starts.append(at[hit])
            sizes.append(np.full(len(starts[-1]), length))
            ids.append(word[hit])
            more = at + length < ends[at]
            at, node = at[more], node[more]
            node = find(self.edges, node.astype(np.int64) << 21 | points[at + length], 0)
            at, node = at[node > 0], node[node > 0]
        return np.concatenate(starts), np.concatenate(sizes), np.concatenate(ids)


def code_points(texts: list[str]) -> np.ndarray:
    """Those of texts that stand one after the other."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)


def groups(texts: list[str | None], limit: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Where groups of neighbouring texts begin and end."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def _tree(vocabulary: DataFrame, lengths: list[int]) -> tuple[WordTree, list[str]]:
    """The words of a vocabulary (key, id) that have one of the lengths, up to MAX_WORD, in ascending length."""
    wanted = {n for n in lengths if n <= MAX_WORD}
    words = sorted({r[0] for r in vocabulary.select("key").collect() if r[0] and len(r[0]) in wanted}, key=lambda w: (len(w), w))
    return WordTree({w: i for i, w in enumerate(words)}), words


def _searched(texts: DataFrame, key: str, text: str, tree: WordTree, name: str, at_end: bool, everywhere: bool) -> DataFrame:
    """(key, pos, the id of a word as `name`): all words at all places, or for every place its longest one, else -1."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            values = batch.column(1).to_pylist()
            for a, b in groups(values):
                part = [x or "" for x in values[a:b]]
                sizes = np.array([len(x) for x in part])
                row, last = np.repeat(np.arange(len(part)), sizes), np.cumsum(sizes)
                start, size, word = tree.words(code_points(part), last[row])
                place = start + size - 1 if at_end else start
                if everywhere:
                    best = np.full(len(row), -1, np.int32)
                    best[place] = word  # the longer ones come later
                    place, word = np.arange(len(row)), best
                row = row[place]
                pos = (place - (last - sizes)[row]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(pos), pa.array(word)], [key, "pos", name])

    schema = T.StructType([texts.schema[key], T.StructField("pos", T.IntegerType()), T.StructField(name, T.IntegerType())])
    return texts.select(key, text).where(F.length(text) > 0).mapInArrow(run, schema)


def candidates(texts: DataFrame, key: str, text: str, vocabulary: DataFrame, lengths: list[int], at_end: bool = False) -> DataFrame:
    """(key, pos, word, length) of vocabulary words that start at each place of a text, or end there: those of the given
    lengths, up to MAX_WORD. The vocabulary (82,000 entries at most in a model) is collected and searched as a tree, text
    by text, so nothing but what is found is ever a row, and nothing is shuffled."""
    tree, words = _tree(vocabulary, lengths)
    known = texts.sparkSession.createDataFrame([(i, w, len(w)) for i, w in enumerate(words)], "__id int, word string, length int")
    return _searched(texts, key, text, tree, "__id", at_end, False).join(F.broadcast(known), "__id").select(key, "pos", "word", "length")


def candidate_lists(texts: DataFrame, key: str, text: str, vocabulary: DataFrame, lengths: list[int], at_end: bool = False, oov: str = "oov") -> DataFrame:
    """(key, pos, words) for every place of every text: its candidates in ascending length, or [oov] where there is none.
    The longest candidate of a place has all others at its start (at its end), so it alone tells the list."""
    tree, words = _tree(vocabulary, lengths)
    some = set(words)
    lists = [(-1, [oov])] + [(i, [x for x in (w[-n:] if at_end else w[:n] for n in range(1, len(w) + 1)) if x in some]) for i, w in enumerate(words)]
    known = texts.sparkSession.createDataFrame(lists, "__id int, words array<string>")
    return _searched(texts, key, text, tree, "__id", at_end, True).join(F.broadcast(known), "__id").select(key, "pos", "words")

