"""Operator 9: n-gram Jaccard join by chosen paths.

Texts are sets of word five-grams. Equal sets are one class from the start. Every set samples some of its tokens, each
with a probability inverse to the set's size and by a hash of the token alone, so similar sets sample the same ones.
Sets that share a sampled token meet in a bucket. Small buckets are compared by brute force; large ones are split again
by a second sampled token, a third and so on, until they are small or the paths are as long as allowed, and what is
left is compared in blocks. A large bucket has a pivot; sets similar to it leave the bucket, as all that is similar to
them is by the triangle inequality near the pivot too. Those near a pivot make a star, stars that meet are one, and its
sets are compared once, in blocks; buckets all of whose sets are of one star are not split or compared again.
The runs of the join are taken at once: so many times as many tokens as one run would sample, and so many that a pair
at the threshold is compared with the probability `recall` (Params.runs).

These comparisons are of sketches (one-permutation min-hashes of one byte), with a threshold lower than asked for by
more than four standard deviations. A task links what it finds similar by a spanning forest, so there are fewer links
than rows. Within each group that links make the pairs with similar sketches are then compared exactly, in blocks: a
pair is counted once, and no pair is ever a row.

Defined results: null, empty and blank texts have no shingles, no links and are their own class; a text of one to four
words is one shingle; classes go by the smallest doc_id (null where all ids are null); rows with the same id and the same
text are one node, and rows of different texts are nodes of their own whatever their ids are; columns other than the id
and the text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .runtime import bounded_batches, fresh, per_slice, table, written

U = np.uint64
NULL_ID = -(1 << 63)


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    above: int = 4  # similar means a Jaccard index of above / below or more
    below: int = 5
    recall: float = 0.99999  # of pairs at the threshold, even if their buckets are split on every level
    light: int = 96  # sets of a bucket that is compared at once
    depth: int = 3  # tokens of a path
    branch: float = 2.0  # tokens that a set samples to go on with a path
    few: int = 8  # sets that sample so many tokens or fewer go on with all of them
    block: int = 1_024  # sets of a block of what stays large
    sketch: int = 256
    slack: float = 0.12  # of a sketched similarity: above four standard deviations

    def threshold(self) -> float:
        return self.above / self.below

    def least(self) -> float:
        """The sketched similarity that anything similar has."""
        return self.threshold() - self.slack

    def near(self) -> float:
        """The sketched similarity to a pivot that anything has which is similar to a set similar to the pivot."""
        return 2 * self.threshold() - 1 - 2 * self.slack

    def runs(self) -> int:
        """Of a pair at the threshold, sets of one size share 2 threshold / (1 + threshold) of their tokens; the paths that
        they go on with from a bucket, and the sampled tokens that they share in each run, are Poisson numbers. `lost` is
        the chance that a path ends before its last level; the runs make it unlikely enough that all do."""
        t = self.threshold()
        shared, lost = 2 * t / (1 + t), 0.0
        for _ in range(self.depth - 1):
            lost = math.exp(-self.branch * shared * (1 - lost))
        return math.ceil(-math.log(1 - self.recall) / (shared / t * (1 - lost)))

    def sampled(self) -> float:
        """Tokens that a set samples in all runs: 1 / threshold in each."""
        return self.runs() / self.threshold()


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    x = (x + U(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).astype(U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mixed(np.arange(256, dtype=U), 7)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0xD1B54A32D192ED03
_BACK = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's word n-grams, sorted and each once, and where each text's begin (and the end)."""
    coded = [(t or "").encode() for t in texts]
    starts = np.cumsum([0] + [len(c) + 1 for c in coded])[:-1]
    data = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    # a rolling polynomial gives every word's hash from two partial sums
    total = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[data] * powers(_BASE, len(data)), dtype=U)])
    words = mixed((total[end] - total[begin]) * powers(_BACK, len(data))[begin] + (end - begin).astype(U))
    owner = np.searchsorted(starts, begin, "right") - 1
    n_words = np.bincount(owner, minlength=len(coded))
    first = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    hashes = np.zeros(max(0, len(words) - size + 1), U)
    for k in range(size):
        hashes = hashes * U(_BASE) + words[k : k + len(hashes)]
    whole = np.flatnonzero(owner[: len(hashes)] == owner[size - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    few = np.flatnonzero((n_words > 0) & (n_words < size))
    short = [np.bitwise_xor.reduce(mixed(words[first[i] : first[i] + n_words[i]] + np.arange(n_words[i], dtype=U))) + U(n_words[i]) for i in few]
    sets = mixed(np.concatenate([hashes[whole], np.array(short, U)]))
    of = np.concatenate([owner[whole], few])
    order = np.lexsort((sets, of))
    sets, of = sets[order], of[order]
    once = np.ones(len(sets), bool)
    once[1:] = (sets[1:] != sets[:-1]) | (of[1:] != of[:-1])
    sets, of = sets[once], of[once]
    return sets, np.searchsorted(of, np.arange(len(coded) + 1))


def sketches(sets: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """A row for each set: the least hash of each of the bins as one byte, 0 for an empty bin."""
    n = len(at) - 1
    out = np.full(n * bins, 256, np.uint16)
    h = mixed(sets, 1)
    slot = np.repeat(np.arange(n), np.diff(at)) * bins + (h % U(bins)).astype(np.int64)
    order = np.argsort(h, kind="stable")[::-1]  # the least is written last
    out[slot[order]] = 1 + (h[order] >> U(32)) % U(255)
    out[out == 256] = 0
    return out.astype(np.uint8).reshape(n, bins)


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Of a sketch to many, as sketches tell."""
    same = ((many == one) & (many != 0)).sum(axis=1)
    either = ((many != 0) | (one != 0)).sum(axis=1)
    return same / np.maximum(either, 1)


PREPARED = "doc_id long, th long, k1 long, k2 long, n int, tokens array<long>, sketch binary"


def prepared(keyed: DataFrame, p: Params) -> DataFrame:
    """For each row of (doc_id, th, text) the 128-bit hash of its set, its size, its sampled tokens and its sketch."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, at = shingle_sets(batch.column("text").to_pylist(), p.shingle)
        n = np.diff(at)
        total = [np.concatenate([np.zeros(1, U), np.cumsum(mixed(sets, seed), dtype=U)]) for seed in (2, 3)]
        k1, k2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in total)
        chance = np.repeat(np.minimum(p.sampled() / np.maximum(n, 1), 1.0), n)
        taken = (mixed(sets, 4) >> U(11)).astype(np.float64) < chance * float(1 << 53)
        counted = np.concatenate([[0], np.cumsum(taken)])[at]
        tokens = pa.ListArray.from_arrays(pa.array(counted, pa.int32()), pa.array(sets[taken].view(np.int64)))
        sketch = pa.array([x.tobytes() for x in sketches(sets, at, p.sketch)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(k1), pa.array(k2), pa.array(n, pa.int32()), tokens, sketch], ["doc_id", "th", "k1", "k2", "n", "tokens", "sketch"])

    return keyed.mapInArrow(per_slice(run), PREPARED)


def alike(left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Which sketches in left (rows) and right (columns) are similar by at least so much."""
    out = np.empty((len(left), len(right)), bool)
    step = max(1, (1 << 21) // max(1, right.size))
    has = right != 0
    for k in range(0, len(left), step):
        one = left[k : k + step, None, :]
        same = np.count_nonzero((one == right) & has, axis=2)
        either = np.count_nonzero((one != 0) | has, axis=2)
        out[k : k + step] = same >= least * np.maximum(either, 1)
    return out


def roots(similar: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For rows 0 to n the smallest row of its component, where similar[i, j] links left[i] and right[j]."""
    root = np.arange(n)
    while True:
        was = root.copy()
        np.minimum.at(root, left, np.where(similar, root[right][None, :], n).min(axis=1, initial=n))
        np.minimum.at(root, right, np.where(similar, root[left][:, None], n).min(axis=0, initial=n))
        root = root[root]
        if (root == was).all():
            return root


def sketch_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def whole_groups(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.Table]]:
    """Tables of one or more whole groups each, of batches in order of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in keys]
            if held and any(c[0] != x for c, x in zip(columns, last, strict=True)):
                yield pa.Table.from_batches(held)
                held = []
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0))
            if len(new):
                cut = int(new[-1]) + 1
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
                batch = batch.slice(cut)
            held.append(batch)
            last = [c[-1] for c in columns]
        if held:
            yield pa.Table.from_batches(held)

    return run


def borders(rows: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    """Where the groups of a table that is in order of its keys begin and end."""
    columns = [rows.column(k).to_numpy() for k in keys]
    new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
    edges = [0, *new.tolist(), rows.num_rows]
    return list(zip(edges[:-1], edges[1:], strict=True))


BLOCKED = ["bucket", "i", "j"]


def blocks_of(rows: DataFrame, bucket: Column, sets: Column, p: Params) -> DataFrame:
    """(bucket, i, j, left, id) for rows with id, of a bucket of so many sets: each pair of its blocks is a group, and so
    is each block (i = j)."""
    mine = rows.select("id", bucket.alias("bucket"), F.ceil(sets / p.block).cast("int").alias("nb")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"), (F.col("own") <= k).alias("left")))
    return mine.select("bucket", "id", F.explode(pairs).alias("x")).select("bucket", "x.i", "x.j", "x.left", "id")


def measured(classes: DataFrame, large: DataFrame) -> DataFrame:
    """Rows (id, path, used) of large buckets with the class's tokens, their bucket's pivot, the smallest id, and the
    sketched similarity s to it. Classes meet their sketches once, not once for each bucket."""
    pivots = large.groupBy("path").agg(F.min("id").alias("pivot")).join(classes.select(F.col("id").alias("pivot"), F.col("sketch").alias("to")), "pivot")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, to = (sketch_matrix(batch.column(c)) for c in ("sketch", "to"))
            same, either = ((one == to) & (one != 0)).sum(axis=1), ((one != 0) | (to != 0)).sum(axis=1)
            kept = ["path", "id", "used", "tokens", "pivot"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(same / np.maximum(either, 1))], [*kept, "s"])

    of_class = large.groupBy("id").agg(F.collect_list(F.struct("path", "used")).alias("at")).join(classes, "id")
    rows = of_class.select("id", "tokens", "sketch", F.inline("at")).join(written(pivots, "pivots"), "path")
    return rows.select("path", "id", "used", "tokens", "pivot", "sketch", "to").mapInArrow(measure, "path long, id long, used array<long>, tokens array<long>, pivot long, s double")


def buckets_of(classes: DataFrame, p: Params) -> DataFrame:
    """(bucket, i, j, left, id): the sets to be compared with each other, or in blocks."""
    nodes = classes.select("id", F.explode("tokens").alias("path"), F.lit(None).cast("array<long>").alias("used"), F.col("id").alias("star"))
    small: list[DataFrame] = []
    stars: DataFrame | None = None
    edges: DataFrame | None = None
    last: DataFrame | None = None
    for depth in range(1, p.depth + 1):
        # sets of one star are compared in any case
        counts = written(nodes.groupBy("path").agg(F.count("*").alias("c"), F.min("star").alias("a"), F.max("star").alias("b")).where("a <> b").select("path", "c"), f"paths-{depth}")
        met = nodes.join(counts, "path")
        small.append(met.where(F.col("c") <= p.light).groupBy("path").agg(F.sort_array(F.collect_set("id")).alias("ids")).select("ids"))
        if counts.where(F.col("c") > p.light).isEmpty():
            break
        large = met.where(F.col("c") > p.light)
        if depth == p.depth:
            last = large
            break
        seen = written(measured(classes, written(large.select("path", "id", "used"), f"large-{depth}")), f"seen-{depth}")
        new = seen.where((F.col("s") >= p.near()) & (F.col("id") != F.col("pivot"))).select(F.col("id").alias("a"), F.col("pivot").alias("b"))
        edges = new if edges is None else edges.unionByName(new)
        stars = components(edges)
        # what is similar to the pivot goes no further
        going = seen.where(F.col("s") < p.threshold()).groupBy("id").agg(F.collect_list(F.struct("path", F.coalesce("used", F.array("path")).alias("used"))).alias("at"), F.first("tokens").alias("tokens"))
        going = going.join(stars.withColumnRenamed("root", "star"), "id", "left").select("id", "tokens", F.coalesce("star", "id").alias("star"), F.inline("at"))
        chance = F.when(F.size("tokens") <= p.few, F.lit(1 << 20)).otherwise(F.lit(p.branch * (1 << 20)) / F.size("tokens"))
        on = F.filter("tokens", lambda t: ~F.array_contains(F.col("used"), t) & (F.pmod(F.xxhash64(F.col("path"), t), F.lit(1 << 20)) < F.col("chance")))
        deeper = going.withColumn("chance", chance).select("id", "path", "used", "star", F.explode(on).alias("t")).select("id", F.xxhash64("path", "t").alias("path"), F.concat("used", F.array("t")).alias("used"), "star")
        nodes = written(deeper, f"nodes-{depth}")

    # near pairs share many buckets: equal ones are compared once
    sets = small[0]
    for x in small[1:]:
        sets = sets.unionByName(x)
    buckets = sets.where(F.size("ids") > 1).distinct().select(F.xxhash64("ids").alias("bucket"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("left"), F.explode("ids").alias("id"))
    if last is not None:
        buckets = buckets.unionByName(blocks_of(last, F.xxhash64("path", F.lit("large")), F.col("c"), p))
    if stars is not None:
        sizes = written(stars.groupBy("root").agg(F.count("*").alias("c")), "stars")
        buckets = buckets.unionByName(blocks_of(stars.join(sizes, "root"), F.xxhash64("root", F.lit("star")), F.col("c"), p))
    return buckets


def bucket_edges(classes: DataFrame, p: Params) -> DataFrame:
    """(a, b): links of sets whose sketches are similar, as many as connect all those that are similar in a bucket."""
    dealt = buckets_of(classes, p).groupBy("id").agg(F.collect_list(F.struct(*BLOCKED, "left")).alias("at"))
    met = dealt.join(classes.select("id", "sketch"), "id").select("id", "sketch", F.inline("at"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(BLOCKED)(batches):
            ids, mark = rows.column("id").to_numpy(), rows.column("left").to_numpy()
            same = rows.column("i").to_numpy() == rows.column("j").to_numpy()
            sketch = sketch_matrix(rows.column("sketch"))
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            for lo, hi in borders(rows, BLOCKED):
                left = np.arange(hi - lo) if same[lo] else np.flatnonzero(mark[lo:hi])
                right = left if same[lo] else np.flatnonzero(~mark[lo:hi])
                root = roots(alike(sketch[lo:hi][left], sketch[lo:hi][right], p.least()), left, right, hi - lo)
                linked = np.flatnonzero(root != np.arange(hi - lo))
                a.append(ids[lo:hi][linked])
                b.append(ids[lo:hi][root[linked]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return met.repartition(*BLOCKED).sortWithinPartitions(*BLOCKED, "id").mapInArrow(link, "a long, b long").distinct()


def compared(sets: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, p: Params) -> np.ndarray:
    """For sets in left (rows) and right (columns): whether they are similar, exactly, if their sketches are."""
    n = np.diff(at)
    sketch = sketches(sets, at, p.sketch)
    may = alike(sketch[left], sketch[right], p.least())
    both = np.zeros((len(left), len(right)), np.float64)
    _, token, held = np.unique(sets, return_inverse=True, return_counts=True)
    shared = held > 1
    column = np.cumsum(shared) - 1
    width = int(shared.sum())
    if (may @ n[right]).sum() * 8 < len(left) * len(right) * width / 8:  # few pairs: each by itself
        mark = np.zeros(len(held), bool)
        for k, x in enumerate(left.tolist()):
            cols = np.flatnonzero(may[k])
            if not len(cols):
                continue
            mine = token[at[x] : at[x + 1]]
            mark[mine] = True
            for c in cols.tolist():
                y = right[c]
                both[k, c] = np.count_nonzero(mark[token[at[y] : at[y + 1]]])
            mark[mine] = False
    else:
        rows = np.repeat(np.arange(len(n)), n)[shared[token]]
        token = column[token[shared[token]]]
        step = max(1, (8 << 20) // max(1, len(n)))
        order = np.argsort(token, kind="stable")
        rows, token = rows[order], token[order]
        for start in range(0, width, step):
            a, b = np.searchsorted(token, (start, start + step))
            m = np.zeros((len(n), min(step, width - start)), np.float32)
            m[rows[a:b], token[a:b] - start] = 1
            both += m[left] @ m[right].T
    union = n[left][:, None] + n[right][None, :] - both
    return may & (both * p.below >= union * p.above) & (both > 0)


def exact_links(groups: DataFrame, p: Params) -> DataFrame:
    """(id, links, root) for rows (bucket, i, j, left, id, copies, text): how many documents of the other sets of the group
    are similar to id, and the smallest id that similar pairs of this block lead to."""

    def count(rows: pa.Table) -> tuple[np.ndarray, ...]:
        ids = rows.column("id").to_numpy()
        once = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])  # a row may be repeated
        rows, ids = rows.take(pa.array(once)), ids[once]
        copies = rows.column("copies").to_numpy()
        sets, at = shingle_sets(rows.column("text").to_pylist(), p.shingle)
        same = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
        mark = rows.column("left").to_numpy()
        left = np.arange(len(ids)) if same else np.flatnonzero(mark)
        right = left if same else np.flatnonzero(~mark)
        similar = compared(sets, at, left, right, p)
        links = np.zeros(len(ids), np.int64)
        if same:
            np.fill_diagonal(similar, False)
            links[left] = similar @ copies[right]
        else:
            links[left] = similar @ copies[right]
            links[right] = similar.T @ copies[left]
        return ids, links, ids[roots(similar, left, right, len(ids))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(BLOCKED)(batches):
            found = [count(rows.slice(lo, hi - lo)) for lo, hi in borders(rows, BLOCKED)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["id", "links", "root"])

    return groups.repartition(*BLOCKED).sortWithinPartitions(*BLOCKED, "id").mapInArrow(run, "id long, links long, root long")


def judged(docs: DataFrame, p: Params, doc_id: str, text: str) -> DataFrame:
    """doc_id, th (the text's hash), class_id, copy_id, n_links for each row of docs, and whether it stays: of each class
    the node with the smallest (doc_id, th) does, ids that are null coming last."""
    bounded_batches(docs.sparkSession)
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("string").alias("text"))
    rows = written(prepared(keyed, p), "sets")
    node = F.coalesce("doc_id", F.lit(NULL_ID))
    some = rows.where("n > 0")
    least = some.groupBy("k1", "k2").agg(F.min(F.struct(F.isnull("doc_id").alias("unnamed"), node.alias("node"), "th", "tokens", "sketch")).alias("x"))
    copies = some.select("k1", "k2", node.alias("node"), "th").distinct().groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    # ids of documents may be null or used again, so sets are numbered
    ordered = least.join(copies, ["k1", "k2"]).select("k1", "k2", "copies", "x.*").sortWithinPartitions("k1", "k2")
    classes = written(ordered.withColumn("id", F.monotonically_increasing_id()), "classes")
    alone = classes.select("id", "tokens", "sketch")

    grouped = components(bucket_edges(alone, p))
    sizes = written(grouped.groupBy("root").agg(F.count("*").alias("c")), "sizes")
    dealt = blocks_of(grouped.join(sizes, "root"), F.col("root"), F.col("c"), p)
    per_class = dealt.groupBy("id").agg(F.collect_list(F.struct(*BLOCKED, "left")).alias("at"))
    members = per_class.join(classes.select("id", "node", "th", "copies"), "id")
    with_text = members.join(keyed.select(node.alias("node"), "th", "text"), ["node", "th"])
    links = written(exact_links(with_text.select("id", "copies", "text", F.inline("at")), p), "links")
    if sizes.where(F.col("c") > p.block).isEmpty():
        led = links.select("id", "links", "root")
    else:  # a group of several blocks: its blocks' components meet
        met = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
        led = links.groupBy("id").agg(F.sum("links").alias("links")).join(met, "id", "left").select("id", "links", F.coalesce("root", "id").alias("root"))

    first = F.struct("unnamed", "node", "th")
    named = written(led.join(classes.select("id", first.alias("first")), "id"), "named")
    led = named.join(named.groupBy("root").agg(F.min("first").alias("of_root")), "root").select("id", "links", "of_root")
    of_class = classes.select("k1", "k2", "copies", "id", first.alias("of_copy")).join(led, "id", "left")
    of_class = written(of_class.select("k1", "k2", "copies", "links", "of_copy", F.coalesce("of_root", "of_copy").alias("of_class")), "roots")
    out = rows.select("doc_id", "th", "k1", "k2", "n").join(of_class, ["k1", "k2"], "left")
    public = lambda c: F.when(F.col("n") == 0, F.col("doc_id")).when(~F.col(c)["unnamed"], F.col(c)["node"])
    return out.select(
        "doc_id",
        "th",
        public("of_class").alias("class_id"),
        public("of_copy").alias("copy_id"),
        F.when(F.col("n") == 0, F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        ((F.col("n") == 0) | (F.col("of_class") == F.struct(F.isnull("doc_id").alias("unnamed"), node.alias("node"), "th"))).alias("stays"),
    )


def similar_documents(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, class_id (the smallest id that links lead to), copy_id (the smallest id with the same set), n_links (other
    documents that are similar) for each row of docs."""
    return judged(docs, p, doc_id, text).select("doc_id", "class_id", "copy_id", "n_links")


def one_of_each(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """The rows of docs that stay when of each class of similar documents only the one with the smallest id (then the
    smallest hash of the text) does; rows with the same id and the same text are one."""
    key, th = fresh(docs, "key", "th")
    stay = written(judged(docs, p, doc_id, text).where("stays").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(key), F.col("th").alias(th)).distinct(), "stay")
    keyed = docs.withColumns({key: F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)), th: F.xxhash64(F.col(text))})
    return keyed.join(stay, [key, th], "left_semi").dropDuplicates([key, th]).select(*docs.columns)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class and the number of its links."""
    return similar_documents(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')] ELSE
    list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w WHERE len(w) > 0
), classes AS MATERIALIZED (
  SELECT min(doc_id) AS id, count(*) AS copies, list_sort(s) AS s FROM sets GROUP BY list_sort(s)
), tokens AS MATERIALIZED (
  SELECT id, unnest(s) AS t FROM classes
), pairs AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b, count(*) AS n FROM tokens a JOIN tokens b ON a.t = b.t AND a.id <> b.id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT p.a, p.b, y.copies FROM pairs p JOIN classes x ON x.id = p.a JOIN classes y ON y.id = p.b WHERE 5 * n >= 4 * (len(x.s) + len(y.s) - n)
), counted AS (SELECT a, sum(copies) AS n FROM links GROUP BY a),
reach AS (
  WITH RECURSIVE r AS (SELECT id AS a, id AS b FROM classes UNION SELECT r.a, l.b FROM r JOIN links l ON l.a = r.b)
  SELECT a, min(b) AS root FROM r GROUP BY a
), members AS (SELECT s.doc_id, c.id, c.copies FROM sets s JOIN classes c ON list_sort(s.s) = c.s)
SELECT d.doc_id, coalesce(r.root, d.doc_id) AS class_id, coalesce(m.id, d.doc_id) AS copy_id, (coalesce(c.n, 0) + coalesce(m.copies, 1) - 1)::BIGINT AS n_links
FROM documents d LEFT JOIN members m ON m.doc_id = d.doc_id LEFT JOIN reach r ON r.a = m.id LEFT JOIN counted c ON c.a = m.id
"""
