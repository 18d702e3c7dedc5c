"""Operator 6: exact top-k search by inner product, with M-trees.

Vectors x become points (x, sqrt(M^2 - |x|^2)) with M the greatest norm and queries q become (q, 0): then
|p - q|^2 = |q|^2 + M^2 - 2 <q, x>, so the nearest points in this metric are those with the highest inner products.
Points go to the cell of their nearest pivot; pivots are fitted on a bounded sample (SAMPLE vectors, PIVOTS pivots far from
each other), all vectors are in a cell, and a cell's covering radius is measured over all of them. A cell is dealt by ids to
shards of bounded size, each an M-tree: pages of entries with covering radius and distance to the parent's routing point.
A query first searches one shard of its nearest cell. Its k-th best score there is a bound for all other shards: cells
whose covering radius shows that they hold nothing better are left out, the shards of all others are searched best-first,
where entries whose stored parent distance already shows, by the triangle inequality, that they are too far are left out
without computing their distance. Bounds have slack for rounding and never cut ties; scores are exact integers. A task
builds the tree of its shard once and streams a block of queries through it; the shards' best are merged.

Defined results: vectors that are null, empty or hold a null or non-finite component, and rows with a null id, take no
part; vectors of another length than the query's are no candidates for it; rows alike in id and vector count once; all
rows with the query's id are its own; ties go to the smaller id; components and scores beyond the 64-bit integers count as
the nearest of these, and scores that are equal so are ties; extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .runtime import table, written

LEAF, FANOUT = 96, 16
#: Vectors of a shard, about: what one task holds; queries of a block, which are streamed.
SHARD, BLOCK = 8_192, 65_536
#: Vectors that pivots are fitted on at most, and how many pivots there are at most.
SAMPLE, PIVOTS = 2_048, 128
LEAST, MOST = -(1 << 63), (1 << 63) - 1
FOUND = "query_id long, vec_id long, score long"


@dataclass
class Node:
    """A page. Entries are points (leaf) or children; `to_parent` holds each entry's distance to this page's own
    routing point, `radius` the children's covering radii."""

    centre: np.ndarray
    to_parent: np.ndarray
    rows: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)
    centres: np.ndarray | None = None
    radius: np.ndarray | None = None


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - to) ** 2).sum(axis=-1), 0))


def build(points: np.ndarray, rows: np.ndarray, centre: np.ndarray) -> Node:
    """The M-tree of the given rows of points under a routing point, bulk-loaded: each inner page splits its rows
    among FANOUT routing points that lie far from each other. Equal points end in leaves of any size."""
    mine = points[rows]
    far = distances(mine, centre)
    if len(rows) <= LEAF or far.max() - far.min() == 0 and (mine == mine[0]).all():
        return Node(centre, far, rows)
    picked = [int(far.argmax())]
    near = distances(mine, mine[picked[0]])
    owner = np.zeros(len(rows), np.int64)
    for k in range(1, min(FANOUT, math.ceil(len(rows) / LEAF) + 1)):
        nxt = int(near.argmax())
        if near[nxt] == 0:
            break
        picked.append(nxt)
        d = distances(mine, mine[nxt])
        closer = d < near
        owner[closer] = k
        near = np.where(closer, d, near)
    centres = mine[picked]
    groups = [np.flatnonzero(owner == k) for k in range(len(picked))]
    children = [build(points, rows[g], c) for g, c in zip(groups, centres, strict=True)]
    return Node(centre, distances(centres, centre), None, children, centres, np.array([near[g].max() for g in groups]))


def lifted(vectors: np.ndarray, norm2: float) -> np.ndarray:
    """The points of vectors whose squared norm is norm2 at most."""
    real = vectors.astype(np.float64)
    return np.column_stack([real, np.sqrt(np.maximum(float(norm2) - (real**2).sum(axis=1), 0))])


def far_first(points: np.ndarray, n: int) -> np.ndarray:
    """n of the points at most, each as far as may be from those before it."""
    picked = [0]
    near = distances(points, points[0])
    while len(picked) < n and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, distances(points, points[picked[-1]]))
    return points[picked]


class Shard:
    """The vectors of a shard, each once, with the ids that have it in ascending order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm2: float):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        starts = np.flatnonzero(new)
        self.ids = [np.unique(x) for x in np.split(ids, starts[1:])]
        self.vectors = vectors[starts]
        self.exact = norm2 < 1 << 52
        self.points = lifted(self.vectors, norm2)
        self.norm2 = float(norm2)
        self.computed = 0
        self.root = build(self.points, np.arange(len(starts)), self.points.mean(axis=0))

    def scores(self, rows: np.ndarray, query: np.ndarray) -> list[int]:
        if self.exact:  # every product sum is below 2^53, so doubles are exact
            return (self.points[rows, :-1] @ query.astype(np.float64)).astype(np.int64).tolist()
        q = [int(x) for x in query]
        return [max(LEAST, min(MOST, sum(int(a) * b for a, b in zip(self.vectors[r].tolist(), q, strict=True)))) for r in rows]

    def top(self, query_id: int, query: np.ndarray, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The k highest (score, id) but for query_id's own, ties to the smaller id; of scores below floor, if there is
        one, some may be missing."""
        point = np.append(query.astype(np.float64), 0.0)
        base = float((point**2).sum()) + self.norm2
        slack = 1e-6 * (1 + math.sqrt(base))
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        bound = reach(base, floor)
        queue: list[tuple[float, int, Node, float]] = [(0.0, 0, self.root, float(distances(self.root.centre, point)))]
        pushed = 0
        while queue:
            least, _, node, to_centre = heapq.heappop(queue)
            if least > bound:
                break
            gap = np.abs(to_centre - node.to_parent)
            if node.rows is not None:
                near = node.rows[gap <= bound]
                self.computed += len(near)
                for row, score in zip(near.tolist(), self.scores(near, query), strict=True):
                    if len(best) == k and score < best[0][0]:
                        continue
                    left = k
                    for i in self.ids[row]:
                        if i == query_id:
                            continue
                        left -= 1
                        item = (score, -int(i))
                        if len(best) < k:
                            heapq.heappush(best, item)
                        elif item > best[0]:
                            heapq.heapreplace(best, item)
                        else:
                            break
                        if not left:
                            break
                if len(best) == k:
                    bound = min(bound, reach(base, best[0][0]))
                continue
            open_ = np.flatnonzero(gap - node.radius <= bound)
            far = distances(node.centres[open_], point)
            self.computed += len(open_)
            lower = np.maximum(far - node.radius[open_], 0)
            for j, d, low in zip(open_.tolist(), far.tolist(), lower.tolist(), strict=True):
                if low <= bound:
                    pushed += 1
                    heapq.heappush(queue, (max(low - slack, 0.0), pushed, node.children[j], d))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def reach(base: float, score: int | None) -> float:
    """How far a point is at most whose score is at least this; base is |q|^2 + M^2."""
    if score is None or score <= LEAST:
        return math.inf
    return math.sqrt(max(0.0, base - 2.0 * score)) + 1e-6 * (1 + math.sqrt(base))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _segments(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """The runs of rows with equal keys."""
    columns = [batch.column(k).to_numpy() for k in keys]
    new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
    edges = [0, *new.tolist(), batch.num_rows]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if hi > lo:
            yield tuple(int(c[lo]) for c in columns), batch.slice(lo, hi - lo)


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component, x as double; null if the vector takes no part."""
    whole = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(whole, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.transform(whole, lambda x: F.floor(F.lit(256.0) * x).cast("long")))


PLACED = "vec_id long, v array<long>, dim int, cell int, far double"
SHARDS = ["dim", "cell", "part", "block"]


@dataclass(frozen=True)
class Cells:
    """Pivots by dimension, numbered over all; vectors of other dimensions are in cell -1."""

    pivots: dict[int, np.ndarray]
    first: dict[int, int]
    norm2: float

    def places(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (vec_id, v, dim) with their cell and their distance from its pivot."""
        for batch in batches:
            for (dim,), rows in _segments(batch, ["dim"]):
                if dim in self.pivots:
                    points = lifted(_matrix(rows.column("v"), dim), self.norm2)
                    far = np.stack([distances(points, p) for p in self.pivots[dim]])
                    cell, far = far.argmin(axis=0) + self.first[dim], far.min(axis=0)
                else:
                    cell, far = np.full(rows.num_rows, -1), np.zeros(rows.num_rows)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("vec_id", "v", "dim")), pa.array(cell, pa.int32()), pa.array(far)], [x.split()[0] for x in PLACED.split(", ")])

    def may_hold(self, query: np.ndarray, dim: int, floor: int | None, radius: dict[int, float]) -> list[int]:
        """The cells whose covering radius leaves room for a score of floor or more."""
        if dim not in self.pivots:
            return [-1]
        point = np.append(query.astype(np.float64), 0.0)
        bound = reach(float((point**2).sum()) + self.norm2, floor)
        far = distances(self.pivots[dim], point)
        return [c for c, d in enumerate(far.tolist(), self.first[dim]) if c in radius and d - radius[c] <= bound]

    def nearest(self, query: np.ndarray, dim: int) -> int:
        if dim not in self.pivots:
            return -1
        return int(distances(self.pivots[dim], np.append(query.astype(np.float64), 0.0)).argmin()) + self.first[dim]


def cells_of(rows: DataFrame, norm2: float, n: int, shard: int) -> Cells:
    """Pivots in proportion to the vectors there are, fitted on the SAMPLE vectors with the least hashes of their ids."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("dim", "v").collect()
    pivots: dict[int, np.ndarray] = {}
    first: dict[int, int] = {}
    for dim in sorted({r["dim"] for r in some}):
        mine = lifted(np.array([r["v"] for r in some if r["dim"] == dim], np.int64), norm2)
        pivots[dim] = far_first(mine, max(1, min(PIVOTS, math.ceil(n / shard)) * len(mine) // len(some)))
        first[dim] = sum(map(len, pivots.values())) - len(pivots[dim])
    return Cells(pivots, first, norm2)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the k best of vectors (vec_id, v) for each of queries (vec_id, v); v holds
    whole numbers."""
    part = lambda df: df.where(F.col("vec_id").isNotNull() & (F.size("v") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<long>").alias("v"), F.size("v").alias("dim"))
    all_rows, asked = part(vectors), part(queries)
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, most = all_rows.agg(F.count("*"), F.max(squared)).collect()[0]
    n_queries, most_q = asked.agg(F.count("*"), F.max(squared)).collect()[0]
    norm2 = max(most or 0.0, most_q or 0.0) * (1 + 1e-9) + 1
    cells, blocks = cells_of(all_rows, norm2, n, shard), max(1, math.ceil(n_queries / block))
    placed = written(all_rows.mapInArrow(cells.places, PLACED), "placed")
    measured = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # PIVOTS and -1 at most
    radius = {r["cell"]: r["radius"] for r in measured}
    parts = {r["cell"]: math.ceil(r["n"] / shard) for r in measured}
    parts_of = F.lit(1)
    for c, x in parts.items():
        if x > 1:
            parts_of = F.when(F.col("cell") == c, x).otherwise(parts_of)
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts_of).cast("int"))
    block_of = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    asked = asked.withColumn("block", block_of)

    def route(first: bool):
        """Rows (vec_id, v, dim, block, floor) with the shards to be searched: the first one, or all others that may hold
        something."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, to_cell, to_part = [], [], []
                vectors, floors = batch.column("v").to_pylist(), batch.column("floor").to_pylist()
                for i, (v, floor) in enumerate(zip(vectors, floors, strict=True)):
                    query, dim = np.array(v, np.int64), len(v)
                    home = cells.nearest(query, dim)
                    if first:
                        goals = [(home, 0)] if home in parts else []
                    else:
                        goals = [(c, x) for c in cells.may_hold(query, dim, floor, radius) for x in range(parts.get(c, 0)) if (c, x) != (home, 0)]
                    at += [i] * len(goals)
                    to_cell += [c for c, _ in goals]
                    to_part += [x for _, x in goals]
                rows = batch.take(pa.array(at, pa.int64()))
                columns = [*(rows.column(c) for c in ("vec_id", "v", "dim", "block", "floor")), pa.array(to_cell, pa.int32()), pa.array(to_part, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "dim", "block", "floor", "cell", "part"])

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree = None, None
        held: list[pa.RecordBatch] = []
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for (*mine, asks), rows in _segments(batch, [*SHARDS, "asks"]):
                if mine != key:
                    key, tree, held = mine, None, []
                if not asks:
                    held.append(rows)
                    continue
                if not held:
                    continue
                dim = mine[0]
                if tree is None:
                    tree = Shard(np.concatenate([x.column("vec_id").to_numpy() for x in held]), np.concatenate([_matrix(x.column("v"), dim) for x in held]), norm2)
                for i, q, floor in zip(rows.column("vec_id").to_pylist(), _matrix(rows.column("v"), dim), rows.column("floor").to_pylist(), strict=True):
                    for score, found in tree.top(i, q, k, floor):
                        for column, value in zip(out, (i, found, score), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    def searched(first: bool, questions: DataFrame) -> DataFrame:
        routed = questions.select("vec_id", "v", "dim", "block", "floor").mapInArrow(route(first), "vec_id long, v array<long>, dim int, block int, floor long, cell int, part int")
        goals = written(routed, "goals")
        wanted = goals.select(*SHARDS).distinct()
        index = dealt.join(wanted, SHARDS[:3]).select(*SHARDS, "vec_id", "v", F.lit(0).alias("asks"), F.lit(None).cast("long").alias("floor"))
        both = index.unionByName(goals.withColumn("asks", F.lit(1)))
        return both.repartition(*SHARDS).sortWithinPartitions(*SHARDS, "asks").mapInArrow(search, FOUND).distinct()

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    near = written(ranked(searched(True, asked.withColumn("floor", F.lit(None).cast("long")))), "near")
    floors = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    rest = searched(False, asked.join(floors, "vec_id", "left"))
    return ranked(near.select("query_id", "vec_id", "score").unionByName(rest).distinct())


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best for each row whose id is divisible by 50, among all rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", integers(F.col("embedding")).alias("v"))
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


OP6_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""
