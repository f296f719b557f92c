"""Nearest neighbours by a forest of random-projection trees with one priority queue over all trees.

The hyperplanes are fitted on a bounded sample (SAMPLE vectors at most, chosen by hash of the id): each node cuts its sample
at the median of the projection on the difference of two sample vectors. Every vector is indexed in every tree. A query
walks all trees at once: what it passes by waits in one queue, ordered by the widest margin by which it was missed, and the
leaves that come out first are taken. What reaches tasks is the sample and the nodes' two vector numbers, of fixed size.

Rows are dealt to blocks by hash, so each vector is moved once. A block joins the ids of a query's leaves to one set (a row
that several trees offer counts once), takes exact distances in double precision to the leaves the query falls into, and
then only to rows of leaves that were missed by less than the k-th distance so far: what lies behind a hyperplane is at
least that far away, so this loses nothing. Each block returns k rows per query.

How many leaves are taken: ENTRIES * rows ** GROWTH index entries' worth, so that the part of the table that is ranked falls
as the table grows, until the trees are as deep as the sample allows (LEAVES); from there on the share of leaves is constant.
Vectors that fill all dimensions evenly need many leaves, clustered ones few, by the bound above. `ranked` says how
many different rows a query was compared with.

Of equal vectors in a block only the k + 1 with the smallest ids can be answers (ties go to smaller ids), so the others
aren't compared. Tables of at most SMALL vectors are one leaf, and the search is exact.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or are shorter or longer than
most of the sample, take no part, neither as queries nor as candidates; rows without id likewise; an empty table gives no
rows. A repeated id is a row of its own, but never a candidate of a query of that id; queries that repeat an id give the
nearest of any of their vectors.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm import common

TREES, LEAF_ROWS, SAMPLE, SEED, SMALL = 48, 12, 16_384, 7, 512
#: Leaves of a tree at most: eight sample vectors for each.
LEAVES = SAMPLE // 8
ENTRIES, GROWTH = 6.0, 0.725


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    return rows.filter(F.col("vec_id").isNotNull() & sound & F.exists("v", lambda x: x != 0))


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy()
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


class Forest:
    """Complete trees in heap order. A node is two numbers of sample vectors, whose difference is its normal, and a cut."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int = TREES, seed: int = SEED):
        self.sample, self.rows, self.depth = sample, rows, 0
        if rows > SMALL:
            self.depth = int(min(np.ceil(np.log2(rows / LEAF_ROWS)), np.log2(max(len(sample), 16) / 8)))
        self.trees = trees if self.depth else 1
        self.leaves, inner = 1 << self.depth, (1 << self.depth) - 1
        self.ends, self.cuts = np.zeros((self.trees, inner, 2), np.int32), np.zeros((self.trees, inner))
        rng = np.random.default_rng(seed)
        for t in range(self.trees):
            at = np.zeros(len(sample), np.int64)  # the node of each sample vector, level by level
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                order = np.argsort(at, kind="stable")
                start = np.searchsorted(at[order], np.arange(width + 1))
                size = np.diff(start)
                pick = lambda: np.where(size > 0, order[np.minimum(start[:-1] + (rng.random(width) * size).astype(np.int64), len(order) - 1)], rng.integers(len(sample), size=width))  # noqa: B023, E731
                ends = np.stack((pick(), pick()), axis=1)
                self.ends[t, first : first + width] = ends
                p = np.einsum("ij,ij->i", sample, self._normals(ends)[at])
                by = np.lexsort((p, at))
                low, high = p[by][np.minimum(start[:-1] + (np.maximum(size, 1) - 1) // 2, len(by) - 1)], p[by][np.minimum(start[:-1] + size // 2, len(by) - 1)]
                cut = np.where(size > 0, (low + high) / 2, 0.0)
                self.cuts[t, first : first + width] = cut
                at = 2 * at + (p > cut[at])
        self._planes = None

    def _normals(self, ends: np.ndarray) -> np.ndarray:
        """Unit normals; equal ends give the first axis."""
        x = self.sample[ends[..., 0]] - self.sample[ends[..., 1]]
        size = np.sqrt((x * x).sum(-1, keepdims=True))
        flat = size[..., 0] == 0
        x[flat, 0] = 1.0
        return x / np.where(size == 0, 1.0, size)

    def __getstate__(self):
        return self.__dict__ | {"_planes": None}

    @property
    def normals(self) -> np.ndarray:
        if self._planes is None:
            self._planes = self._normals(self.ends)
        return self._planes

    def take(self) -> int:
        """How many leaves of all trees a query takes."""
        if not self.depth:
            return 1
        deep = min(self.rows, LEAVES * 2 * LEAF_ROWS)
        entries = ENTRIES * deep**GROWTH / deep * self.rows
        return int(min(self.trees * self.leaves, max(2 * self.trees, np.ceil(entries * self.leaves / self.rows))))

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree, numbered through all trees: shape (rows, trees)."""
        out = np.zeros((len(x), self.trees), np.int32)
        for t in range(self.trees):
            k = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                k = 2 * k + 1 + (np.einsum("ij,ij->i", x, self.normals[t][k]) > self.cuts[t][k])
            out[:, t] = t * self.leaves + k - (self.leaves - 1)
        return out

    def search(self, q: np.ndarray) -> tuple[list[int], list[float]]:
        """The leaves that the shared queue gives first, those the query falls into before all others, and the widest
        margin by which each was missed (0 for the first)."""
        inner, take = self.leaves - 1, self.take()
        margins = (self.normals @ q - self.cuts).tolist() if self.depth else []
        queue, leaves, missed = [(-1.0, t, 0) for t in range(self.trees)], [], []
        while queue and len(leaves) < take:
            by, t, k = heapq.heappop(queue)
            own = margins[t] if margins else []
            while k < inner:
                m = own[k]
                near, far = (2 * k + 2, 2 * k + 1) if m > 0 else (2 * k + 1, 2 * k + 2)
                heapq.heappush(queue, (max(by, abs(m)), t, far))
                k = near
            leaves.append(t * self.leaves + k - inner)
            missed.append(max(by, 0.0))
        return leaves, missed


class Block:
    """The rows of one block, by id, with their leaves."""

    def __init__(self, forest: Forest, ids: np.ndarray, x: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.ascontiguousarray(x[order] + 0.0)  # one zero
        _, alike = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)
        by = np.argsort(alike, kind="stable")
        first = np.searchsorted(alike[by], alike[by])
        keep = np.zeros(len(ids), bool)
        keep[by[np.arange(len(by)) - first <= k]] = True
        self.forest, self.ids, self.x, self.k = forest, ids[keep], x[keep], k
        # For each leaf of all trees its rows, one after the other.
        leaf = forest.place(self.x).ravel()
        entries = np.argsort(leaf, kind="stable")
        self.rows = (entries // forest.trees).astype(np.int32)
        self.starts = np.searchsorted(leaf[entries], np.arange(forest.trees * forest.leaves + 1))
        self.met, self.turn, self.slot = np.zeros(len(self.ids), np.int64), 0, np.zeros(len(self.ids), np.int64)

    def fresh(self, leaves: np.ndarray) -> np.ndarray:
        """The rows of these leaves, each once, that this query hasn't met; they count as met then."""
        n = self.starts[leaves + 1] - self.starts[leaves]
        at = np.repeat(self.starts[leaves] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rows = self.rows[at]
        rows = rows[self.met[rows] != self.turn]
        self.slot[rows] = np.arange(len(rows))
        rows = rows[self.slot[rows] == np.arange(len(rows))]
        self.met[rows] = self.turn
        return rows

    def nearest(self, query: int, q: np.ndarray, leaves: np.ndarray, missed: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and distances of the nearest rows among those in the leaves, and how many were compared."""
        f, ranked = self.forest, 0
        best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
        self.turn += 1
        for part in (slice(0, f.trees), slice(f.trees, None)):
            own = leaves[part]
            if part.start and len(best_d) == self.k:
                own = own[missed[part] <= best_d[-1] * (1 + 1e-9)]
            if not len(own):
                continue
            at = self.fresh(own)
            at = at[self.ids[at] != query]
            ranked += len(at)
            d = np.concatenate((best_d, np.sqrt(((self.x[at] - q) ** 2).sum(axis=1))))
            i = np.concatenate((best_i, self.ids[at]))
            first = np.lexsort((i, d))[: self.k]
            best_d, best_i = d[first], i[first]
        return best_i, best_d, ranked


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, ranked): the k nearest found of every query, and how many rows it was compared with."""
    rows = usable(vectors, id_col, vector_col)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    sizes = np.diff(drawn.offsets.to_numpy()) if len(drawn) else np.ones(1, np.int64)
    size = int(np.bincount(sizes).argmax())
    sample = matrix(drawn.filter(pa.array(sizes == size))) if len(drawn) else np.zeros((0, size))
    rows = rows.filter(F.size("v") == size)
    count = rows.count()
    shared = rows.sparkSession.sparkContext.broadcast(Forest(sample, count))
    blocks = max(1, min(common.partitions_for(vectors, 0.5), count // SMALL))

    def route(batches):
        f = shared.value
        for batch in batches:
            found = [f.search(q) for q in matrix(batch.column(1))]
            leaves, missed = pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([y for _, y in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, leaves, missed], ["vec_id", "v", "leaves", "missed"])

    asked = usable(queries, id_col, vector_col).filter(F.size("v") == size).mapInArrow(route, "vec_id long, v array<double>, leaves array<int>, missed array<double>")
    own = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("array<int>").alias("leaves"), F.lit(None).cast("array<double>").alias("missed"))
    met = own.unionByName(asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "v", "leaves", "missed"))

    def rank(batches):
        """A block's vectors come before its queries, which stream past them."""
        f, number, held, block = shared.value, -1, [], None
        for batch in batches:
            where, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(where) != 0) | (np.diff(kind) != 0)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(where)], strict=True):
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                if where[i] != number:
                    number, held, block = where[i], [], None
                ids, x = part.column(2).to_numpy(), matrix(part.column(3))
                if not kind[i]:
                    held.append((ids, x))
                    continue
                if held:
                    block, held = Block(f, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), k), []
                if block is None:
                    continue
                out = [block.nearest(q, v, a.values.to_numpy(), b.values.to_numpy()) for q, v, a, b in zip(ids.tolist(), x, part.column(4), part.column(5), strict=True)]
                n = [len(o[0]) for o in out]
                cat = lambda c, t: pa.array(np.concatenate([o[c] for o in out]).astype(t))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), cat(0, np.int64), cat(1, np.float64), pa.array(np.repeat([o[2] for o in out], n).astype(np.int64)), pa.array(np.repeat(number, sum(n)).astype(np.int32))], ["query_id", "vec_id", "score", "ranked", "block"])

    found = met.repartition(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(rank, "query_id long, vec_id long, score double, ranked long, block int")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    compared = F.sum(F.when(F.col("n") == 1, F.col("ranked"))).over(Window.partitionBy("query_id"))
    met = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "block").orderBy("score", "vec_id"))).withColumn("ranked", compared)
    met = met.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k)
    return met.groupBy("query_id", "rank").agg(F.min("vec_id").alias("vec_id"), F.min("score").alias("score"), F.max("ranked").alias("ranked"))
