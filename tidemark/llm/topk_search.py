"""Operator 3: exact top-k inner-product search with KD-trees per shard.

A task packs the vectors that it reads into shards of a bounded size and builds a KD-tree
for each: median splits on the widest dimension, and a tight bounding box for each node. The
trees are written once and stay where they are: queries travel. They are packed into blocks of a
bounded number of bytes, and each block is broadcast to the tasks that hold the trees. A task walks
its shards with the kth best scores so far: nodes are visited best first by the greatest score
that their box allows, and a node is left when that is below the kth score. Only the k best of
each task and query are shuffled, and merged by a window per query.

Components are floor(scale * x), products are exact: in floating point while all sums stay below
2 ** 53, in 64-bit integers below 2 ** 63, else in Python's whole numbers; a score beyond the
range of a long is reported, and ranked, as the end of that range.

Nulls and odd rows: vectors that are null, empty or hold null or non-finite components,
and rows with a null id, take no part. Vectors meet only those of their own dimension. A
candidate with the query's id is the query itself. Repeated rows with one id are all
candidates; a query id that repeats gets the first of its vectors in byte order. Ties go
to the smaller id. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, materialize

_EXACT = float(2**53)
_LEAST, _MOST = -(2**63), 2**63 - 1


class Tree:
    """A KD-tree over whole-number vectors: nodes in preorder, leaves as row ranges."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int):
        order = np.arange(len(ids))
        self.lo, self.hi, self.span, self.children = [], [], [], []
        self._build(vectors, order, 0, len(ids), leaf)
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)
        most = np.abs(vectors.astype(np.float64)).max()
        kind = np.int16 if most < 2**15 - 1 else np.int32 if most < 2**31 - 1 else np.int64
        self.ids, self.vectors, self.lo, self.hi = ids[order], vectors[order].astype(kind), self.lo.astype(kind), self.hi.astype(kind)

    def _build(self, vectors: np.ndarray, order: np.ndarray, start: int, end: int, leaf: int) -> int:
        node, rows = len(self.lo), vectors[order[start:end]]
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        self.lo.append(lo), self.hi.append(hi), self.span.append((start, end)), self.children.append(None)
        widest = int(np.argmax(hi - lo))
        if end - start > leaf and hi[widest] > lo[widest]:
            middle = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(rows[:, widest], middle)]
            left = self._build(vectors, order, start, start + middle, leaf)
            self.children[node] = (left, self._build(vectors, order, start + middle, end, leaf))
        return node


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, best: list[list[tuple[int, int]]], k: int) -> None:
    """Update best[i], a heap of (score, -id) for query i, with this tree's candidates."""
    largest = float(np.abs(tree.vectors.astype(np.float64)).max()) * float(np.abs(queries.astype(np.float64)).max()) * queries.shape[1]
    kind = np.float64 if largest < _EXACT else np.int64 if largest < 2.0**62 else object
    vectors, q = tree.vectors.astype(kind), queries.astype(kind)
    lo, hi = tree.lo.astype(kind), tree.hi.astype(kind)
    bounds = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
    clamp = (lambda x: np.clip(x, _LEAST, _MOST)) if kind is object else (lambda x: x)
    bounds = clamp(bounds)
    for i, (own, found) in enumerate(zip(query_ids, best, strict=True)):
        row = bounds[i]
        open_nodes = [(-row[0], 0)]
        while open_nodes:
            bound, node = heapq.heappop(open_nodes)
            if len(found) == k and -bound < found[0][0]:
                break
            if (pair := tree.children[node]) is not None:
                for child in pair:
                    if len(found) < k or row[child] >= found[0][0]:
                        heapq.heappush(open_nodes, (-row[child], child))
                continue
            start, end = tree.span[node]
            scores = clamp(vectors[start:end] @ q[i])
            at = np.arange(end - start) if len(found) < k else np.flatnonzero(scores >= found[0][0])
            for j in at:
                if (one := int(tree.ids[start + j])) != own:
                    entry = (int(scores[j]), -one)
                    if len(found) < k:
                        heapq.heappush(found, entry)
                    elif entry > found[0]:
                        heapq.heapreplace(found, entry)


def _whole(vectors: DataFrame, scale: int) -> DataFrame:
    """Usable vectors as whole numbers: vec_id, dim, v."""
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    usable = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return whole.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & usable).select("vec_id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))


def _shards(whole: DataFrame, size: int, leaf: int) -> DataFrame:
    """Packed KD-trees: shard, dim, tree."""

    def pack(shard: int, dim: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        tree = Tree(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), leaf)
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "dim": pa.array([dim], pa.int32()), "tree": pa.array([pickle.dumps(tree, 5)], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = (context.partitionId() if context else 0) << 32
        held: dict[int, list] = {}
        for batch in batches:
            ids, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            offsets, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                vectors = flat[offsets[rows][:, None] + np.arange(dim)]
                for at in range(0, len(rows), size):
                    parts = held.setdefault(int(dim), [])
                    parts.append((ids[rows[at : at + size]], vectors[at : at + size]))
                    if sum(len(p[0]) for p in parts) >= size:
                        yield pack(shard, int(dim), held.pop(int(dim)))
                        shard += 1
        for dim, parts in held.items():
            yield pack(shard, dim, parts)
            shard += 1

    return whole.mapInArrow(run, "shard long, dim int, tree binary")


def top_k(vectors: DataFrame, is_query: str, k: int = 10, scale: int = 1024, shard_size: int = 4096, leaf: int = 128, block_bytes: int = 32 << 20) -> DataFrame:
    """For each row that ``is_query`` selects (an SQL condition on vec_id): query_id, rank
    (from 1), vec_id and score of its k best candidates among all other rows."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    whole = _whole(vectors, scale)
    trees = materialize(_shards(whole, shard_size, leaf), "trees")
    queries = whole.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select(F.col("vec_id").alias("query_id"), "q.dim", "q.v")
    queries = materialize(queries, "queries")
    sizes = queries.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()

    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for dim, n in sizes:
        blocks = -(-n * dim * 8 // block_bytes)
        mine = trees.where(F.col("dim") == dim).select("tree")
        for b in range(blocks):
            part = queries.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).select("query_id", "v").toArrow()
            if part.num_rows:
                ids, flat = part.column(0).to_numpy(), part.column(1).combine_chunks().flatten().to_numpy()
                found = found.unionByName(_searched(mine, ids, flat.reshape(len(ids), dim), k))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(trees: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The k best of each task's trees for one block of queries."""
    shared = trees.sparkSession.sparkContext.broadcast((query_ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in ids]
        for batch in batches:
            for tree in batch.column(0):
                search(pickle.loads(tree.as_py()), ids, queries, best, k)
        rows = [(int(q), -e[1], e[0]) for q, found in zip(ids, best, strict=True) for e in found]
        for at in range(0, len(rows), 100_000):
            cols = zip(*rows[at : at + 100_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return trees.mapInArrow(run, "query_id long, vec_id long, score long")
