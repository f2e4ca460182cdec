"""Operator 10: approximate nearest neighbours by forests of random-projection trees.

Every shard of the vectors has a forest; a tree splits its vectors at the median of a projection on
the difference of two of them.  A query goes through all trees of a forest with one priority queue,
nearest side first, until enough leaves are open; the vectors in these are ranked anew by cosine in
double precision.  How many leaves are enough is found for each shard by an audit: against brute
force over a sample of its queries, the share of true neighbours found must reach ``recall``.
The shards' best are merged by a ranked window, limited before its shuffle.

Equal vectors are indexed once with their ``k + 1`` smallest ids, which is all that a result can show.

Nulls and edge cases: vectors that are null, zero or hold null or non-finite components, and rows
without vec_id, take no part on either side; only vectors of equal length meet; with fewer than ``k``
candidates all are returned; rows alike count once, rows that share a vec_id with other vectors are all searched and all
ask, and a result names an id once, with its largest cosine; an empty table gives no rows; other columns are ignored.

The result is approximate: ``recall`` (0.97) is what each shard's audit asks of its sample on average, so single queries may miss
a neighbour.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineupkit.llm.vectors import against_shards, hashes, is_valid, matrix
from lineupkit.runtime import stash, table


class Forest:
    """Random-projection trees over unit vectors."""

    def __init__(self, unit: np.ndarray, trees: int = 16, leaf: int = 32, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.normals, self.cuts = [], []
        self.children: list[tuple[int, int]] = []  # of a node; a leaf is ~number
        self.leaves: list[np.ndarray] = []
        self.roots = []
        for _ in range(trees):
            self.roots.append(self._grow(unit, np.arange(len(unit)), leaf, rng))

    def _grow(self, unit: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(rows) <= leaf:
            self.leaves.append(rows)
            return ~(len(self.leaves) - 1)
        a, b = rng.choice(rows, 2, replace=False)
        normal = unit[a] - unit[b]
        size = np.sqrt(normal @ normal)
        normal = normal / size if size > 1e-9 else rng.normal(size=unit.shape[1])
        places = unit[rows] @ normal
        order = np.argpartition(places, len(rows) // 2)
        node = len(self.normals)
        self.normals.append(normal)
        self.cuts.append(float(places[order[len(rows) // 2]]))
        self.children.append((0, 0))
        half = len(rows) // 2
        left = self._grow(unit, rows[order[:half]], leaf, rng)
        right = self._grow(unit, rows[order[half:]], leaf, rng)
        self.children[node] = (left, right)
        return node

    def candidates(self, query: np.ndarray, enough: int) -> np.ndarray:
        """Vectors in the leaves that the shared queue reaches first, ``enough`` or a few more."""
        queue = [(-1e9, k) for k in self.roots]
        heapq.heapify(queue)
        found, got = [], 0
        while queue and got < enough:
            worst, node = heapq.heappop(queue)
            # Follow the near side down; the far sides wait in the queue.
            while node >= 0:
                margin, (left, right) = float(self.normals[node] @ query) - self.cuts[node], self.children[node]
                near, far = (right, left) if margin >= 0 else (left, right)
                heapq.heappush(queue, (max(worst, abs(margin)), far))
                node = near
            found.append(self.leaves[~node])
            got += len(found[-1])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


class _Search:
    def __init__(self, shard: pa.Table | None, k: int, recall: float, audit: int) -> None:
        self.k, self.recall, self.audit, self.forest = k, recall, audit, None
        self.enough = 0
        if shard is not None:
            self.vectors = matrix(shard.column("e").combine_chunks())
            self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
            self.copies = shard.column("ids").combine_chunks().to_pylist()
            held = [v for c in self.copies for v in c]
            self.most = int(np.unique(held, return_counts=True)[1].max()) if held else 1  # vectors of one id
            self.forest = Forest(self.vectors / self.norms[:, None])

    def _cosines(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        norm = np.sqrt((query * query).sum())
        return (self.vectors[rows] * query).sum(1) / (norm * self.norms[rows])

    def _audit(self, queries: np.ndarray) -> None:
        n, sample = len(self.vectors), queries[: self.audit]
        unit = sample / np.sqrt((sample * sample).sum(1))[:, None]
        exact = unit @ (self.vectors / self.norms[:, None]).T
        k = min(self.k, n)
        best = np.argpartition(-exact, k - 1, 1)[:, :k]
        self.enough = max(256, 8 * self.k)
        while self.enough < n * len(self.forest.roots):
            hits = [np.isin(b, self.forest.candidates(q, self.enough)).mean() for q, b in zip(unit, best, strict=True)]
            if np.mean(hits) >= self.recall:
                return
            self.enough = self.enough * 3 // 2

    def __call__(self, batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        if batch is None or self.forest is None:
            return
        ids, queries = np.asarray(batch.column("id")), matrix(batch.column("e"))
        if not self.enough:
            self._audit(queries)
        rows: list[tuple[int, int, float]] = []
        for own, query in zip(ids.tolist(), queries, strict=True):
            near = self.forest.candidates(query / np.sqrt((query * query).sum()), self.enough)
            scores = self._cosines(query, near)
            k = self.k * self.most + self.most  # enough whatever ids repeat
            if len(near) > k:  # ties with the last are kept, ids decide below
                edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                near, scores = near[scores >= edge], scores[scores >= edge]
            best = sorted((-s, v) for s, c in zip(scores.tolist(), near.tolist(), strict=True) for v in self.copies[c] if v != own)
            once: dict[int, float] = {}
            for s, v in best:
                if len(once) < self.k:
                    once.setdefault(v, -s)
            rows += [(own, v, s) for v, s in once.items()]
        if rows:
            q, v, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])


def nearest(
    vectors: DataFrame,
    asks: Column,
    k: int = 5,
    recall: float = 0.97,
    audit: int = 64,
    shard_rows: int = 200_000,
    block_rows: int = 100_000,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of ``vectors`` for those where ``asks`` holds.

    ``asks`` is a condition on vec_id.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where(F.col("vec_id").isNotNull() & is_valid(F.col("e")))
    keyed = rows.select("vec_id", "e", *hashes(F.col("e"))).dropDuplicates(["ha_", "hb_", "vec_id"])
    few = keyed.withColumn("place_", F.row_number().over(Window.partitionBy("ha_", "hb_").orderBy("vec_id"))).where(F.col("place_") <= k + 1)
    nodes = few.groupBy("ha_", "hb_").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("e").alias("e"))
    nodes = stash(nodes.select("id", "e", "ids"), "search-nodes")
    queries = rows.where(asks).select(F.col("vec_id").alias("id"), "e", F.array().cast("array<bigint>").alias("ids"))
    shards = max(spark.sparkContext.defaultParallelism, -(-nodes.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    found = against_shards(
        nodes, queries, shards, blocks, lambda s: _Search(s, k, recall, audit), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op10_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every 50th embedding among all."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
