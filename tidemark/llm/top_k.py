"""Exact top-k by inner product: paged metric trees, searched best first.

Vectors are dealt by id into shards of about ``shard_rows``. In each shard they are lifted by one coordinate,
sqrt(M - |x|^2) with M the shard's largest squared norm, so that the largest inner product is the smallest distance, and
a metric tree is built: pages of at most ``page`` objects, a routing object, covering radius and distance to the
parent's routing object for each entry. A query walks the tree from a heap of nodes by least possible distance; stored
parent distances rule entries out by the triangle inequality before any distance is computed. Scores are taken on the integers
themselves, so the bounds' rounding (they have a small slack) never changes a result. The queries come in blocks; each block meets each
shard, and the shards' best k are merged.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part; only
vectors as long as the query are candidates; a row never finds rows of its own id; ids that repeat are candidates once
for each different vector; equal scores go to the smaller id; with fewer candidates than k all are returned; components so
large that a score might not fit in a long raise, naming the row; columns of other names are not read; empty
tables give an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
RESULT = "query_id long, vec_id long, score long"


class Node:
    __slots__ = ("children", "items", "parent_d", "points", "radius", "router")

    def __init__(self, router: np.ndarray):
        self.router, self.radius, self.children, self.items, self.parent_d, self.points = router, 0.0, None, None, None, None


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    d = points - to
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def build(points: np.ndarray, items: np.ndarray, page: int, fan: int = 16) -> Node:
    """A tree over points[items]. Seeds are spread by farthest-first choice; entries go to the nearest seed."""
    own = points[items]
    node = Node(own[int(np.argmin(distances(own, own.mean(axis=0))))])
    d = distances(own, node.router)
    node.radius = float(d.max())
    if len(items) <= page:
        node.items, node.parent_d, node.points = items, d, own
        return node
    seeds, near = [int(np.argmax(d))], None
    while len(seeds) < min(fan, -(-len(items) // page) + 1):
        new = distances(own, own[seeds[-1]])
        side = np.zeros(len(items), dtype=np.int64) if near is None else np.where(new < near, len(seeds) - 1, side)
        near = new if near is None else np.minimum(near, new)
        seeds.append(int(np.argmax(near)))
    new = distances(own, own[seeds[-1]])
    side = np.where(new < near, len(seeds) - 1, side)
    groups = [g for k in range(len(seeds)) if len(g := items[side == k])]
    if len(groups) == 1:  # all at one place
        groups = np.array_split(items, -(-len(items) // page))
    node.children = [build(points, g, page, fan) for g in groups]
    node.points = np.array([c.router for c in node.children])
    node.parent_d = distances(node.points, node.router)
    return node


class Tree:
    """One shard. ids of equal vectors are kept together, the k + 1 smallest of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, page: int = 64):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        rows = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        _, first, group = np.unique(rows, return_index=True, return_inverse=True)
        self.vectors = vectors[first]
        by = np.argsort(group, kind="stable")
        self.ids = [list(dict.fromkeys(x.tolist()))[: k + 1] for x in np.split(ids[by], np.cumsum(np.bincount(group))[:-1])]
        most = int(np.abs(self.vectors).max()) if self.vectors.size else 0
        self.exact = self.vectors.astype(np.float64) if most * most * max(1, vectors.shape[1]) < 2**52 else self.vectors.astype(object)
        plain = self.vectors.astype(np.float64)
        norms = np.einsum("ij,ij->i", plain, plain)
        self.top = float(norms.max())
        self.root = build(np.column_stack([plain, np.sqrt(np.maximum(self.top - norms, 0))]), np.arange(len(first)), page)
        self.k = k

    def search(self, query_id: int, query: np.ndarray) -> list[tuple[int, int]]:
        """The k best (score, id)."""
        q = np.append(query.astype(np.float64), 0.0)
        exact = query.astype(self.exact.dtype)
        square = float(q @ q)
        best: list[tuple[int, int]] = []  # (-score, id), sorted
        reach = np.inf
        d0 = float(np.sqrt(((self.root.router - q) ** 2).sum()))
        heap, n = [(max(0.0, d0 - self.root.radius), 0, d0, self.root)], 0
        while heap and heap[0][0] <= reach:
            _, _, d, node = heapq.heappop(heap)
            close = np.abs(d - node.parent_d)
            if node.items is None:
                radii = np.array([c.radius for c in node.children])
                maybe = np.flatnonzero(close - radii <= reach)  # by stored distances only
                for i, di in zip(maybe.tolist(), distances(node.points[maybe], q).tolist(), strict=True):
                    if (low := max(0.0, di - radii[i])) <= reach:
                        n += 1
                        heapq.heappush(heap, (low, n, di, node.children[i]))
                continue
            maybe = node.items[close <= reach]
            if not len(maybe):
                continue
            scores = self.exact[maybe] @ exact
            least = -best[-1][0] if len(best) == self.k else None
            for i in range(len(maybe)) if least is None else np.flatnonzero(scores >= least).tolist():
                s = int(scores[i])
                best += [(-s, x) for x in self.ids[maybe[i]] if x != query_id]
            best = sorted(best)[: self.k]
            if len(best) == self.k:
                d2 = square + self.top + 2.0 * best[-1][0]
                reach = float(np.sqrt(max(d2, 0.0))) * (1 + 1e-9) + 1e-4
        return [(-s, x) for s, x in best]


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part.

    Vectors with components so large that a score might not fit in a long raise and name the vec_id, so no score is ever wrong.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine).select("vec_id", checked(F.col("embedding"), scale).alias("v"))


def checked(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of the components; raises where the sum of their squares might not fit in a long."""
    fits = F.forall(embedding, lambda x: F.abs(x * scale) * F.sqrt(F.size(embedding).cast("double")) < float(1 << 30))
    wrong = F.raise_error(F.concat(F.lit("components too large for exact scores in vec_id "), F.col("vec_id").cast("string")))
    return F.when(fits, F.transform(embedding, lambda x: F.floor(x * scale).cast("long"))).otherwise(wrong.cast("array<bigint>"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 32_768, query_rows: int = 32_768, page: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (query_id, v) against vectors (vec_id, v).

    A shard's tree is built once a block of ``query_rows`` queries, which is the largest number that one task holds beside it.
    """
    spark = vectors.sparkSession
    n, m = vectors.count(), queries.count()
    shards = max(1, -(-n // shard_rows), min(spark.sparkContext.defaultParallelism, n // 1024))
    blocks = max(1, -(-m // query_rows))
    left = vectors.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = queries.distinct().select("query_id", "v", F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))

    def meet(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(vs) and len(qs):
            tree = Tree(vs["vec_id"].to_numpy(), np.stack(vs["v"].to_numpy()).astype(np.int64), k, page)
            for query_id, v in zip(qs["query_id"].tolist(), qs["v"].tolist(), strict=True):
                out += [(query_id, x, s) for s, x in tree.search(query_id, np.asarray(v, dtype=np.int64))]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ("dim", "shard", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
