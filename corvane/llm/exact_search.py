"""Exact top-k by inner product: a KD-tree a shard.

A tree splits a shard at the median of its widest dimension; each node keeps its tight bounding box. The highest inner product that a box
can hold bounds a query's scores there; a best-first walk takes boxes in the order of that bound and ends where it falls below the
query's k-th score. That score goes along from shard to shard of a chunk, and starts from the query block itself, whose vectors are rows
too. A task builds the trees of its chunk once and reads the query files past them (vectors.Queries).

Vectors become integers, floor(256 * x). Scores are sums of products of integers in double precision while they are below 2**53, in
64-bit integers beyond. Vectors of one length are a search of their own: a query meets the rows whose vectors are as long as its own,
empty ones with score 0. Rows that share the query's identifier are its own; other repeated rows are candidates each; rows without
identifier are candidates too, last among equal scores; vectors that are null or hold null or non-finite components take no part; an
empty table, or one without queries, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import Scratch, table
from corvane.llm.vectors import Queries, best, chunks, found_rows, identifiers, matrix, merged, usable

SCALE, LEAF, SHARD, SEEDS = 256, 256, 32_768, 512
FOUND = "query_id long, vec_id long, score long"


class KdTree:
    def __init__(self, points: np.ndarray):
        self.order, self.nodes = np.arange(len(points)), []
        self._split(points, 0, len(points))
        self.points = points[self.order]
        self.low, self.high = np.array([n[2] for n in self.nodes]), np.array([n[3] for n in self.nodes])

    def _split(self, points: np.ndarray, start: int, end: int) -> int:
        own = points[self.order[start:end]]
        low, high, me = own.min(axis=0), own.max(axis=0), len(self.nodes)
        self.nodes.append([start, end, low, high, None])
        widest = int(np.argmax(high - low))
        if end - start > LEAF and high[widest] > low[widest]:
            middle = (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(own[:, widest], middle)]
            self.nodes[me][4] = (self._split(points, start, start + middle), self._split(points, start + middle, end))
        return me

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest inner product that each node's box can hold, a row a query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def search(tree: KdTree, ids: np.ndarray, first: int, query: np.ndarray, own: int, bounds: np.ndarray, k: int, kept: tuple[np.ndarray, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, places) of those kept and the tree's; only scores from `least` on count. ids: of all places; the tree's begin at `first`."""
    scores, places = kept
    heap = [(-bounds[0], 0)]
    while heap:
        bound, node = heappop(heap)
        if -bound < least:  # equal ones may still hold a smaller identifier
            break
        start, end, _, _, children = tree.nodes[node]
        if children:
            for child in children:
                if bounds[child] >= least:
                    heappush(heap, (-bounds[child], child))
            continue
        found = tree.points[start:end] @ query
        some = np.flatnonzero((found >= least) & (ids[first + start : first + end] != own))
        if len(some):
            scores, places = np.concatenate([scores, found[some]]), np.concatenate([places, some + first + start])
            top = best(scores, ids[places], k)
            scores, places = scores[top], places[top]
            if len(scores) == k:
                least = max(least, scores[-1])
    return scores, places


def exact_top_k(frame: DataFrame, chosen, k: int = 5, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each chosen row the k other rows of the highest integer inner product."""
    rows = usable(frame.select("vec_id", "embedding"), zeros=True)
    queries = Queries(rows, chosen, Scratch(frame.sparkSession, "queries"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 2):
            points, length = np.floor(scale * matrix(part["embedding"].combine_chunks())), part["length"][0].as_py()
            ids, null = identifiers(part["vec_id"].combine_chunks())
            most = np.abs(points).max()
            trees, order = None, None
            for block in queries.blocks():
                if block.column("length")[0].as_py() != length:
                    continue
                names, asked = block.column("vec_id").to_numpy(), np.floor(scale * matrix(block.column("embedding")))
                kind = np.float64 if np.abs(asked).max() * most * points.shape[1] < 2**53 else np.int64
                if trees is None or trees[0].points.dtype != kind:
                    trees = [KdTree(points[i : i + SHARD].astype(kind)) for i in range(0, len(points), SHARD)]
                    order = np.concatenate([tree.order + i * SHARD for i, tree in enumerate(trees)])
                own_ids, own_null = ids[order], null[order]
                asked, kept, least = asked.astype(kind), [(np.zeros(0), np.zeros(0, np.int64))] * len(names), _first_bounds(asked, k)
                for n, tree in enumerate(trees):
                    for i, name in enumerate(names):
                        if i % 256 == 0:
                            bounds = tree.bounds(asked[i : i + 256])
                        floor = max(least[i], kept[i][0][-1] if len(kept[i][0]) == k else -np.inf)
                        kept[i] = search(tree, own_ids, n * SHARD, asked[i], name, bounds[i % 256], k, kept[i], floor)
                sizes, places = [len(s) for s, _ in kept], np.concatenate([p for _, p in kept])
                if len(places):
                    yield found_rows(np.repeat(names, sizes), own_ids[places], own_null[places], np.concatenate([s for s, _ in kept]).astype(np.int64))

    return merged(rows.mapInArrow(scan, FOUND), k)


def _first_bounds(queries: np.ndarray, k: int) -> np.ndarray:
    """A score that each query's k-th best reaches for sure: its k-th best among the block's first vectors."""
    seeds = queries[:SEEDS]
    if len(seeds) <= k or np.abs(queries).max() ** 2 * queries.shape[1] >= 2**53:
        return np.full(len(queries), -np.inf)
    scores = queries @ seeds.T
    own = np.arange(len(seeds))
    scores[own, own] = -np.inf
    return np.partition(scores, len(seeds) - k, axis=1)[:, len(seeds) - k]


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id IS DISTINCT FROM c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
