"""Approximate nearest neighbours by inner product: inverted lists with product-quantised residuals.

Coarse centroids and the code books of the residuals are fitted by k-means on a bounded sample: the distinct vectors of the least hash, at
most SAMPLE_BYTES of them. There are about as many cells as the square root of the rows, as far as the sample supports that many
(SAMPLED_ROWS a cell) and at most MOST_CELLS. Every row is indexed: its cell, its residual's codes, the length of what they leave out, its
vector. The index is sorted by cell, and a cell that many rows share is split over tasks by row number.

A query looks into its nearest cells, as many as give TARGET recall among the sample's own vectors. There each row's score is estimated
from tables of the query's products with the code words (asymmetric distances). By Cauchy and Schwarz an estimate is off by at most the
query's length times what the codes leave out, so the rows that may be among the k best of a chunk are known and are scored exactly. So the
result is the exact k best of all rows in the probed cells: it does not depend on how rows lie in tasks, and only the probing is
approximate.

Scores are sums of products in double precision, taken row by row, so equal vectors have equal scores. Defined cases: vectors that are
null, empty, zero or hold null or non-finite components take no part; rows that share the query's identifier are its own; rows without
identifier are candidates, last among equal scores; vectors of other lengths than the commonest have no cells and are searched one by
one; an empty table, or one without queries, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import Scratch, split_batches, table
from corvane.llm.vectors import Queries, best, chunks, found_rows, identifiers, matrix, merged, usable

SAMPLE_BYTES, SAMPLED_ROWS, MOST_CELLS = 16 << 20, 24, 2048
WORDS, SUBSPACE, CODE_ROWS = 256, 2, 8_192
TARGET, TRIALS = 0.95, 512
FOUND = "query_id long, vec_id long, score double"


def k_means(points: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[np.sort(rng.permutation(len(points))[:k])].copy()
    for _ in range(rounds):
        own = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        counts = np.bincount(own, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norms, out = (centres**2).sum(axis=1), np.empty(len(points), np.int64)
    for i in range(0, len(points), 8192):
        out[i : i + 8192] = np.argmin(norms - 2 * points[i : i + 8192] @ centres.T, axis=1)
    return out


def neighbourly(centres: np.ndarray) -> np.ndarray:
    """An order of the centres in which near ones tend to stand together: halves by the median of the widest dimension."""
    order, stack = np.arange(len(centres)), [(0, len(centres))]
    while stack:
        start, end = stack.pop()
        if end - start > 2:
            own = centres[order[start:end]]
            widest = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            order[start:end] = order[start:end][np.argsort(own[:, widest], kind="stable")]
            middle = (start + end) // 2
            stack += [(start, middle), (middle, end)]
    return order


@dataclass
class Quantiser:
    centroids: np.ndarray  # cells x dimensions
    words: np.ndarray  # subspaces x words x SUBSPACE
    probes: int

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, k: int, probes: int | None = None) -> Quantiser:
        centroids = k_means(sample, max(1, min(cells, len(sample) // SAMPLED_ROWS)))
        centroids = centroids[neighbourly(centroids)]
        parts = cls.parts(sample[:CODE_ROWS] - centroids[nearest(sample[:CODE_ROWS], centroids)])
        words = np.stack([k_means(parts[:, j], min(WORDS, len(parts)), seed=j) for j in range(parts.shape[1])])
        return cls(centroids, words, probes or cls.needed(sample, centroids, k))

    @staticmethod
    def needed(sample: np.ndarray, centroids: np.ndarray, k: int) -> int:
        """The fewest probes that find TARGET of the k best among the sample's own vectors, for the first TRIALS of them as queries."""
        cells, found = nearest(sample, centroids), []
        for i in range(0, min(TRIALS, len(sample)), 64):
            asked = sample[i : min(i + 64, TRIALS)]
            score = asked @ sample.T
            score[np.arange(len(asked)), i + np.arange(len(asked))] = -np.inf
            top = np.argpartition(-score, min(k, len(sample) - 1) - 1, axis=1)[:, : min(k, len(sample) - 1)]
            place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
            found.append(np.take_along_axis(place, cells[top], axis=1).ravel())
        places = np.sort(np.concatenate(found)) if len(sample) > 1 else np.zeros(1, np.int64)
        return int(places[min(len(places) - 1, int(np.ceil(TARGET * len(places))))]) + 1

    @staticmethod
    def parts(vectors: np.ndarray) -> np.ndarray:
        padded = np.pad(vectors, ((0, 0), (0, -vectors.shape[1] % SUBSPACE)))
        return padded.reshape(len(vectors), -1, SUBSPACE)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's cell, codes, and the length of what they leave out."""
        cells = nearest(vectors, self.centroids)
        parts = self.parts(vectors - self.centroids[cells])
        codes = np.stack([nearest(parts[:, j], self.words[j]) for j in range(parts.shape[1])], axis=1)
        left = parts - self.words[np.arange(parts.shape[1])[None, :], codes]
        return cells, codes.astype(np.uint8), np.sqrt((left**2).sum(axis=(1, 2)))

    def probed(self, queries: np.ndarray) -> np.ndarray:
        return np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")[:, : self.probes]


def _least_hashed(rows: DataFrame, n: int, length: int, size: int) -> np.ndarray:
    """Distinct vectors of the least hashes, at most `size` bytes; a threshold on the hash first, so that no task sorts more than a few times the sample."""
    most = size // (8 * length)
    share = min(1.0, 1.5 * most / max(n, 1))
    key = F.xxhash64("embedding")
    some = rows if share == 1 else rows.filter(key.cast("double") / 2.0**64 + 0.5 < share)
    return matrix(some.select("embedding").distinct().orderBy(F.xxhash64("embedding"), "embedding").limit(most).toArrow()["embedding"].combine_chunks())


def approximate_neighbours(frame: DataFrame, chosen, k: int = 20, cells: int | None = None, probes: int | None = None, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for each chosen row the k best other rows of the cells that it probes."""
    spark = frame.sparkSession
    scratch, rows = Scratch(spark, "index"), usable(frame.select("vec_id", "embedding"), zeros=False)
    lengths = rows.groupBy("length").count().orderBy(F.desc("count"), "length").limit(2).collect()
    if not lengths:
        return merged(spark.createDataFrame([], FOUND), k)
    length, n = lengths[0].length, lengths[0]["count"]
    usual = rows.filter(F.col("length") == length)
    sample = _least_hashed(usual, n, length, sample_bytes)
    model = spark.sparkContext.broadcast(Quantiser.fit(sample, cells or round(n**0.5), k, probes))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split_batches(batches, 4096):
            cells = model.value.probed(matrix(batch.column("embedding"))).astype("<i4")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in cells], pa.binary())], names=[*batch.schema.names, "probed"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split_batches(batches, 8192):
            cell, codes, left = model.value.encode(matrix(batch.column("embedding")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left)], names=[*batch.schema.names, "cell", "codes", "left_out"])

    kind = usual.schema.simpleString()[7:-1].replace(":", " ", 3)
    queries = Queries(usual, chosen, scratch, lambda own: own.mapInArrow(probe, f"{kind}, probed binary"))
    indexed = scratch.keep(usual.mapInArrow(index, f"{kind}, cell int, codes binary, left_out double").withColumn("row", F.monotonically_increasing_id()), "rows")
    dealt = indexed.repartitionByRange("cell", "row").sortWithinPartitions("cell", "row").select("vec_id", "embedding", "length", "cell", "codes", "left_out")
    found = dealt.mapInArrow(_scan_lists(model, queries, k), FOUND)
    if len(lengths) > 1:
        others = rows.filter(F.col("length") != length)
        found = found.unionByName(others.mapInArrow(_scan_rows(Queries(others, chosen, scratch), k), FOUND))
    return merged(found, k)


def _scan_lists(model, queries: Queries, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 2):
            quantiser, points = model.value, matrix(part["embedding"].combine_chunks())
            ids, null = identifiers(part["vec_id"].combine_chunks())
            codes = np.frombuffer(b"".join(part["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
            codes = np.ascontiguousarray(codes.T)
            cells, left = part["cell"].to_numpy(), part["left_out"].to_numpy()
            lists = np.searchsorted(cells, np.arange(len(quantiser.centroids) + 1))
            held = np.diff(lists) > 0
            for block in queries.blocks():
                names, asked = block.column("vec_id").to_numpy(), matrix(block.column("embedding"))
                probed = np.frombuffer(b"".join(block.column("probed").to_pylist()), "<i4").reshape(len(names), -1)
                out = []
                for i in np.flatnonzero(held[probed].any(axis=1)):
                    query, mine = asked[i], np.sort(probed[i][held[probed[i]]])
                    own = np.concatenate([np.arange(lists[c], lists[c + 1]) for c in mine])
                    own = own[ids[own] != names[i]]
                    if not len(own):
                        continue
                    if len(own) > k:
                        words = np.einsum("js,jws->jw", Quantiser.parts(query[None])[0], quantiser.words)
                        most = 2 * len(own) > len(ids)  # then whole columns are quicker than picking from them
                        guess = (quantiser.centroids @ query)[cells if most else cells[own]]
                        for table, column in zip(words, codes if most else codes[:, own], strict=True):
                            guess += table.take(column)
                        guess = guess[own] if most else guess
                        first = own[np.argpartition(-guess, k - 1)[:k]]
                        least = (points[first] * query).sum(axis=1).min()
                        may = guess + np.sqrt(query @ query) * left[own] * (1 + 1e-9) + 1e-9 * (1 + abs(least))
                        own = own[may >= least]
                    score = (points[own] * query).sum(axis=1)
                    top = best(score, ids[own], k)
                    out.append((np.full(len(top), names[i]), own[top], score[top]))
                if out:
                    name, at, score = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield found_rows(name, ids[at], null[at], score)

    return scan


def _scan_rows(queries: Queries, k: int):
    """All rows of the query's length, without an index."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 2):
            points, length = matrix(part["embedding"].combine_chunks()), part["length"][0].as_py()
            ids, null = identifiers(part["vec_id"].combine_chunks())
            for block in queries.blocks():
                if block.column("length")[0].as_py() == length:
                    for name, query in zip(block.column("vec_id").to_pylist(), matrix(block.column("embedding")), strict=True):
                        own = np.flatnonzero(ids != name)
                        score = (points[own] * query).sum(axis=1)
                        top = best(score, ids[own], k)
                        yield found_rows(np.full(len(top), name), ids[own[top]], null[own[top]], score[top])

    return scan


def op10_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approximate_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
