"""What both searches over vectors share: usable rows, a stated query set in files, chunks of rows, and the merge of each task's best.

Queries are a table in the shared folder. A task holds a chunk of rows (at most CHUNK_BYTES) and reads the queries past it, a block at a
time, so neither the driver nor a worker ever holds the query set, no row is sent out once a query, and whatever a task prepares for its
rows is made once. A task hands on at most k rows a query and chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import Scratch, files_of, split_batches

BLOCK, CHUNK_BYTES = 4096, 48 << 20
#: Stands for a null identifier where ties are broken: after all others.
LAST = np.iinfo(np.int64).max


def usable(frame: DataFrame, zeros: bool) -> DataFrame:
    """vec_id, embedding (floats as they are, all else as doubles), length of rows whose vector has no null or non-finite component; zeros: whether zero and empty vectors take part."""
    kind = frame.schema["embedding"].dataType
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    vector = F.col("embedding") if plain else F.col("embedding").cast("array<double>")
    rows = frame.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"))
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = rows.filter(fine & (F.lit(zeros) | F.exists("embedding", lambda x: x != 0)))
    return rows.withColumn("length", F.size("embedding"))


class Queries:
    """The chosen rows in files of the shared folder. Rows that share an identifier are one query, that of the least vector."""

    def __init__(self, rows: DataFrame, chosen: Column, scratch: Scratch, prepare=None):
        own = rows.filter(chosen).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("length", F.size("embedding"))
        self.table = scratch.keep(prepare(own) if prepare else own, "queries", **{"parquet.block.size": 8 << 20})
        self.files = files_of(self.table._scratch_path)

    def blocks(self) -> Iterator[pa.RecordBatch]:
        """On a worker: the queries, at most BLOCK of one vector length at a time."""
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyarrow import fs

        for name in self.files:
            store, path = fs.FileSystem.from_uri(name)
            with store.open_input_file(path) as file:
                for batch in pq.ParquetFile(file).iter_batches(BLOCK):
                    for length in pc.unique(batch.column("length")).to_pylist():
                        yield batch.filter(pc.equal(batch.column("length"), length))

    def __getstate__(self):
        return {"files": self.files}


def matrix(column: pa.Array) -> np.ndarray:
    """A row a vector, in doubles; empty vectors are one zero, which leaves their products at 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 1))


def identifiers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(identifiers with LAST for null, which are null)."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(LAST).to_numpy(zero_copy_only=False), null


def chunks(batches: Iterator[pa.RecordBatch], length: int, size: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Tables of up to about `size` bytes of doubles, each of one vector length; the length stands in column number `length`."""
    import pyarrow.compute as pc

    held: dict[int, list] = {}
    used: dict[int, int] = {}
    for batch in split_batches(batches, 32_768, size):
        for n in pc.unique(batch.column(length)).to_pylist():
            own = batch.filter(pc.equal(batch.column(length), n))
            more = own.num_rows * 8 * max(n, 1)
            if held.get(n) and used[n] + more > size:
                yield pa.Table.from_batches(held.pop(n))
                used[n] = 0
            held.setdefault(n, []).append(own)
            used[n] = used.get(n, 0) + more
            while sum(used.values()) > size and len(held) > 1:  # several lengths share the memory
                most = max(held, key=used.get)
                yield pa.Table.from_batches(held.pop(most))
                used[most] = 0
    for rows in held.values():
        yield pa.Table.from_batches(rows)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by the smaller identifier."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def found_rows(query: np.ndarray, ids: np.ndarray, null: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids, pa.int64(), mask=null), pa.array(score)], names=["query_id", "vec_id", "score"])


def merged(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best of what the tasks handed on."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
