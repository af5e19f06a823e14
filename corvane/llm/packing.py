"""Best-fit packing: documents as token identifiers, cut to pieces and laid into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so best-fit decreasing needs no list of all documents: it runs over the histogram of
lengths (at most `capacity` rows, whatever the corpus), and equal lengths are placed run by run. A segment tree over remaining
capacities finds the tightest open bin that takes a length in logarithmic time. The plan has at most a few runs of bins a length, so
its size is bounded by the capacity too; it is broadcast, and each piece finds its place by its rank among the pieces of its length.
Ranks come from counts by (task, length), never from one task that sees all pieces.

Defined cases: a null text is an empty one (its single identifier is the end mark); a null or repeated identifier of a document is kept
as it is, every row is packed; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import Scratch, arrow_schema, split_batches, table
from corvane.llm.tokens import encoder, vocabulary


class CapacityTree:
    """Counts of open bins by remaining capacity. first(x): the smallest remaining capacity from x on that has an open bin."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, remaining: int, bins: int) -> None:
        at = self.leaves + remaining
        while at:
            self.counts[at] += bins
            at >>= 1

    def first(self, least: int) -> int | None:
        at = self.leaves + least
        if not self.counts[at]:
            while at > 1 and (at & 1 or not self.counts[at + 1]):  # up, until a right neighbour has bins
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.counts[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, pieces, first sequence, offset): pieces of consecutive ranks go to consecutive sequences at one offset."""
    tree, open_bins, plan, sequences = CapacityTree(capacity), {}, [], 0

    def keep(remaining: int, first: int, bins: int) -> None:
        if bins and remaining:
            open_bins.setdefault(remaining, []).append((first, bins))
            tree.add(remaining, bins)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.first(length)
            each = (room or capacity) // length  # the tightest bin stays the tightest until it is full
            if room is None:
                room, first, bins = capacity, sequences, -(-left // each)
                sequences += bins
            else:
                first, bins = open_bins[room].pop()
                tree.add(room, -bins)
            full = min(bins, left // each)
            for k in range(each if full else 0):
                plan.append((length, rank + k * full, full, first, capacity - room + k * length))
            keep(room - each * length, first, full)
            left, rank, first, bins = left - each * full, rank + each * full, first + full, bins - full
            if bins and left:  # fewer than a whole bin takes
                for k in range(left):
                    plan.append((length, rank + k, 1, first, capacity - room + k * length))
                keep(room - left * length, first, 1)
                first, bins, left = first + 1, bins - 1, 0
            keep(room, first, bins)
    return np.array(plan, np.int64).reshape(-1, 5)


def _pieces(id_column: str, id_type: T.DataType, path: str, end_id: int, capacity: int, with_ids: bool):
    fields = [T.StructField(id_column, id_type), T.StructField("piece", T.IntegerType()), *[T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32")], T.StructField("part", T.IntegerType()), T.StructField("part_rank", T.LongType())]
    schema = T.StructType([*fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def cut(batches):
        from pyspark import TaskContext

        part, seen, encode, kind = TaskContext.get().partitionId(), Counter(), encoder(path), arrow_schema(schema)
        for batch in split_batches(batches, 16384, 4 << 20):
            ids, sizes = encode.batch(batch.column(1))
            packed, at, rows = ids.astype("<u4").tobytes(), 0, []
            end = np.array([end_id], "<u4").tobytes()
            for doc, size in enumerate(sizes.tolist()):
                own = packed[4 * at : 4 * (at + size)] + end
                at += size
                total, start, piece = size + 1, 0, 0
                length = total % capacity or capacity
                while start < total:
                    some = own[4 * start : 4 * (start + length)]
                    rows.append((doc, piece, start, length, zlib.crc32(some), part, seen[length], *([some] if with_ids else [])))
                    seen[length] += 1
                    start, piece, length = start + length, piece + 1, capacity
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0])), *[pa.array(c, f.type) for c, f in zip(columns[1:], list(kind)[1:], strict=True)]], schema=kind)

    return cut, schema


def pack_documents(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its offset there; with_ids: its identifiers too (packed, 32-bit, little-endian).

    A document of more than `capacity` identifiers is cut; its first piece is the shorter one. Pieces that fill a sequence alone have
    negative sequence numbers made of their task and rank; they need no plan.
    """
    spark = frame.sparkSession
    scratch = Scratch(spark, "packing")
    texts = frame.select(id_column, F.col(text_column).cast("string").alias("text"))
    cut, schema = _pieces(id_column, texts.schema[0].dataType, vocabulary(tokenizer), end_id, capacity, with_ids)
    pieces = scratch.keep(texts.mapInArrow(cut, schema), "pieces")
    short = pieces.filter(F.col("length") < capacity)
    counts = scratch.keep(short.groupBy("part", "length").agg(F.count("*").alias("pieces")), "counts")
    histogram = {r.length: r.pieces for r in counts.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect()}  # under `capacity` rows
    plan = best_fit_plan(histogram, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = spark.sparkContext.broadcast((plan[:, 0] << 48 | plan[:, 1], plan))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("ranks_before"))
    placed_schema = T.StructType([*schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        keys, rows = shared.value
        kind = arrow_schema(placed_schema)
        for batch in batches:
            rank = batch.column("part_rank").to_numpy() + batch.column("ranks_before").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() << 48 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in schema], pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])], schema=kind)

    placed = short.join(base, ["part", "length"]).select(*schema.names, "ranks_before").mapInArrow(place, placed_schema)
    alone = pieces.filter(F.col("length") == capacity).select(*schema.names, (-(F.shiftleft(F.col("part").cast("long"), 36) + F.col("part_rank")) - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone).drop("part", "part_rank")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
