"""Token identifiers in wavelet matrices: one compressed file a shard, readable at any place.

A file holds a shard's identifiers as bit-planes, the highest bit first; each plane stably parts the sequence by its bit. A plane is cut
into frames of FRAME_BITS bits, each packed by zstd alone, and a directory holds how many ones stand before each frame and where it lies
in the file. So a plane answers rank and select from the directory and one frame, and the planes together give access to a token, the
count of an identifier before a place, and the place of its k-th occurrence, from one or two frames a plane; the rest is neither read nor
unpacked. Planes stay packed in memory. Whole shards are decoded a plane at a time.

Documents are dealt by ranges of (identifier, hash of the text) and sorted within them, so shards follow one another in ascending order of
identifiers (nulls first, equal ones by hash and text). A shard closes at SHARD_TOKENS; a longer document has a shard of its own, so
memory is bounded by that and by the longest document, whose text is taken whole. Files are written under a temporary name and moved, so
that a task may run again.

Defined cases: a null text is an empty one and has its end mark alone; null or repeated identifiers stay; an empty table gives no files;
further columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import Scratch, arrow_schema, split_batches, table
from corvane.llm.tokens import encoder, vocabulary

MAGIC = b"CVWM\x02"
SHARD_TOKENS = 1 << 20
FRAME_BITS = 1 << 16
FRAMES_KEPT = 4


class Plane:
    """One bit of every token. read(offset, length) gives bytes of the file; ones_before and offsets have one entry more than there are frames."""

    def __init__(self, read, n: int, ones_before: np.ndarray, offsets: np.ndarray):
        self.read, self.n, self.ones_before, self.offsets = read, n, ones_before, offsets
        self.zeros, self.recent = n - int(ones_before[-1]), {}

    def frame(self, k: int) -> np.ndarray:
        """Its packed bits."""
        if k not in self.recent:
            if len(self.recent) == FRAMES_KEPT:
                del self.recent[next(iter(self.recent))]
            at = int(self.offsets[k])
            self.recent[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.read(at, int(self.offsets[k + 1]) - at)), np.uint8)
        return self.recent[k]

    def bit(self, at: int) -> int:
        k, at = divmod(at, FRAME_BITS)
        return int(self.frame(k)[at >> 3]) >> (7 - (at & 7)) & 1

    def rank1(self, at: int) -> int:
        k, rest = divmod(at, FRAME_BITS)
        if not rest:
            return int(self.ones_before[k])
        packed = self.frame(k)
        some = int.from_bytes(packed[: rest >> 3].tobytes(), "big").bit_count()
        return int(self.ones_before[k]) + some + ((int(packed[rest >> 3]) >> (8 - (rest & 7))).bit_count() if rest & 7 else 0)

    def select(self, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit."""
        before = self.ones_before if bit else np.minimum(np.arange(len(self.ones_before)) * FRAME_BITS, self.n) - self.ones_before
        frame = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.frame(frame), count=min(FRAME_BITS, self.n - frame * FRAME_BITS))
        return frame * FRAME_BITS + int(np.flatnonzero(bits == bit)[k - int(before[frame])])

    def bits(self) -> np.ndarray:
        """All of them, one byte each."""
        start, unpack = int(self.offsets[0]), zstandard.ZstdDecompressor().decompress
        data = self.read(start, int(self.offsets[-1]) - start) if len(self.offsets) > 1 else b""
        packed = b"".join(unpack(data[a - start : b - start]) for a, b in zip(self.offsets.tolist(), self.offsets[1:].tolist(), strict=False))
        return np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n)


class WaveletShard:
    """A shard in an open file (anything with read_at(length, offset), as Arrow's files have)."""

    def __init__(self, file):
        read = lambda offset, length: bytes(file.read_at(length, offset))
        lead = read(0, len(MAGIC) + 4)
        if lead[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack_from("<I", lead, len(MAGIC))
        head = json.loads(read(len(lead), size))
        self.n, self.width, at = head["tokens"], head["bits"], len(lead) + size
        table, self._documents = np.frombuffer(read(at, head["directory"]), "<u4").reshape(2, self.width, -1).astype(np.int64), (at + head["directory"], head["documents"])
        start, self._read = sum(self._documents), read
        offsets = start + np.concatenate([[0], np.cumsum(table[1].ravel())])
        frames = table.shape[2]
        ones = np.concatenate([np.zeros((self.width, 1), np.int64), np.cumsum(table[0], axis=1)], axis=1)
        self.planes = [Plane(read, self.n, ones[i], offsets[i * frames : (i + 1) * frames + 1]) for i in range(self.width)]

    @cached_property
    def documents(self) -> pa.Table:
        return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(self._read(*self._documents))).read_all()

    def access(self, at: int) -> int:
        out = 0
        for plane in self.planes:
            bit, ones = plane.bit(at), plane.rank1(at)
            out, at = out << 1 | bit, plane.zeros + ones if bit else at - ones
        return out

    def count(self, token: int, end: int) -> int:
        """How often the token stands before `end`."""
        if token >> self.width:
            return 0
        start = 0
        for level, plane in enumerate(self.planes):
            a, b = plane.rank1(start), plane.rank1(end)
            start, end = (plane.zeros + a, plane.zeros + b) if token >> (self.width - 1 - level) & 1 else (start - a, end - b)
        return end - start

    def find(self, token: int, k: int) -> int | None:
        """The place of the token's k-th occurrence, from 0."""
        if k >= self.count(token, self.n):
            return None
        at = 0
        for level, plane in enumerate(self.planes):
            ones = plane.rank1(at)
            at = plane.zeros + ones if token >> (self.width - 1 - level) & 1 else at - ones
        at += k
        for level in range(self.width - 1, -1, -1):
            plane, bit = self.planes[level], token >> (self.width - 1 - level) & 1
            at = plane.select(bit, at - plane.zeros if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All of them: the planes undone from the lowest up, one unpacked at a time."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level, plane in enumerate(reversed(self.planes)):
            ones = plane.bits().view(bool)
            back = np.empty(self.n, kind)
            out[plane.zeros :] |= kind(1 << level)
            back[~ones], back[ones] = out[: plane.zeros], out[plane.zeros :]
            out = back
        return out


def encode_shard(ids: np.ndarray, documents: pa.Table) -> bytes:
    pack = zstandard.ZstdCompressor(level=1).compress
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, documents.schema) as writer:
        writer.write_table(documents)
    width, left = max(1, int(ids.max()).bit_length() if len(ids) else 1), ids
    if width <= 16:
        left = ids.astype(np.uint16)
    starts = np.arange(0, len(ids), FRAME_BITS)
    directory, frames = np.zeros((2, width, len(starts)), "<u4"), []
    for row, level in enumerate(range(width - 1, -1, -1)):
        ones = (left & left.dtype.type(1 << level)).astype(bool)
        packed = np.packbits(ones)
        for k, start in enumerate(starts.tolist()):
            frames.append(pack(packed[start >> 3 : (start + FRAME_BITS) >> 3].tobytes()))
            directory[:, row, k] = np.count_nonzero(ones[start : start + FRAME_BITS]), len(frames[-1])
        left = np.concatenate([left[~ones], left[ones]])
    table, counts = pack(sink.getvalue().to_pybytes()), directory.tobytes()
    head = json.dumps({"tokens": len(ids), "bits": width, "directory": len(counts), "documents": len(table)}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, counts, table, *frames])


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_shards(frame: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the files; returns the rows of their manifest (not yet run): part, shard, file, documents, tokens, tokens of the part before."""
    path = vocabulary(tokenizer)
    texts = frame.select(id_column, F.col(text_column).cast("string").alias("text"))
    order = [F.col(id_column).asc_nulls_first(), F.xxhash64("text")]
    ordered = texts.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    schema = T._parse_datatype_string("part int, shard int, file string, documents long, tokens long, part_start long")

    def write(batches):
        from pyspark import TaskContext

        part, encode, state = TaskContext.get().partitionId(), encoder(path), {"shard": 0, "start": 0}
        store, top = _files(folder)
        end, keys, sizes, held, tokens = np.array([end_id], np.uint32), [], [], [], 0

        def close():
            ids, name = np.concatenate(held), f"{top}/{part:06d}-{state['shard']:04d}.wm"
            documents = pa.table({"id": pa.concat_arrays(keys), "tokens": pa.array(np.concatenate(sizes))})
            store.create_dir(top, recursive=True)
            passing = f"{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(passing, compression=None) as out:
                out.write(encode_shard(ids, documents))
            store.move(passing, name)
            row = (part, state["shard"], name, len(documents), len(ids), state["start"])
            state["shard"] += 1
            state["start"] += len(ids)
            for x in (keys, sizes, held):
                x.clear()
            return row

        rows = []
        for batch in split_batches(batches, 16384, 16 << 20):
            ids, own = encode.batch(batch.column(1))
            ends = np.cumsum(own)
            ids, own, ends = np.insert(ids, ends, end), own + 1, ends + np.arange(1, len(own) + 1)
            first = 0
            while first < len(own):  # as many documents as the open shard still takes, one at least
                begun = int(ends[first] - own[first])
                last = max(int(np.searchsorted(ends, begun + shard_tokens - tokens, "right")), first + (not held))
                if last > first:
                    keys.append(batch.column(0).slice(first, last - first))
                    sizes.append(own[first:last].astype(np.int64))
                    held.append(ids[begun : int(ends[last - 1])])
                    tokens += len(held[-1])
                first = last
                if first < len(own) or tokens >= shard_tokens:
                    rows.append(close())
                    tokens = 0
        if held:
            rows.append(close())
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=arrow_schema(schema))

    return ordered.mapInArrow(write, schema)


def read_shards(manifest: DataFrame, folder: str, id_type: T.DataType, id_column: str = "doc_id") -> DataFrame:
    """Each document as the files have it: identifier, tokens before it in all shards, its tokens, and their crc32."""
    schema = T.StructType([T.StructField(id_column, id_type), *[T.StructField(x, T.LongType()) for x in ("start", "n_tokens", "ids_crc32")]])
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens"))  # a row a task of the writer
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))
    n = manifest.count()
    files = manifest.join(starts, "part").select("file", (F.col("before") + F.col("part_start")).alias("start")).repartition(max(1, min(n, 20_000)))

    def read(batches):
        store, _ = _files(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(name) as file:
                    shard = WaveletShard(file)
                    packed, sizes = shard.tokens().astype("<u4").tobytes(), shard.documents["tokens"].to_numpy()
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(packed[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                columns = [shard.documents["id"].combine_chunks(), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema(schema))

    return files.mapInArrow(read, schema)


def op8_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "wavelet")
    folder, docs = scratch.path("shards"), table(spark, sf_dir, "documents")
    manifest = scratch.keep(write_shards(docs, folder), "manifest")
    return read_shards(manifest, folder, docs.schema["doc_id"].dataType)
