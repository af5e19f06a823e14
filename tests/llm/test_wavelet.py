import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from corvane.llm.shared import Scratch
from corvane.llm.tokens import encoder, vocabulary
from corvane.llm.wavelet import FRAME_BITS, FRAMES_KEPT, WaveletShard, encode_shard, op8_wavelet_tokens, read_shards, write_shards
from tests.llm.conftest import SF


def test_shard_answers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 513, 3000, FRAME_BITS, 3 * FRAME_BITS + 77):
        ids = rng.integers(0, 70, n).astype(np.uint32) ** 2
        shard = WaveletShard(pa.BufferReader(encode_shard(ids, pa.table({"id": [1], "tokens": [n]}))))
        assert shard.tokens().tolist() == ids.tolist()
        for at in [*range(0, n, max(37, n // 80)), *[x for x in (FRAME_BITS - 1, FRAME_BITS, n - 1) if 0 <= x < n]]:
            assert shard.access(at) == ids[at]
            assert shard.count(int(ids[at]), at) == int((ids[:at] == ids[at]).sum())
            assert shard.find(int(ids[at]), int((ids[:at] == ids[at]).sum())) == at
        assert shard.count(1 << 20, n) == 0 and shard.find(3, 0) is None


class Counting:
    def __init__(self, data):
        self.data, self.taken = data, 0

    def read_at(self, length, offset):
        self.taken += length
        return self.data[offset : offset + length]


def test_answers_read_only_the_frames_they_need():
    ids = np.random.default_rng(2).integers(0, 1 << 16, 40 * FRAME_BITS).astype(np.uint32)
    data = encode_shard(ids, pa.table({"id": pa.array(range(50_000)), "tokens": pa.array(range(50_000))}))
    file = Counting(data)
    shard = WaveletShard(file)
    opened = file.taken
    assert opened < len(data) / 100  # the head and the directory
    frame = FRAME_BITS // 8 + 64
    for at in (0, 5 * FRAME_BITS + 3, len(ids) - 1):
        before = file.taken
        assert shard.access(at) == ids[at]
        assert file.taken - before <= 16 * frame
        before = file.taken
        assert shard.count(int(ids[at]), at) == int((ids[:at] == ids[at]).sum())
        assert file.taken - before <= 2 * 16 * frame
        assert shard.find(int(ids[at]), int((ids[:at] == ids[at]).sum())) == at
    assert all(len(p.recent) <= FRAMES_KEPT for p in shard.planes) and file.taken < len(data) / 4


def expected(rows):
    encode, at, out = encoder(vocabulary("word_bpe_49k.json")), 0, []
    for doc, text in rows:
        ids = np.array([*encode._ids(text or ""), 2], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_give_all_documents_back(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, op8_wavelet_tokens(spark, SF).collect())) == expected(sorted(rows))


def test_edges(spark):
    rows = [(2, None), (9, "long " * 100_000), (1, "b c"), (None, "x"), (7, "word " * 50), (3, ""), (3, "A!  b")]
    docs = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, file string")
    scratch = Scratch(spark, "test")
    order = {(r.doc_id, r.text): r.h for r in docs.selectExpr("*", "xxhash64(text) AS h").collect()}
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, order[r]))
    for frame, want in ((docs, expected(rows)), (docs.limit(0), [])):
        folder = scratch.path("shards")
        manifest = scratch.keep(write_shards(frame, folder, shard_tokens=16), "manifest")
        got = [tuple(r) for r in read_shards(manifest, folder, T.LongType()).collect()]
        assert sorted(got, key=lambda r: r[1]) == want
