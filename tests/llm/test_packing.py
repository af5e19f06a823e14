import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from corvane.llm.packing import best_fit_plan, op2_best_fit_packing, pack_documents
from corvane.llm.tokens import encoder, vocabulary
from tests.llm.conftest import SF


def slow_best_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, b in enumerate(bins) if capacity - b >= x]
        if fits:
            i = max(fits, key=lambda i: bins[i])
            bins[i] += x
        else:
            bins.append(x)
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for capacity in (1, 7, 64):
        for _ in range(40):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
            histogram = {x: lengths.count(x) for x in set(lengths)}
            plan = best_fit_plan(histogram, capacity)
            used, ranks = {}, {}
            for length, rank, n, first, offset in plan.tolist():
                for k in range(n):
                    used.setdefault(first + k, []).append((offset, length))
                    ranks.setdefault(length, []).append(rank + k)
            for length, got in ranks.items():
                assert sorted(got) == list(range(histogram[length]))
            for got in used.values():
                at = 0
                for offset, length in sorted(got):
                    assert offset == at
                    at += length
                assert at <= capacity
            assert sorted(sum(x for _, x in got) for got in used.values()) == slow_best_fit(lengths, capacity)


def check(rows, texts, capacity, tokenizer="byte_bpe_50k.json"):
    encode = encoder(vocabulary(tokenizer))
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        ids = np.array([*encode._ids(texts[doc] or ""), 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and 0 < r.length <= capacity
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for got in bins.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packs_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = pack_documents(docs, capacity=256).collect()
    n = check(rows, texts, 256)
    total = sum(r.length for r in rows)
    assert n <= total / 256 * 1.02 + 2


def test_the_query(spark):
    """op2 itself, against the library and against plain best-fit decreasing over all pieces."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op2_best_fit_packing(spark, SF).collect()
    n = check(rows, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}, 2048)
    assert n == len(slow_best_fit([r.length for r in rows], 2048))
    for own in ([r for r in rows if r.doc_id == d] for d in {r.doc_id for r in rows if r.piece}):
        assert all(r.length == 2048 for r in own if r.piece) and min(r.length for r in own if not r.piece) > 0


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "word " * 900 + " end", None), (4, "a<|endoftext|>b  c", "x"), (5, "日本\n\n語", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    check(pack_documents(docs, capacity=64).collect(), {r[0]: r[1] for r in rows}, 64)
    again = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b")], "doc_id long, text string")
    assert pack_documents(again).agg(F.count("*"), F.countDistinct("sequence_id")).first() == (3, 1)
    assert pack_documents(docs.limit(0)).count() == 0
    assert len(pack_documents(docs, capacity=64, with_ids=True).filter("doc_id = 2").first().ids) == 4
