import random

import numpy as np
import pyarrow as pa
import sentencepiece

from corvane.llm.token_counts import MergeCounter, count_tokens, op5_token_counts
from corvane.llm.tokens import CHUNK_CHARS, PackedEncoder, vocabulary
from tests.llm.conftest import SF

SIGNS = [" ", "\n", "a", "Be", "ll", "'s", "!", "12", "é", "́", "  ", "\t", "<s>", "<|endoftext|>", "日本", "▁", "\x1c", "İ", "ß", "　", "\r\n", ".", "🙂", "the", "ing"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_counts_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [*[r.text for r in docs.select("text").collect()], *odd_texts(3000, 5), "x" * 3000, "ab " * 2000, ""]
    counter = MergeCounter(vocabulary("piece_bpe_32k.model"))
    got = np.concatenate([counter.batch(pa.array(texts).slice(a, 700)) for a in range(0, len(texts), 700)])  # slices, as Spark's batches are cut
    assert got.tolist() == [len(x) for x in library.encode(texts)]


def test_the_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    sf = "/root/testdata/sf0.01"
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        n = len(library.encode(r.text or ""))
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 4096))
    found = op5_token_counts(spark, sf).select("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert sorted(map(tuple, found.collect())) == sorted(want) and any(r[3] for r in want)


def test_the_cache_forgets_long_chunks():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encode = PackedEncoder(vocabulary(name))
        rng = random.Random(4)
        for _ in range(3):
            texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice([5, 200]))) for _ in range(30)) for _ in range(20)]
            ids, sizes = encode.batch(pa.array(texts))
            assert ids.tolist() == [i for t in texts for i in encode._ids(t)] and sizes.sum() == len(ids)
            assert max(map(len, encode.known)) <= CHUNK_CHARS
            assert encode.used == sum(encode.lengths[at] for at in encode.known.values())


def test_very_long_texts(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    text = "some words and " * 100_000 + "x" * 100_000
    got = count_tokens(spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n_bytes int")).first()
    assert got.n_tokens == len(library.encode(text)) and got.n_bytes == len(text) and got.over_limit


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "", 2), (3, "word", 3), (3, "word", 3)], "doc_id long, text string, n_tokens long")
    assert sorted(map(tuple, count_tokens(docs, limit=0).collect()), key=str) == [(1, 0, 0, False), (3, 4, 1, True), (3, 4, 1, True), (None, 0, 0, False)]
    assert count_tokens(docs.limit(0)).count() == 0


def test_packed_identifiers_equal_the_library():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encode = PackedEncoder(vocabulary(name))
        texts = odd_texts(3000, 7)
        cut = [encode.batch(pa.array(texts).slice(a, 700)) for a in range(0, len(texts), 700)]
        ids, sizes = np.concatenate([x for x, _ in cut]), np.concatenate([n for _, n in cut])
        at = 0
        for x, n in zip(texts, sizes, strict=True):
            assert ids[at : at + n].tolist() == encode._ids(x), x
            at += n
