import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm.periodic_runs import find_runs, op11_periodic_runs, runs_in_texts, runs_of
from tests.llm.conftest import SF


def plain_runs(words, least=2, exponent=2):
    """Brute force: all stretches of each period that nothing extends; a stretch belongs to its smallest period."""
    found, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, exponent * q) and (i, length) not in found:
                found[i, length] = q
            i = max(j, i) + 1
    return sorted((i, length, q) for (i, length), q in found.items())


def of(words):
    return sorted(map(tuple, np.array(runs_of(np.array(words, np.int64)), np.int64).T.tolist()))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_all_runs_of_small_strings(words):
    assert of(words) == plain_runs(words)


def test_all_runs_of_structured_strings():
    rng = random.Random(3)
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    assert of(b) == plain_runs(b)
    for _ in range(60):
        words = []
        while len(words) < 150:
            root = [rng.randrange(3) for _ in range(rng.choice([1, 2, 3, 7, 20]))]
            words += (root * rng.randint(1, 6))[: rng.randint(1, 90)]
        assert of(words) == plain_runs(words)
    assert of([7] * 500) == [(0, 500, 1)] and of([1]) == [] and of([]) == []


def test_texts_of_a_batch_are_apart():
    rng = random.Random(4)
    for exponent, least in ((4, 6), (2, 2), (3, 5), (4, 1), (6, 6)):
        texts = []
        for _ in range(80):
            words = []
            while len(words) < rng.choice([0, 1, 12, 70]):
                words += ([rng.randrange(5) for _ in range(rng.randint(1, 5))] * rng.randint(1, 9))[: rng.randint(1, 40)]
            texts.append(words)
        found = runs_in_texts(np.array([w for t in texts for w in t], np.int64), np.array(list(map(len, texts))), least, exponent)
        want = [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t, least, exponent)]
        assert list(zip(*(x.tolist() for x in found), strict=True)) == want


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 6, 4)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    digest = lambda x: hashlib.sha256(x).hexdigest()
    return (
        doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
        digest("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_the_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = op11_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(expected(r.doc_id, r.text) for r in docs)
    assert sum(r[1] for r in rows) > 10


def test_edges(spark, tmp_path):
    rows = [(1, None, "x"), (2, "", "x"), (None, " \t\n ", "x"), (3, "a b " * 9 + "end", "x"), (3, "a b " * 9 + "end", "x"), (4, " x  " * 7, "x"), (5, "word", "x"), (None, "z " * 20, "x")]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, runs string, collapsed int, n_words long")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(frame).collect()), key=str)
    assert got == sorted([
        (1, 0, [], ""), (2, 0, [], ""), (None, 0, [], ""), (3, 19, [(0, 18, 2)], "a b end"), (3, 19, [(0, 18, 2)], "a b end"),
        (4, 7, [(0, 7, 1)], " x "), (5, 1, [], "word"), (None, 20, [(0, 20, 1)], "z"),
    ], key=str)
    assert find_runs(frame.limit(0)).count() == 0
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, op11_periodic_runs(spark, str(tmp_path)).collect()), key=str) == sorted((expected(r[0], r[1]) for r in rows), key=str)


def test_very_long_texts(spark):
    rng = random.Random(6)
    root = " ".join(f"w{rng.randrange(500)}" for _ in range(30_000))
    text = f"begin {root} {root} {root} {root} {root} end"
    got = find_runs(spark.createDataFrame([(1, text), (2, "same " * 300_000), (3, "one two " * 150_000 + "three")], "doc_id long, text string")).collect()
    assert [[tuple(x) for x in r.runs if x.length > 1000] for r in got] == [[(1, 150_000, 30_000)], [(0, 300_000, 1)], [(0, 300_000, 2)]]
    assert got[0].collapsed == f"begin {root} end" and got[1].collapsed == "same" and got[2].collapsed == "one two three"
