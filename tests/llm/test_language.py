import re
import zlib
from collections import Counter

import numpy as np

from corvane.llm.language import UNKNOWN, identify_language, learn_profiles, op9_language_id
from tests.llm.conftest import SF


def slow_grams(text):
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        padded = f" {word} "
        for n in (1, 2, 3):
            out.update(g for i in range(len(padded) - n + 1) if (g := padded[i : i + n]).strip())
    return out


def packed(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def head(counts, size):
    return [g for g, _ in sorted(((packed(g), n) for g, n in counts.items()), key=lambda x: (-x[1], x[0]))[:size]]


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = {}
    rows = docs.select("doc_id", "text", "lang").collect()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None:
            counts.setdefault(r.lang, Counter()).update(slow_grams(r.text))
    profiles = {lang: head(c, 400) for lang, c in counts.items()}
    got = {r.doc_id: r for r in op9_language_id(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        own = head(slow_grams(r.text), 300)
        distance = {lang: sum(abs(p.index(g) - i) if g in p else 400 for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(distance), key=distance.get) if own else UNKNOWN
        assert got[r.doc_id].lang_pred == best
        assert abs(got[r.doc_id].score - (1 - distance[best] / (400 * len(own)) if own else 0)) < 1e-9
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in op9_language_id(spark, sf).collect() if r.held_out]
    accuracy = np.mean([r.lang_pred == lang[r.doc_id] for r in held])
    print("accuracy", accuracy, len(held))
    assert accuracy > 0.97


def test_edges(spark):
    rows = [(1, "the house and the tree", "en"), (2, None, "en"), (None, "123 !!", None), (3, "das Haus und der Baum " * 3000, "de"), (3, "", "de"), (4, "日本語 é", None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    profiles = learn_profiles(docs)
    assert sorted(profiles) == ["de", "en"]
    got = [r.lang_pred for r in identify_language(docs, profiles, columns=["doc_id", "text"]).collect()]
    assert got[:2] == ["en", UNKNOWN] and got[2] == UNKNOWN and got[3:5] == ["de", UNKNOWN]
    assert {r.lang_pred for r in identify_language(docs, {}).collect()} == {UNKNOWN}
    assert learn_profiles(docs.limit(0)) == {} and identify_language(docs.limit(0), profiles).count() == 0
