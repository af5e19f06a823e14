import random

import pyarrow as pa

from corvane.llm.quality import PIECE, features, score_quality


def test_pieces_are_tokens():
    long = "x" * 10 + "é1" * 300
    cut = " ".join(long[i : i + PIECE] for i in range(0, len(long), PIECE))
    found, bounds = features(pa.array([f"a {long} b", f"a {cut} b", "", None, long]))
    rows = [set((found[a:b] & ((1 << 18) - 1)).tolist()) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert rows[0] == rows[1] and not rows[2] and not rows[3] and rows[4]


def test_what_comes_after_place_256_counts(spark):
    rng = random.Random(1)

    def text(good):  # no white space, one shape up to place 300
        return "".join(rng.choices("abcdefghij", k=300)) + ("".join(rng.choices("klmnop", k=20)) + "," if good else "".join(rng.choices("0123456789", k=20)) + "!") * 3

    docs = [(i, text(i % 2 == 0)) for i in range(200)]
    labels = [(i, 1 - i % 2) for i in range(100)]
    got = {r.doc_id: r.score for r in score_quality(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert min(got[i] for i in range(100, 200, 2)) > max(got[i] for i in range(101, 200, 2))
