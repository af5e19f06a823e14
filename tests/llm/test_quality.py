import zlib

import numpy as np
import pyarrow as pa

from corvane.llm.quality import dual_coordinate_descent, op7_quality_classifier, score_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op7_quality_classifier(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [r.score for r in held if labels[r.doc_id] == 1], [r.score for r in held if labels[r.doc_id] == 0]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    accuracy = np.mean([r.predicted == labels[r.doc_id] for r in held])
    print("AUC", auc, "accuracy", accuracy, len(held))
    assert auc > 0.97 and accuracy > 0.97


def test_descent_against_direct_minimum():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 6, 3)) for _ in range(60)]
    values, labels = rng.normal(size=6), rng.choice([-1.0, 1.0], 60)
    dense = np.zeros((60, 7))
    for i, r in enumerate(rows):
        dense[i, r], dense[i, -1] = values[r], 1
    w = np.zeros(7)
    for _ in range(20_000):  # plain gradient descent on the primal
        slack = np.maximum(0, 1 - labels * (dense @ w))
        w -= 0.001 * (w - 2 * dense.T @ (labels * slack))
    found = dual_coordinate_descent(rows, values, labels, passes=2000)
    assert np.abs(found - w).max() < 0.05


def test_edges(spark):
    docs = spark.createDataFrame([(1, "good text here", "x"), (2, None, "x"), (None, "", "x"), (3, "BAD!! BAD!! " * 3000, None), (3, "a b", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (9, 1), (None, 0), (2, None)], "doc_id long, quality int")
    for some in (labels, labels.limit(0), labels.filter("quality = 1")):
        rows = score_quality(docs, some, columns=["doc_id", "text"]).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert score_quality(docs.limit(0), labels).count() == 0


def test_scores_against_a_plain_version(spark):
    """Features as sets of strings, ratios by counting, the fit's minimum by Newton's method on dense rows: the same scores."""
    import re

    from corvane.llm.quality import LEAST_ROWS, features, fit, log_count_ratio

    def plain_features(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        shape = [re.sub(r"(?s)(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in w)) for w in words]
        shape = ["<again>" if i and words[i] == words[i - 1] else s for i, s in enumerate(shape)]
        grams = {("s", *shape[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
        return grams | {("w", w.encode().lower()) for w in words}

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    ids = sorted(d for d in labels if d in docs and all(len(w) <= 256 for w in docs[d].split()))
    found, bounds = features(pa.array([docs[d] for d in ids]))
    rows = [found[a:b] & ((1 << 18) - 1) for a, b in zip(bounds, bounds[1:], strict=False)]
    plain = [plain_features(docs[d]) for d in ids]
    assert np.mean([len(set(r.tolist())) == len(p) for r, p in zip(rows, plain, strict=True)]) > 0.5  # hashing joins a few features
    assert all(0 <= len(p) - len(r) <= 1.5 * len(p) ** 2 / 2**19 + 5 for r, p in zip(rows, plain, strict=True))
    y = np.array([1.0 if labels[d] == 1 else -1.0 for d in ids])
    counts = {}
    for p, side in zip(plain, y, strict=True):
        for g in p:
            counts.setdefault(g, [1, 1, 0])[0 if side > 0 else 1] += 1
            counts[g][2] += 1
    places = 1 << 18
    p_sum, q_sum = sum(c[0] - 1 for c in counts.values()) + places, sum(c[1] - 1 for c in counts.values()) + places
    ratio = {g: np.log((c[0] / p_sum) / (c[1] / q_sum)) for g, c in counts.items() if c[2] >= LEAST_ROWS}
    names = {g: i for i, g in enumerate(sorted(ratio))}
    dense = np.zeros((len(ids), len(names) + 1))
    for i, p in enumerate(plain):
        for g in p & names.keys():
            dense[i, names[g]] = ratio[g]
        dense[i, -1] = 1
    kernel = dense @ dense.T  # the minimum lies in the rows' span: w = dense.T @ (y * a)
    a = np.zeros(len(ids))
    for _ in range(60):
        slack = 1 - y * (kernel @ (y * a))
        active = slack > 0
        fresh = np.zeros(len(ids))
        k = kernel[np.ix_(active, active)]
        fresh[active] = y[active] * np.linalg.solve(k + 0.5 * np.eye(active.sum()), y[active])
        if np.allclose(fresh, a, atol=1e-10):
            break
        a = fresh
    want = kernel @ (y * a)
    ours = log_count_ratio(rows, y)
    weights = dual_coordinate_descent(rows, ours, y, passes=400)
    got = np.array([(weights[r] * ours[r]).sum() + weights[-1] for r in rows])
    assert np.corrcoef(got, want)[0, 1] > 0.995 and np.mean(np.sign(got) == np.sign(want)) > 0.99
    weight, slope, shift = fit(rows, y)
    held = [d for d in labels if d in docs]
    scored = {r.doc_id: r.score for r in score_quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), folds=1, held=1).collect()}
    everything, edge = features(pa.array([docs[d] for d in held]))
    all_rows = [everything[a:b] & ((1 << 18) - 1) for a, b in zip(edge, edge[1:], strict=False)]
    if len(held) == len(ids):
        assert all(abs(scored[d] - 1 / (1 + np.exp(-(slope * weight[r].sum() + shift)))) < 0.05 for d, r in zip(held, all_rows, strict=True))
