from collections import Counter

import pandas as pd

from corvane.llm.mixing import ORACLE, mix_documents, op3_source_mixing, plan_mix
from tests.llm.compare import duck, same
from tests.llm.conftest import SF


def targets_by_rounds(sizes, weights=(5, 2, 1)):
    """Brute force: share, cut what is over, share that among the rest, until nothing is over."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_sources, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_sources:
        total = sum(weight[s] for s in open_sources)
        over = {s for s in open_sources if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_sources}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_sources -= over
    return target


def test_equals_sql(spark):
    assert same(op3_source_mixing(spark, SF), duck(SF), ORACLE) == 200


def test_targets_and_draws(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = plan_mix(docs).collect()
    sizes, taken, found = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += len((r.text or "").split())
        taken[r.source] += r.taken
        found[r.source] = r.target
        assert r.taken <= 2 * r.size
    want = targets_by_rounds(sizes)
    assert all(abs(found[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
    longest = max(r.size for r in rows)
    for s in want:  # near each source's own target: within five deviations of the draws, each of which moves one document's words
        moved = sum(r.size**2 for r in rows if r.source == s) * 0.25
        assert abs(taken[s] - want[s]) <= 5 * moved**0.5 + longest, s
    assert abs(sum(taken.values()) / sum(want.values()) - 1) < 0.05
    plain = sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rows)
    assert plain == sorted(map(tuple, op3_source_mixing(spark, "/root/testdata/sf0.01").collect()))
    assert mix_documents(docs).count() == sum(r.copies for r in rows) and mix_documents(docs).columns == docs.columns


def test_edges(spark):
    rows = [(1, "a b c", None), (2, None, "x"), (None, "", "x"), (3, "d e", "y"), (3, "d e", "y"), (4, "w " * 500, "z")]
    frame = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, source string, size int, target int")
    got = plan_mix(frame)
    want = targets_by_rounds({None: 3, "x": 0, "y": 4, "z": 500})
    assert all(abs(r.target - want[r.source]) < 1e-9 for r in got.collect()) and got.count() == 6
    data = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    assert same(got.select("doc_id", "size", "source_size", "target", "taken"), duck(SF, documents=data), ORACLE) == 6
    assert plan_mix(frame, keep_text=False).count() == 6 and Counter(r.copies for r in plan_mix(frame, keep_text=False).collect()) == Counter(r.copies for r in got.collect())
    assert plan_mix(frame.limit(0)).count() == 0 and mix_documents(frame).columns == frame.columns


def test_shared_identifiers_have_draws_of_their_own(spark):
    """Null and repeated identifiers, and rows alike in all, come near their source's target; a hot group of equal rows among them."""
    rows = [(None if i % 2 else i % 3, "same text of five words" if i % 3 == 0 else f"word {i} and {'more ' * (i % 7)}", ("a", "b", None)[i % 3]) for i in range(9000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    data = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    found = plan_mix(frame, keep_text=False)
    assert same(found.select("doc_id", "size", "source_size", "target", "taken"), duck(SF, documents=data), ORACLE) == 9000
    taken, target = Counter(), {}
    for r in plan_mix(frame).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] / target[s] - 1) < 0.1 for s in target) and taken["a"]
    assert mix_documents(frame).count() == plan_mix(frame.repartition(3)).selectExpr("sum(copies)").first()[0]
