import random
import re
from collections import defaultdict

import numpy as np

from corvane.llm.near_duplicates import ORACLE, SKETCH, near_duplicates, op6_near_duplicates, similarity_sketch
from tests.llm.compare import duck


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} - {()} if len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_force(rows, width=4, percent=80):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    first = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:  # rows of one identifier are one document
            parent[top(i)] = top(first.setdefault(doc, i))
    index = defaultdict(list)
    for i, s in enumerate(sets):
        seen = set()
        for x in s:
            for j in index[x]:
                if j not in seen:
                    seen.add(j)
                    if rows[i][0] is not None and rows[j][0] is not None and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                        parent[top(i)] = top(j)
            index[x].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(top(i)) if doc is not None else None, doc is None or least[top(i)] == doc) for i, (doc, _) in enumerate(rows)), key=str)


def run(spark, rows, **how):
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, kept int")
    return sorted(map(tuple, near_duplicates(frame, **how).collect()), key=str)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 160, 5000):
        values = rng.integers(0, 2**63, n).astype(np.uint64)
        assert similarity_sketch(values).max() < np.iinfo(np.uint64).max
    errors = []
    for _ in range(60):
        common, a, b = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (160, 20, 20))
        same = similarity_sketch(np.concatenate([common, a])) == similarity_sketch(np.concatenate([common, b]))
        errors.append(same.mean() - 0.8)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 1.5 * np.sqrt(0.16 / SKETCH)


def test_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, op6_near_duplicates(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == brute_force(rows)
    assert len({r[2] for r in got}) < len(got)
    assert sorted(map(tuple, duck("/root/testdata/sf0.01").sql(ORACLE).fetchall()), key=str) == got


def test_chains_groups_and_edges(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    rows, doc = [], 0
    for _ in range(60):  # a chain: each differs a little from the one before
        base = list(base)
        base[rng.randrange(120)] = rng.choice(words)
        rows.append((doc := doc + 1, " ".join(base)))
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows += [(doc := doc + 1, f"{passage} {' '.join(rng.choice(words) for _ in range(rng.randint(3, 30)))}") for _ in range(80)]
    rows += [(doc := doc + 1, "Same Text\tHERE"), (doc := doc + 1, "same text here"), (doc := doc + 1, "same text"), (doc := doc + 1, None), (doc := doc + 1, " \n"), (None, "same text here"), (doc := doc + 1, "ÉA b c d"), (doc := doc + 1, "éA b c d")]
    rng.shuffle(rows)
    assert run(spark, rows) == brute_force(rows)
    assert run(spark, rows, width=5) == brute_force(rows, 5)
    assert run(spark, [*rows[:5], rows[0]]) == brute_force([*rows[:5], rows[0]])
    assert run(spark, []) == []


def test_repeated_identifiers_with_other_texts(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(rng.choice("abcdefghijklmnop") * 2 + str(rng.randrange(900)) for _ in range(60)) for _ in range(3))
    assert run(spark, [(7, a), (7, b), (8, b + " more")]) == brute_force([(7, a), (7, b), (8, b + " more")])
    rows = [(3, a), (7, a), (7, b), (9, b + " more"), (11, c), (7, None), (12, c + " x"), (None, a), (11, "short one"), (20, "short one"), (5, ""), (5, " ")]
    got = run(spark, rows)
    assert got == brute_force(rows)
    assert {r[0]: r[2] for r in got if r[0]} == {3: 3, 7: 3, 9: 3, 11: 11, 12: 11, 20: 11, 5: 5}
    rng.shuffle(rows)
    assert run(spark, rows) == brute_force(rows)
    strings = spark.createDataFrame([(f"d:{i}", t) for i, t in rows if i], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(strings).collect()}["d:9"] == "d:3"


def test_very_long_texts_and_a_hub_of_many_blocks(spark):
    rng = random.Random(5)
    long = [f"w{rng.randrange(50_000)}" for _ in range(120_000)]
    other = [w if rng.random() > 0.02 else "changed" for w in long]
    base = [f"v{i}" for i in range(80)]
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[:60_000]))]
    for i in range(1300):  # each differs from the first by a word of its own
        rows.append((10 + i, " ".join([*base[: 1 + i % 79], f"own{i}", *base[2 + i % 79 :]])))
    rows.append((9, " ".join(base)))
    got = {r[0]: r[2] for r in run(spark, rows)}
    assert got[1] == got[2] == 1 and got[3] == 3
    assert {got[10 + i] for i in range(1300)} == {9}
