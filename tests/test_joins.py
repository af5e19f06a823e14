import random

import pytest
from pyspark.sql import functions as F

from corvane.functions.text import byte_offset, redacted
from corvane.operators import joins, windows


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_nulls_match_nothing_and_rows_stay(spark):
    points = spark.createDataFrame([("a", 5, None), ("a", 5, None), ("a", 50, "x"), (None, 5, "y"), ("b", None, "z")], "k string, at long, note string")
    spans = spark.createDataFrame([("a", 0, 10, "wide"), ("a", 4, 6, "small"), (None, 0, 10, "none"), ("a", None, 9, "bad"), ("a", 7, 3, "turned")], "k string, lo long, hi long, name string")
    assert rows(joins.innermost(points, spans, "k", "at", "lo", "hi", "name")) == sorted([("a", 5, None, "small"), ("a", 5, None, "small"), ("a", 50, "x", None), (None, 5, "y", None), ("b", None, "z", None)], key=str)
    assert rows(joins.dominated(points, spans, "k", "at", "lo", "hi")) == [("a", 5, None), ("a", 5, None)]
    assert joins.dominated(points, spans, "k", "at", "lo", "hi", "left_anti").count() == 3
    known = spark.createDataFrame([("h/a",), ("h",), (None,)], "prefix string")
    pages = spark.createDataFrame([("h/a/b", None), ("h/a/b", None), (None, 1), ("h", 2), ("x", 3)], "url string, n int")
    assert rows(joins.longest_prefix(pages, known, "url", "prefix")) == sorted([("h/a/b", None, "h/a"), ("h/a/b", None, "h/a"), (None, 1, None), ("h", 2, "h"), ("x", 3, None)], key=str)
    left = spark.createDataFrame([(None, 5, 1), ("a", 5, 2), ("a", 1, 3)], "k string, at long, id int")
    right = spark.createDataFrame([(None, 1, "n"), ("a", 2, "v"), ("a", 5, "w")], "k string, at long, value string")
    for hot in (False, True):
        assert rows(joins.as_of(left, right, "k", "at", ["value"], hot=hot)) == sorted([(None, 5, 1, None), ("a", 5, 2, "v"), ("a", 1, 3, None)], key=str)
        assert rows(joins.as_of(left, right, "k", "at", ["value"], strict=False, hot=hot).filter("id = 2")) == [("a", 5, 2, "w")]


def test_spans_of_all_sizes_against_brute_force(spark):
    rng = random.Random(2)
    points = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(-500, 5000)) for _ in range(600)]
    spans = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", a := rng.randrange(-500, 5000), a + int(2 ** rng.uniform(0, 12)) - 1, i) for i in range(150)]
    p, s = spark.createDataFrame(points, "k string, at long"), spark.createDataFrame(spans, "k string, lo long, hi long, id long")
    want = sorted((k, at, i) for k, at in points for x, lo, hi, i in spans if k == x and lo <= at <= hi)
    assert sorted(map(tuple, joins.in_spans(p, s, "k", "at", "lo", "hi").select("k", "at", "id").collect())) == want
    inner = {(k, at): min(((hi - lo, lo, i) for x, lo, hi, i in spans if k == x and lo <= at <= hi), default=(0, 0, None))[2] for k, at in points}
    assert rows(joins.innermost(p, s, "k", "at", "lo", "hi", "id")) == sorted(((k, at, inner[k, at]) for k, at in points), key=str)
    between = sorted(i for k, lo, hi, i in spans if any(k == x and lo < at < hi for x, at in points))
    assert sorted(r.id for r in joins.redefined_between(s, p, "k", "lo", "hi", "at").collect()) == between


def test_redefinition_by_name(spark):
    ranges = spark.createDataFrame([("f", 0, 100, "a"), ("f", 0, 100, "b.c"), ("f", 0, 100, "d"), ("f", 0, 100, "e"), ("f", 0, 100, "g")], "f string, lo long, hi long, value string")
    made = spark.createDataFrame([("f", 5, "a.x", None), ("f", 6, "b", None), ("f", 7, "dd", None), ("f", 8, None, "e"), ("f", 100, "g", None)], "f string, at long, output string, receiver string")
    assert sorted(r.value for r in joins.redefined_between(ranges, made, "f", "lo", "hi", "at", "value", "output", "receiver").collect()) == ["a", "b.c", "e"]


@pytest.mark.parametrize("partitions", [1, 7])
def test_slices_see_the_whole_order(spark, partitions):
    rng = random.Random(3)
    events = [(rng.choice(["hot", "hot", "hot", "x", None]), i, rng.randrange(9)) for i in range(900)]
    rng.shuffle(events)
    frame = spark.createDataFrame(events, "k string, at long, v long").repartition(partitions)
    ordered = sorted(events, key=lambda e: e[1])
    total, want = 0, []
    for k, at, v in ordered:
        total += v
        want.append((at, total))
    assert sorted((r["at"], r.t) for r in windows.running_total(frame, ["at"], F.col("v"), "t").collect()) == want
    before = {at: ordered[i - 1][2] if i else None for i, (_, at, _) in enumerate(ordered)}
    assert {r["at"]: r.previous_v for r in windows.previous_in_order(frame, ["at"], ["v"]).collect()} == before
    kept = [e for i, e in enumerate(ordered) if not i or e[2] != ordered[i - 1][2] and (e[0] is None or e[0] != ordered[i - 1][0])]  # either key drops a row
    assert sorted(r["at"] for r in windows.adjacent_distinct(frame, ["at"], ["k", "v"]).collect()) == [e[1] for e in kept]
    right = frame.filter("v > 6").select("k", "at", F.col("at").alias("last"))
    plain, hot = (sorted(map(str, joins.as_of(frame, right, "k", "at", ["last"], hot=h).collect())) for h in (False, True))
    assert plain == hot
    assert windows.out_of_order(frame.withColumn("w", F.col("at") * 2), ["at"], "w").count() == 0
    assert windows.out_of_order(frame, ["at"], "v").count() == sum(b[2] <= a[2] for a, b in zip(ordered, ordered[1:], strict=False))


def test_offsets_and_redaction(spark):
    frame = spark.createDataFrame([("é the cat", "cat"), ("none", "x"), (None, "x")], "text string, needle string")
    assert [r[0] for r in frame.select(byte_offset(F.col("text"), F.col("needle"))).collect()] == [7, None, None]
    assert [r[0] for r in frame.select(byte_offset(F.col("text"), "cat")).collect()] == [7, None, None]
    texts = ["plain  words\n here", "Bearer abc next", "a password=1 [REDACTED] [REDACTED] x@y.zz", "x[REDACTED]", "", "  "]
    got = [tuple(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(redacted(F.col("t"))).collect()]
    assert got == [("plain words here", 0), ("Bearer [REDACTED] next", 1), ("a [REDACTED] [REDACTED] [REDACTED] [REDACTED]", 4), ("x[REDACTED]", 0), ("", 0), ("", 0)]


def test_cut_lists_say_so(spark):
    frame = spark.createDataFrame([(f"p{i}", "e") for i in range(5)], "path string, code string")
    found = [tuple(r) for r in windows.with_limit(frame, ["path"], 3, {"code": "error-limit-reached"}).orderBy(F.col("path").asc_nulls_last()).collect()]
    assert found == [("p0", "e"), ("p1", "e"), (None, "error-limit-reached")]
    assert windows.with_limit(frame, ["path"], 5, {"code": "x"}).filter("code = 'x'").count() == 0


def test_hot_entities_by_slices(spark):
    from corvane.operators.taint import tainted_at_sinks

    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 8 + ["x", None]), rng.randrange(2000), i, rng.choice(["begin", "end", "clean", "sink"])) for i in range(1500)]
    frame, kind = spark.createDataFrame(rows, "who string, at long, id long, kind string").repartition(5), F.col("kind")
    plain, hot = (sorted(map(str, tainted_at_sinks(frame, "who", ["at", "id"], kind == "begin", kind == "end", kind == "clean", kind == "sink", hot=h).collect())) for h in (False, True))
    assert plain == hot and plain
