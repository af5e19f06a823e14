"""Keys too large for a task are found by their counts; results are those of one sort a key."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import joins, windows
from corvane.operators.taint import tainted_at_sinks


def shown(frame):
    return sorted(map(str, frame.collect()))


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(windows, "TASK_ROWS", 100)


def made(spark, n=900, seed=11):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 6 + ["x", "y", None, None, None]), rng.randrange(10_000) * 1000 + i, rng.randrange(9), rng.choice(["begin", "end", "clean", "sink"])) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, at long, v long, kind string").repartition(5)


def test_measured_keys_give_what_one_sort_gives(spark, few):
    rows = made(spark)
    assert rows.filter("k = 'hot'").count() > 100 and rows.filter("k IS NULL").count() > 100  # null is a large key too
    kind, right = F.col("kind"), rows.filter("v > 6").select("k", "at", F.col("at").alias("last"))
    asked = {
        "edges": lambda hot: windows.previous_edges(rows, "k", ["at"], "v", hot),
        "segments": lambda hot: windows.segments(rows, "k", "at", F.col("v") > 5, hot=hot),
        "definitions": lambda hot: windows.definitions_before(rows.filter("v < 3"), rows.filter("v > 2"), ["k"], "at", hot=hot),
        "positional": lambda hot: joins.positional(rows.filter("v < 3"), rows.filter("v > 6"), "k", "at", hot),
        "as_of": lambda hot: joins.as_of(rows, right, "k", "at", ["last"], hot=hot),
        "carried": lambda hot: windows.carried_forward(rows, "k", ["at"], {"before": F.when(F.col("v") > 4, F.col("v"))}, hot),
        "sinks": lambda hot: tainted_at_sinks(rows, "k", ["at"], kind == "begin", kind == "end", kind == "clean", kind == "sink", hot),
    }
    for name, ask in asked.items():
        one, measured, all_cut = (shown(ask(hot)) for hot in (False, None, True))
        assert one == measured == all_cut and one, name
        assert ask(False).columns == ask(None).columns and ask(False).schema.simpleString() == ask(None).schema.simpleString(), name


def test_small_keys_are_one_window(spark):
    plan = windows.segments(made(spark, 50), "k", "at", F.col("v") > 5)._jdf.queryExecution().toString()
    assert "__slice" not in plan
    empty = spark.createDataFrame([], "k string, at long, v long")
    for hot in (None, True, False):
        assert windows.segments(empty, "k", "at", F.col("v") > 1, hot=hot).count() == 0


def test_slices_are_ranges_of_the_order_that_all_readers_share(spark):
    rows = made(spark).withColumn("name", F.when(F.col("v") > 0, F.concat("k", F.col("v"))))
    cut_up = windows.sliced(rows, ["name", "at"])
    found = [(r["name"] is not None, r["name"] or "", r["at"], r["__slice"]) for r in cut_up.collect()]
    numbers = [n for *_, n in sorted(found)]
    assert numbers == sorted(numbers) and 1 < len(set(numbers)) <= windows.SLICES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert shown(cut_up) == shown(cut_up)
    assert windows.sliced(rows.filter("at < 0"), ["at"]).count() == 0


def by_walk(ranges, made_at):
    """A definition that lies within, of the value, a member, an owner, or a call on it."""
    def related(d, v):
        return d is not None and (d == v or any(x.startswith(y + s) for x, y in ((d, v), (v, d)) for s in ".["))

    return sorted(i for i, k, lo, hi, v in ranges if None not in (k, lo, hi, v) and any(k == x and at is not None and lo < at < hi and (related(o, v) or r == v) for x, at, o, r in made_at))


def test_redefinitions_by_first_after_the_start(spark, few):
    rng = random.Random(4)
    names = ["a", "b", "a.b", "a[0]", "a.b.c", "a.b[1].c", "ab", "b.a", ".a", "", None]
    keys = ["hot"] * 6 + ["x", None]
    ranges = [(i, rng.choice(keys), lo := rng.choice([None, *range(400)]), None if lo is None else lo + rng.randrange(-2, 30), rng.choice(names)) for i in range(300)]
    places = [(rng.choice(keys), rng.choice([None, *range(430)]), rng.choice(names), rng.choice(names)) for _ in range(250)]
    r = spark.createDataFrame(ranges, "id long, k string, lo long, hi long, v string")
    d = spark.createDataFrame(places, "k string, at long, o string, r string")
    for hot in (None, False):
        got = joins.redefined_between(r, d, "k", "lo", "hi", "at", "v", "o", "r", hot)
        assert sorted(x.id for x in got.collect()) == by_walk(ranges, places)
        bare = sorted(i for i, k, lo, hi, _ in ranges if None not in (k, lo, hi) and any(k == x and at is not None and lo < at < hi for x, at, *_ in places))
        assert sorted(x.id for x in joins.redefined_between(r, d, "k", "lo", "hi", "at", hot=hot).collect()) == bare
    only = sorted(x.id for x in joins.redefined_between(r, d, "k", "lo", "hi", "at", "v", receiver="r").collect())
    assert only == by_walk(ranges, [(k, at, None, c) for k, at, _, c in places])
