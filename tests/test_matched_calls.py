"""Matched calls and returns: what rounds shuffle and sort, and that all ways to join a round's table find the same."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import dataflow
from corvane.operators.lineage import cut, dealt
from tests.test_dataflow import plain_reach, program
from tests.test_rounds import plan_of, shuffled


def frames(spark, moves, calls, returns, seeds):
    return (
        spark.createDataFrame(sorted(moves), "source string, target string"), spark.createDataFrame(sorted(calls), "site string, actual string, formal string"),
        spark.createDataFrame(sorted(returns), "site string, result string, output string"), spark.createDataFrame([(s,) for s in seeds], "node string"),
    )


def test_rounds_shuffle_no_summaries(spark):
    """A function of many sites, called early on, and another whose value goes a long way: each round shuffled all summaries there were."""
    n, steps = 5_000, 8
    moves = spark.createDataFrame([("g", "gr"), *[(f"m{i}", f"m{i + 1}") for i in range(steps)]], "source string, target string")
    calls = cut(spark.range(n).selectExpr("concat('s', id) AS site", "concat('a', id) AS actual", "'g' AS formal").unionByName(spark.createDataFrame([("t", "z", "m0")], "site string, actual string, formal string")))
    returns = cut(spark.range(n).selectExpr("concat('s', id) AS site", "'gr' AS result", "concat('b', id) AS output").unionByName(spark.createDataFrame([("t", f"m{steps}", "zz")], "site string, result string, output string")))
    found = []
    rows = shuffled(spark, lambda: found.extend(dataflow.matched_reachability(moves, calls, returns, spark.createDataFrame([("a7",), ("z",)], "node string")).collect()))
    assert {r.node: r.entered for r in found} == {"a7": False, "b7": False, "z": False, "zz": False, "g": True, "gr": True} | {f"m{i}": True for i in range(steps + 1)}
    assert rows < 10 * n, rows


def test_tables_in_buckets_are_not_sorted_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(dataflow, "FEW", -1)
    table, new = dealt(spark.range(100).selectExpr("id % 10 AS k", "id AS v"), "k", sorts=False), cut(spark.range(5).selectExpr("id AS k"))
    plan = plan_of(table.join(dataflow._beside(new, 5), "k"))
    assert "ShuffledHashJoin" in plan and "Sort " not in plan and plan.count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(dataflow, "HASHED", 0)
    assert "SortMergeJoin" in plan_of(table.join(dataflow._beside(new, 5), "k"))


@pytest.mark.parametrize("hashed", [0, 2_000_000])
def test_rounds_of_many_rows_find_what_rounds_of_few_find(spark, monkeypatch, hashed):
    monkeypatch.setattr(dataflow, "FEW", -1)
    monkeypatch.setattr(dataflow, "HASHED", hashed)
    moves, calls, returns, seeds = program(random.Random(3), 4, 4)
    given = frames(spark, moves, calls, returns, seeds)
    got = dataflow.matched_reachability(*[f.unionByName(f) for f in given])  # and rows that are there twice
    assert sorted((r.node, r.entered) for r in got.collect()) == sorted(plain_reach(moves, calls, returns, seeds).items())


def test_a_null_is_there_once(spark):
    moves, calls, returns, _ = frames(spark, [("a", "b")], [("s", "b", "f")], [("s", "f", "c")], [])
    moves = moves.unionByName(spark.createDataFrame([("b", None), ("c", None), ("f", None)], "source string, target string"))
    got = dataflow.matched_reachability(moves, calls, returns, spark.createDataFrame([("a",), (None,)], "node string"))
    assert sorted(((r.node or "", r.entered) for r in got.collect())) == [("", False), ("a", False), ("b", False), ("c", False), ("f", True)]
