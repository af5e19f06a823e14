"""Loops shuffle what a round adds, not all that they join it to."""

from corvane.operators import dataflow
from corvane.operators.lineage import cut, dealt


def plan_of(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_table_in_buckets_is_not_shuffled(spark):
    table, new = dealt(spark.range(100).selectExpr("id % 10 AS k", "id AS v"), "k"), cut(spark.range(5).selectExpr("id AS k"))
    joined = table.join(new, "k")
    assert plan_of(joined).count("Exchange hashpartitioning") == 1 and joined.count() == 50


def test_what_is_known_is_dropped_after_the_joins(spark):
    edges, known = cut(spark.range(100).selectExpr("id % 10 AS k", "id AS fact")), cut(spark.range(50).selectExpr("id AS fact"))
    fresh = dataflow._unknown(edges.join(cut(spark.range(5).selectExpr("id AS k")), "k").select("fact"), known, ["fact"])
    plan = plan_of(fresh)
    assert "LeftAnti" not in plan and sorted(r.fact for r in fresh.collect()) == [x for x in range(50, 100) if x % 10 < 5]


def test_implications_are_clauses_of_one_premise(spark):
    clauses = spark.createDataFrame([("x", "c"), ("x", "d"), ("y", "e")], "clause string, head string")
    premises = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "b"), ("y", "z")], "clause string, premise string")
    single = spark.createDataFrame([("s", "a"), ("a", "b"), ("s", "a"), ("c", "s"), ("d", "f"), (None, "g"), ("s", None)], "premise string, head string")
    facts = spark.createDataFrame([("s",)], "fact string")
    found = sorted(map(tuple, dataflow.horn_closure(clauses, premises, facts, implications=single).collect()))
    assert found == [("a", 1), ("b", 2), ("c", 3), ("d", 3), ("f", 4), ("s", 0)]


def shuffled(spark, run):
    """Rows that all stages of run() shuffled, with nothing broadcast by Spark's own choice."""
    context = spark.sparkContext._jsc.sc()

    def total():
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before, threshold = total(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    return total() - before


def test_lineage_shuffles_its_ways_once_however_many_rounds_there_are(spark):
    n = 20_000
    leaves = spark.range(n).selectExpr("concat('l', id) AS node", "concat('a', id % 10) AS parent")
    chain = spark.createDataFrame([(f"a{i}", "b0") for i in range(10)] + [(f"b{i}", f"b{i + 1}") for i in range(5)], "node string, parent string")
    parents, found = cut(leaves.unionByName(chain)), []
    uses = cut(spark.range(100).selectExpr("id AS use", "concat('l', id) AS node"))
    rows = shuffled(spark, lambda: found.extend(dataflow.dag_origins(uses, parents, spark.createDataFrame([("b5",)], "node string")).collect()))
    assert sorted(map(tuple, found)) == [(i, "b5", 7) for i in range(100)]
    assert rows < 2 * n, rows


def test_matched_calls_shuffle_their_edges_once_however_many_rounds_there_are(spark):
    n = 20_000
    moves = spark.range(n).selectExpr("concat('x', id) AS source", "concat('y', id) AS target").unionByName(spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(10)], "source string, target string"))
    moves, calls, returns = cut(moves), spark.createDataFrame([("s", "a10", "f")], "site string, actual string, formal string"), spark.createDataFrame([("s", "f", "b")], "site string, result string, output string")
    found = []
    rows = shuffled(spark, lambda: found.extend(dataflow.matched_reachability(moves, calls, returns, spark.createDataFrame([("a0",)], "node string")).collect()))
    assert sorted(map(tuple, found)) == sorted([(f"a{i}", False) for i in range(11)] + [("f", True), ("b", False)])
    assert rows < 4 * n, rows


def test_definitions_that_none_sees_are_neither_dealt_over_cells_nor_numbered(spark):
    n = 5_000
    definitions = cut(spark.range(n).selectExpr("'f' AS function", "'x' AS name", "id * 1000 AS at", "999999999L AS end", "id AS definition"))
    uses, found = cut(spark.range(1).selectExpr("'f' AS function", "'x' AS name", "100000000L AS at", "7L AS use")), []
    rows = shuffled(spark, lambda: found.extend(dataflow.reaching_definitions(definitions, uses).collect()))
    assert list(map(tuple, found)) == [(7, n - 1)]
    assert rows < 4 * n, rows
