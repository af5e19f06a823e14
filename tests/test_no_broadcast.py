"""Tables of loops are small in files and large in memory: their joins are dealt out, whatever size their files have."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import dataflow
from corvane.operators.lineage import cut
from corvane.plans.fixpoint import EXAMPLE, RECORDS, resolve
from corvane.plans.flows import reached_sinks


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_table_of_repeated_names_is_not_broadcast(spark):
    names = spark.range(50_000).select(F.lit("a long name that takes a few bytes in a file").alias("name"), (F.col("id") % 7).alias("at"))
    one, other = cut(names), cut(names.select("name", "at").distinct())
    assert "Broadcast" not in plan_of(one.join(other, ["name", "at"]))
    assert "Broadcast" not in plan_of(one.groupBy("name").count().join(other, "name", "left_anti"))
    assert "BroadcastHashJoin" in plan_of(one.join(F.broadcast(other), "name"))  # where one says so


@pytest.mark.parametrize("members", [False, True])
def test_reaching_definitions_broadcasts_nothing(spark, members):
    definitions = spark.createDataFrame([("f", "a", 1, 9, 1), ("f", "a.b", 2, None, 2)], "function string, name string, at long, end long, definition long")
    uses = spark.createDataFrame([("f", "a.b", 5, 7)], "function string, name string, at long, use long")
    found = dataflow.reaching_definitions(definitions, uses, members)
    assert "Broadcast" not in plan_of(found)
    assert sorted(map(tuple, found.collect())) == [(7, 1), (7, 2)]


def test_sinks_of_records_broadcast_only_the_rules(spark):
    found = reached_sinks(spark.createDataFrame(EXAMPLE, RECORDS))
    assert plan_of(found).count("BroadcastHashJoin") == 1


def test_what_imports_name_is_not_broadcast(spark):
    """A row an import: adaptive execution would broadcast it for what it takes in a shuffle."""
    found = resolve(cut(spark.createDataFrame(EXAMPLE, RECORDS)))
    found.collect()
    assert "BroadcastExchange" not in plan_of(found).split("== Initial Plan ==")[0]
    assert found.filter("target IS NOT NULL").count() > 0


def test_a_round_of_many_rows_is_not_broadcast(spark):
    """As a hash table, a hundred thousand rows of names are some twenty megabytes on the driver, twice a round."""
    delta = cut(spark.range(20_000).selectExpr("concat('a name of a node of a program ', id) AS node"))
    assert "BroadcastHashJoin" not in plan_of(cut(spark.range(10).selectExpr("'x' AS node")).join(dataflow._side(delta, 20_000), "node"))
