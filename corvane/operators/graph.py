"""Evidence graphs as two tables, and bounded walks over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import digest
from corvane.operators.lineage import cut


def nodes_of(rows: DataFrame, kind: str, key: str) -> DataFrame:
    return rows.select(digest(F.lit(kind), F.col(key), prefix="gn_").alias("node_id"), F.lit(kind).alias("kind"), F.col(key).cast("string").alias("name"))


def edges_of(rows: DataFrame, kind: str, source: tuple[str, str], target: tuple[str, str]) -> DataFrame:
    """source, target: (node kind, key column)."""
    start, end = digest(F.lit(source[0]), F.col(source[1]), prefix="gn_"), digest(F.lit(target[0]), F.col(target[1]), prefix="gn_")
    named = rows.select(start.alias("from_node"), end.alias("to_node"))
    return named.select(digest(F.lit(kind), F.col("from_node"), F.col("to_node"), prefix="ge_").alias("edge_id"), F.lit(kind).alias("kind"), "from_node", "to_node")


def union_distinct(frames: list[DataFrame], key: str) -> DataFrame:
    every = frames[0]
    for more in frames[1:]:
        every = every.unionByName(more)
    return every.dropDuplicates([key])


def bounded_paths(edges: DataFrame, starts: DataFrame, rounds: int, keep_path: bool = True) -> DataFrame:
    """edges (source, target), starts (node) -> (node, depth, path): the fewest rounds that reach a node, and of those paths the least.

    Frontier by frontier: each round joins only what was reached last, drops what is known, and keeps one row a node, so its size is
    bounded by the nodes and never by the walks. Edges are written down once; each round reads them and nothing that made them.
    """
    edges, kind = cut(edges.select("source", "target")), starts.schema["node"].dataType
    first = F.array(F.col("node")) if keep_path else F.array().cast(T.ArrayType(kind))
    reached = starts.select("node").distinct().select("node", F.lit(0).alias("depth"), first.alias("path"))
    frontier = reached
    for depth in range(1, rounds + 1):
        step = frontier.join(edges, frontier.node == edges.source).select(F.col("target").alias("node"), (F.concat("path", F.array("target")) if keep_path else F.col("path")).alias("path"))
        least = step.groupBy("node").agg(F.min("path").alias("path")).join(reached.select("node"), "node", "left_anti")
        frontier = cut(least.select("node", F.lit(depth).alias("depth"), "path"))
        reached = reached.unionByName(frontier)
        if frontier.isEmpty():
            break
    return reached


def unguarded(edges: DataFrame, guards: DataFrame) -> DataFrame:
    """Edges (source, target, key) that no guard (key) covers."""
    return edges.join(guards.select("key").distinct(), "key", "left_anti")


def best_candidates(candidates: DataFrame, by: list[str], order: list) -> DataFrame:
    """One candidate a group: the first in the order. A partial minimum on a struct, not a sort."""
    fields = [c for c in candidates.columns if c not in by]
    ranked = F.struct(*[c.alias(f"__o{i}") for i, c in enumerate(order)], *fields)
    return candidates.groupBy(*by).agg(F.min(ranked).alias("__best")).select(*by, *[F.col(f"__best.{f}").alias(f) for f in fields])


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """edges (a, b) -> (node, component): least labels of neighbours, then the label's own label twice, until a round changes nothing.

    Rounds grow with the logarithm of the longest path. Whether one changed anything is counted while its labels are written.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("was"), F.least("component", "near").alias("label"))
        further = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        once = lower.join(further, "label").select("node", "was", F.least("label", "further").alias("label"))
        twice = once.join(further, "label").select("node", "was", F.least("label", "further").alias("component"))
        changed = Observation()
        labels = cut(twice.observe(changed, F.count_if(F.col("component") != F.col("was")).alias("rows")).select("node", "component"))
        if not changed.get["rows"]:
            return labels
    raise RuntimeError("components did not settle")


def empty_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "source string, target string")
