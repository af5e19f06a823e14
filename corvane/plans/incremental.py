"""Scans that go on where the last one ended: components whose records are as before keep what the walk found in them.

What the walk finds in a component depends on the component's records with their calls' targets, the depth and the version alone. So a digest
of these is the key of its candidates, and a scan walks only components without a known key: those with a file that changed, came or went,
and those whose calls name something else by now because of a file elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.lineage import cut
from corvane.plans.fixpoint import CANDIDATES, components, walked
from corvane.sources.versions import Versions

#: Published versions from which a publication joins all of them into one.
MOST_VERSIONS = 16
KEYS = "key string"


class FlowStore(Versions):
    """Candidates by key. A version has two tables, keys (components that were walked, those without candidates too) and rows.

    Every MOST_VERSIONS versions one takes the place of all; it holds the keys in use.
    """

    def keys(self, versions: list[str] | None = None) -> DataFrame:
        return self.read(self.versions() if versions is None else versions, "keys", KEYS)

    def rows(self, versions: list[str] | None = None) -> DataFrame:
        return self.read(self.versions() if versions is None else versions, "rows", f"key string, {CANDIDATES}")

    def publish(self, keys: DataFrame, rows: DataFrame, in_use: DataFrame) -> None:
        """Adds what was walked; two scans may publish at once, also the same keys."""
        before = self.versions()
        alone = len(before) >= MOST_VERSIONS
        if alone:
            old = self.keys(before).join(in_use, "key", "left_semi").join(keys, "key", "left_anti").distinct()
            rows = rows.unionByName(self.rows(before).join(old, "key", "left_semi").distinct())
            keys = keys.unionByName(old)
        self.add({"rows": rows, "keys": keys}, alone)


def component_keys(grouped: DataFrame, depth: int, version: str) -> DataFrame:
    """component -> key: a digest of its rows in any order, sums of the parts of each row's SHA-256, with depth and version."""
    row = F.sha2(F.to_json(F.struct(*sorted(c for c in grouped.columns if c != "component")), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring("__row", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = grouped.select("component", row.alias("__row")).groupBy("component").agg(F.count("*").alias("n"), *[F.sum(p).alias(f"p{i}") for i, p in enumerate(parts)])
    return sums.select("component", F.sha2(F.concat_ws(":", F.lit(version), F.lit(depth), "n", *[f"p{i}" for i in range(4)]), 256).alias("key"))


def candidates_since(records: DataFrame, store: FlowStore, depth: int, version: str) -> tuple[DataFrame, int]:
    """(candidates as the whole walk gives them, how many components were walked)."""
    grouped = cut(components(records))
    marks = cut(component_keys(grouped, depth, version))
    versions = store.versions()
    fresh = cut(marks.join(store.keys(versions).distinct(), "key", "left_anti"))
    known = cut(store.rows(versions).join(marks.select("key").distinct(), "key", "left_semi").distinct())  # before a publication takes its place
    n = fresh.count()
    if not n:
        return known.drop("key"), 0
    new = cut(walked(grouped.join(fresh.select("component"), "component", "left_semi"), depth).join(fresh, "component"))
    store.publish(fresh.select("key").distinct(), new.select(*known.columns), marks.select("key").distinct())
    return known.unionByName(new.select(*known.columns)).drop("key"), n
