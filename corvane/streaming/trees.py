"""A scan that follows a source tree: a stream of what changed in it, and findings that are published once a batch.

`tree_changes` is a stream whose offset is a time, so the driver holds nothing of the tree: tasks walk shares of it and give what changed
since the last offset (by the time of the last change of status, which a copy or a renaming also moves; a deletion moves its folder's). What a
batch scans is the tree as it stands, going on from the parse cache and the store of flows, so only changed files are parsed and only changed
components are walked, and files that went are gone. What it found is published under the stream's run and batch; a batch that is run again
after a crash finds that its own are there, or publishes them then.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from corvane.functions.settings import Settings
from corvane.operators.joins import compare_snapshots
from corvane.plans.report import Report, scan_report
from corvane.sources.versions import Versions

CHANGES = "path string, is_folder boolean, changed_at long"
#: Shares of the tree from which no further level is listed to find more.
SHARES = 64
#: Changes count once they are this old, so that none of the same moment comes after the offset was taken.
SETTLE_MS = 2_000


@dataclass
class Share(InputPartition):
    """A folder with all below it, or its own entries alone; changes after `since` and up to `until`, in microseconds."""

    folder: str
    below: bool
    since: int
    until: int


def _folders(folder: str) -> list[str]:
    with os.scandir(folder) as entries:
        return sorted(e.path for e in entries if e.is_dir(follow_symlinks=False) and e.name != ".git")


class ChangeReader(DataSourceStreamReader):
    def __init__(self, path: str, settle_ms: int):
        self.path, self.settle_ms = path, settle_ms

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() // 1000 - self.settle_ms * 1000}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        since, until = start["until"], end["until"]
        if until <= since:
            return []
        own, level = [], [self.path]
        while level and len(level) < SHARES:
            own += level
            level = [below for folder in level for below in _folders(folder)]
        return [Share(f, False, since, until) for f in own] + [Share(f, True, since, until) for f in level]

    def read(self, partition: Share) -> Iterator[tuple]:
        left = [partition.folder]
        while left:
            folder = left.pop()
            try:
                changed = os.stat(folder, follow_symlinks=False).st_ctime_ns // 1000
                entries = list(os.scandir(folder))
            except OSError:  # gone by now: its parent changed
                continue
            if partition.since < changed <= partition.until:
                yield os.path.relpath(folder, self.path), True, changed
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    if partition.below and entry.name != ".git":
                        left.append(entry.path)
                    continue
                try:
                    changed = entry.stat(follow_symlinks=False).st_ctime_ns // 1000
                except OSError:
                    continue
                if partition.since < changed <= partition.until:
                    yield os.path.relpath(entry.path, self.path), False, changed

    def commit(self, end: dict) -> None:
        """Nothing is kept for offsets that are done."""


class TreeChanges(DataSource):
    """readStream.format("tree_changes").option("path", ...): path, is_folder, changed_at (microseconds). Option settle_ms."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(os.path.abspath(self.options["path"]), int(self.options.get("settle_ms", SETTLE_MS)))


BATCH = "run string, batch_id long, files long, scan_id string"


class Published(Versions):
    """Findings of the last batch, and what it changed against the one before: each version takes the place of all."""

    def batch(self) -> tuple[str, int] | None:
        row = self.read(self.versions(), "batch", BATCH).select("run", "batch_id").first()
        return (row.run, row.batch_id) if row else None

    def findings(self) -> DataFrame | None:
        """Null before the first batch."""
        return self._last("findings")

    def changes(self) -> DataFrame | None:
        """state (new, changed, unchanged, resolved), fingerprint, related_key."""
        return self._last("changes")

    def _last(self, name: str) -> DataFrame | None:
        versions = self.versions()
        return self.spark.read.parquet(f"{self.folder}/{versions[-1]}/{name}") if versions else None

    def publish(self, run: str, batch_id: int, report: Report) -> None:
        prints = report.findings.select("fingerprint", "related_key")
        before = self.findings()
        changes = compare_snapshots(prints, prints.limit(0) if before is None else before.select("fingerprint", "related_key"))
        batch = self.spark.createDataFrame([(run, batch_id, report.header["files"], report.header["scan_id"])], BATCH)
        self.add({"findings": report.findings, "changes": changes, "batch": batch}, alone=True)


def follow_tree(spark: SparkSession, path: str, store: str, checkpoint: str, settings: Settings | None = None, settle_ms: int = SETTLE_MS, every: str | None = None) -> StreamingQuery:
    """Scans the tree for what changed and publishes under store/published. every: a trigger's interval; without it, what there is is taken and the query ends.

    store and checkpoint are folders outside the tree that the driver program finds again; the checkpoint's name is the stream's run.
    """
    spark.dataSource.register(TreeChanges)

    def scan(changes: DataFrame, batch_id: int) -> None:
        session = changes.sparkSession
        published = Published(session, f"{store}/published")
        if published.batch() == (checkpoint, batch_id) or changes.isEmpty():
            return
        published.publish(checkpoint, batch_id, scan_report(session, path, settings, cache=f"{store}/cache"))

    changes = spark.readStream.format("tree_changes").option("path", path).option("settle_ms", settle_ms).load().filter(F.col("path").isNotNull())
    writer = changes.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
