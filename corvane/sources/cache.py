"""Stores between runs: records of files that were scanned before, and the history of reports.

A parse cache has versions (see sources.versions) of two tables: entries (cache_key, n_records, bytes, saved_at) and the records themselves
under their key. A file is known if it has an entry whose records are all there; what is written first goes first when the store is over its
budget. History is a JSON file a scan; a file that doesn't hold what it should is renamed, counted, and not listed.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import SCAN_ID
from corvane.operators.lineage import cut
from corvane.operators.windows import newest_within
from corvane.sources.reports import checked_document, write_atomically
from corvane.sources.tree import cache_key
from corvane.sources.versions import Versions

ENTRIES = "cache_key string, n_records long, bytes long, saved_at timestamp"


#: Versions from which the next one takes the place of all, so that many small scans don't leave many small files.
MOST_VERSIONS = 16


class ParseCache(Versions):
    def __init__(self, spark: SparkSession, folder: str, version: str, records: str):
        """records: the schema of what is stored."""
        super().__init__(spark, folder)
        self.version, self.schema = version, records

    def _records(self, versions: list[str]) -> DataFrame:
        return self.read(versions, "records", f"cache_key string, {self.schema}")

    def entries(self, versions: list[str] | None = None) -> DataFrame:
        """What is noted, a row a file; of an entry that was written twice the first."""
        noted = self.read(self.versions() if versions is None else versions, "entries", ENTRIES)
        return noted.groupBy("cache_key").agg(F.min(F.struct("saved_at", "n_records", "bytes")).alias("e")).select("cache_key", "e.*")

    def split(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(records of files that are known, files that are not). Only records of these files are read; an entry that misses some is none."""
        versions = self.versions()
        keyed = files.filter("content IS NOT NULL").withColumn("cache_key", cache_key(self.version))
        asked = keyed.select("cache_key").distinct()
        rows = self._records(versions).join(asked, "cache_key", "left_semi").dropDuplicates(["cache_key", "record_id"])
        held = rows.groupBy("cache_key").agg(F.count("*").alias("held"))
        noted = self.entries(versions).join(asked, "cache_key", "left_semi")
        known = noted.join(held, "cache_key", "left").filter(F.coalesce("held", F.lit(0)) == F.col("n_records")).select("cache_key")
        owners = keyed.select("cache_key", F.col("repository").alias("__repository")).join(known, "cache_key", "left_semi").distinct()
        names = [f.name for f in rows.schema if f.name != "cache_key"]
        return rows.join(owners, "cache_key").withColumn("repository", F.col("__repository")).select(*names), keyed.join(known, "cache_key", "left_anti")

    def store(self, files: DataFrame, records: DataFrame) -> None:
        """The records of files that were scanned; files without any have an entry too. Both count at once, or neither."""
        keyed = files.select("repository", "path", "size_bytes", cache_key(self.version).alias("cache_key"))
        before = self.versions()
        own = records.join(keyed.select("repository", "path", "cache_key"), ["repository", "path"]).select("cache_key", *[f.name for f in self._records([]).schema if f.name != "cache_key"])
        counts = own.groupBy("cache_key").agg(F.countDistinct("record_id").alias("n_records"))
        entries = keyed.select("cache_key", "size_bytes").distinct().join(counts, "cache_key", "left").select("cache_key", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.col("size_bytes").alias("bytes"), F.current_timestamp().alias("saved_at"))
        alone = len(before) >= MOST_VERSIONS
        if alone:
            old = self.entries(before).join(entries.select("cache_key"), "cache_key", "left_anti")
            own = own.unionByName(self._records(before).join(old.select("cache_key"), "cache_key", "left_semi"))
            entries = entries.unionByName(old)
        self.add({"records": own, "entries": entries}, alone)

    def evict(self, budget: int) -> DataFrame:
        """The entries that stay within the budget, the newest ones, in a version that takes the place of all; the others and their records are left out of it.

        What another scan stores meanwhile may be left out too; it is then scanned once more.
        """
        before = self.versions()
        kept = cut(newest_within(self.entries(before), [-F.unix_micros("saved_at"), F.col("cache_key")], "bytes", budget))
        self.add({"records": self._records(before).join(kept.select("cache_key"), "cache_key", "left_semi"), "entries": kept}, alone=True)
        return self.entries()


class History:
    """Summaries of scans in a folder, one file each."""

    def __init__(self, folder: str):
        self.folder = folder

    def save(self, scan_id: str, saved_at: str, repository: str, body: dict) -> str:
        if not re.match(SCAN_ID, scan_id):
            raise ValueError(f"not a scan's identifier: {scan_id!r}")
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f"{scan_id}.json")
        write_atomically(path, json.dumps({"scan_id": scan_id, "saved_at": saved_at, "repository": repository, "body": body}, sort_keys=True))
        return path

    def listing(self) -> tuple[list[dict], int]:
        """(scans, the newest first; how many files were no scans, now renamed)."""
        found, corrupt = [], 0
        for name in sorted(os.listdir(self.folder)) if os.path.isdir(self.folder) else []:
            if not name.endswith(".json"):
                continue
            path = os.path.join(self.folder, name)
            try:
                scan = checked_document(path)
                if not re.match(SCAN_ID, scan["scan_id"]) or f"{scan['scan_id']}.json" != name or not all(isinstance(scan[k], str) for k in ("saved_at", "repository")):
                    raise ValueError
                found.append(scan)
            except (ValueError, KeyError, TypeError, OSError):
                os.replace(path, f"{path}.corrupt")
                corrupt += 1
        return sorted(found, key=lambda s: (s["saved_at"], s["scan_id"]), reverse=True), corrupt

    def show(self, scan_id: str) -> dict:
        return next(s for s in self.listing()[0] if s["scan_id"] == scan_id)

    def delete(self, scan_id: str) -> bool:
        path = os.path.join(self.folder, f"{scan_id}.json")
        if not re.match(SCAN_ID, scan_id) or not os.path.isfile(path):
            return False
        os.unlink(path)
        return True

    def keep(self, newest: int) -> int:
        """Deletes all but the newest; how many went."""
        old = self.listing()[0][newest:]
        for scan in old:
            self.delete(scan["scan_id"])
        return len(old)
