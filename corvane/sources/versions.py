"""Stores whose tables come in versions, in a folder that all executors see.

A version is a folder of tables. It counts from when its entry in the log is there, which is made last and never over another's: what is cut
short before leaves a folder that nobody names, and an entry that was cut short itself names none. A version may take the place of all
before it. Readers that began before that still find their folders for GRACE_SECONDS; then they go, and so do folders that were never named.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from corvane.operators.lineage import delete

#: How long a scan may read a version that another took the place of, and how long it may write one.
GRACE_SECONDS = 86_400


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _place(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        files, place = self._place(folder)
        return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []

    def _entries(self) -> list[tuple[str, dict]]:
        """(name, entry) of the log, in order; an entry that can't be read is none."""
        found = []
        for name in self._names("log"):
            files, place = self._place(f"log/{name}")
            stream = files.open(place)
            try:
                found.append((name, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))))
            except ValueError:
                continue
            finally:
                stream.close()
        return found

    def versions(self) -> list[str]:
        """Folders that count, from the last that took the place of all before it."""
        found: list[str] = []
        for _, entry in self._entries():
            found = [entry["version"]] if entry["alone"] else [*found, entry["version"]]
        return found

    def read(self, versions: list[str], name: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{v}/{name}" for v in versions]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def add(self, tables: dict[str, DataFrame], alone: bool = False) -> None:
        """Writes the tables and then makes them count; two may do so at once. alone: they take the place of all that counts by then."""
        version = f"v-{int(time.time())}-{uuid.uuid4().hex}"
        for name, frame in tables.items():
            frame.write.parquet(f"{self.folder}/{version}/{name}")
        self._log(version, alone)
        if alone:
            self.sweep()

    def _log(self, version: str, alone: bool) -> None:
        files, log = self._place("log")
        files.mkdirs(log)
        n = max((int(name) for name in self._names("log") if name.isdigit()), default=0)
        while True:
            n += 1
            _, place = self._place(f"log/{n:09d}")
            if files.exists(place):  # another was faster
                continue
            out = files.create(place, False)
            try:
                out.write(bytearray(json.dumps({"version": version, "alone": alone, "at": int(time.time())}).encode()))
            finally:
                out.close()
            return

    def sweep(self) -> None:
        """Deletes folders that nobody can need any more, and log entries that say nothing since then."""
        now, log, counting = time.time(), self._entries(), set(self.versions())
        replaced: dict[str, int] = {}
        for i, (_, entry) in enumerate(log):
            taken = next((e.get("at", 0) for _, e in log[i + 1 :] if e["alone"]), None)
            if taken is not None:
                replaced[entry["version"]] = taken
        for name in self._names(""):
            if not name.startswith("v-") or name in counting:
                continue
            since = replaced.get(name)
            if since is None:
                with contextlib.suppress(ValueError):  # never named
                    since = int(name.split("-")[1])
            if since is not None and now - since > GRACE_SECONDS:
                delete(self.spark, f"{self.folder}/{name}")
        for name, entry in log:
            if entry["version"] in replaced and now - replaced[entry["version"]] > GRACE_SECONDS:
                delete(self.spark, f"{self.folder}/log/{name}")
