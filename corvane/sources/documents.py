"""The writer side: `documents`, a data source that writes ordered rows of text as one document, or as a folder of documents.

Options: path (on the driver, or a place that pyarrow opens; of parts, a folder that all executors see too); head and tail (what stands before and after the rows); staging (a folder that
the driver and all executors see, any that pyarrow opens); parts ("true": a folder of documents of their own, and MANIFEST that names them).

Each task writes its rows under a name of its own attempt; the commit takes the files of those attempts alone, in the order of partitions,
so tasks that were tried twice or lost leave nothing behind. One document is their bytes behind one another, copied in blocks, under a passing
name that is moved when all is there. Parts are written by their tasks where they stay, and the commit only names them: the manifest is
written last, and a part that it doesn't name goes then. An abort deletes what was written. No rows at all are a document with an empty list; null rows are left out.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST = "manifest.json"
COPY_BYTES = 8 << 20
PART = re.compile(r"^[0-9a-f]{32}-(?:\d+-\d+|empty)\.json$")


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it; a path without a scheme is a local one."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    rows: int


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.head, self.tail = options["path"], options.get("head", ""), options.get("tail", "")
        self.parts = options.get("parts", "false").lower() == "true"
        self.stamp = uuid.uuid4().hex
        self.folder = self.path if self.parts else f"{options['staging'].rstrip('/')}/document-{self.stamp}"

    def write(self, iterator: Iterator) -> Part:
        task = TaskContext.get()
        name, rows = f"{self.stamp}-{task.partitionId():06d}-{task.taskAttemptId()}.json", 0
        files, folder = place_of(self.folder)
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(posixpath.join(folder, name), buffer_size=1 << 20) as out:
            if self.parts:
                out.write(self.head.encode())
            for (text,) in iterator:
                if text is not None:
                    out.write(b"\n" + text.encode() if rows == 0 else b",\n" + text.encode())
                    rows += 1
            if self.parts:
                out.write(self.tail.encode())
        return Part(task.partitionId(), name, rows)

    def commit(self, messages: list) -> None:
        written = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        if self.parts:
            self._name(written)
            return
        try:
            self._document(written, self.path)
        finally:
            self.abort(messages)

    def abort(self, messages: list) -> None:
        files, folder = place_of(self.folder)
        if files.get_file_info(folder).type == fs.FileType.NotFound:
            return
        if self.parts:
            self._delete(lambda name: name.startswith(self.stamp))
        else:
            files.delete_dir(folder)

    def _delete(self, goes) -> None:
        files, folder = place_of(self.folder)
        for info in files.get_file_info(fs.FileSelector(folder)):
            if info.type == fs.FileType.File and goes(info.base_name):
                files.delete_file(info.path)

    def _document(self, written: list[Part], path: str) -> None:
        files, target = place_of(path)
        shared, folder = place_of(self.folder)
        passing = posixpath.join(posixpath.dirname(target), f".writing-{uuid.uuid4().hex}")
        try:
            with files.open_output_stream(passing) as out:
                out.write(self.head.encode())
                for i, part in enumerate(written):
                    if i:
                        out.write(b",")
                    with shared.open_input_stream(posixpath.join(folder, part.name)) as source:
                        while block := source.read(COPY_BYTES):
                            out.write(block)
                out.write(self.tail.encode())
            if isinstance(files, fs.LocalFileSystem):
                with open(passing, "rb") as done:
                    os.fsync(done.fileno())
            files.move(passing, target)
        except BaseException:
            if files.get_file_info(passing).type == fs.FileType.File:
                files.delete_file(passing)
            raise

    def _name(self, written: list[Part]) -> None:
        """The manifest, a line of it a partition with rows; without any, an empty document. Parts of a former export go after it is written."""
        files, folder = place_of(self.folder)
        files.create_dir(folder, recursive=True)
        if not written:
            written = [Part(0, f"{self.stamp}-empty.json", 0)]
            self._document([], posixpath.join(self.path, written[0].name))
        passing = posixpath.join(folder, f".writing-{self.stamp}")
        with files.open_output_stream(passing) as out:
            out.write(json.dumps({"parts": [{"name": p.name, "rows": p.rows} for p in written], "rows": sum(p.rows for p in written)}).encode())
        files.move(passing, posixpath.join(folder, MANIFEST))
        kept = {p.name for p in written}
        self._delete(lambda name: PART.match(name) and name not in kept)


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "row string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        if len(schema) != 1:
            raise ValueError("a document takes one column of text")
        return DocumentWriter(self.options)
