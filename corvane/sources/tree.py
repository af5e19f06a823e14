"""A source tree as a table, listed, pruned and read by tasks (`listed`, `contents`, `read_tree`).

Spark's own `binaryFile` leaves out names that start with `_` or `.`, so it can't stand in here. The tree must lie in a folder that all
executors see. Folders are a frontier: in a round, tasks list those of the round before, each going on below its own until it has met enough
entries, so a small tree is one round and a large one is spread; budgets are sums of slices in path order. The driver holds counts only.
The data source `source_tree` gives the same rows to SQL, for trees whose listing fits the driver. Options: path; repository (a name for the rows; the folder's own without it); exclude (globs, separated by line ends);
hidden, vendor, generated ("true" to take them); max_files; max_bytes (of a file); max_total_bytes; max_depth; partitions. Symbolic links
are never followed; nested repositories and version-control folders are left out.

Nothing that is listed vanishes: a file that is not read has a row whose state says why (too-large, over-budget, over-limit, unsafe-path,
unreadable). Sizes are tested one by one before the total, so a file that is too large takes nothing from it.
"""

from __future__ import annotations

import hashlib
import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.functions import classify
from corvane.operators import windows
from corvane.operators.lineage import cut

SCHEMA = "repository string, path string, size_bytes long, state string, sha256 string, content binary"
VERSION_CONTROL = {".git", ".hg", ".svn"}
MAX_GLOBS, MAX_GLOB_BYTES = 256, 1024
MOST_TASKS, BATCH_BYTES = 20_000, 16 << 20
UNSAFE = re.compile(r"[\\\x00-\x1f\x7f]|^[A-Za-z]:|[\ud800-\udfff]")


def glob_pattern(glob: str) -> str:
    """A glob as an anchored pattern: `*` and `?` stay within a part, `**` crosses parts; one without a slash matches at any depth."""
    if not glob or len(glob.encode()) > MAX_GLOB_BYTES or ".." in glob.split("/"):
        raise ValueError(f"not a usable glob: {glob!r}")
    out, at = "", 0
    while at < len(glob):
        if glob.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif glob.startswith("**", at):
            out, at = out + ".*", at + 2
        else:
            out, at = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[at], re.escape(glob[at])), at + 1
    return f"^(?:.*/)?{out}$" if "/" not in glob else f"^{out}$"


def matches_any(path, globs: list[str]):
    """A column: whether the path matches one of the globs."""
    if len(globs) > MAX_GLOBS:
        raise ValueError("too many globs")
    return path.rlike("|".join(map(glob_pattern, globs))) if globs else F.lit(False)


@dataclass
class Files(InputPartition):
    names: list


class Rules:
    """What of a tree is left out."""

    def __init__(self, options: dict):
        self.patterns = [re.compile(glob_pattern(g)) for g in (options.get("exclude") or "").split("\n") if g]
        if len(self.patterns) > MAX_GLOBS:
            raise ValueError("too many globs")
        self.takes = {x: options.get(x, "false").lower() == "true" for x in ("hidden", "vendor", "generated")}
        self.limit, self.depth = int(options.get("max_bytes", 1 << 20)), int(options.get("max_depth", 1 << 30))

    def reason(self, path: str, name: str, folder: str | None) -> str | None:
        """Why an entry is left out; folder: where it is, if it is one."""
        if any(p.search(path) for p in self.patterns):
            return "excluded-by-config"
        if folder:
            if name in VERSION_CONTROL:
                return "version-control"
            if not self.takes["vendor"] and name.lower() in classify.VENDOR:
                return "vendor"
            if not self.takes["generated"] and name.lower() in classify.GENERATED:
                return "generated"
            if os.path.exists(os.path.join(folder, ".git")):
                return "nested-repository"
        return "hidden" if name.startswith(".") and not self.takes["hidden"] else None

    def entries(self, root: str, prefix: str, level: int) -> Iterator[tuple[str, str, int]]:
        """(path, state, size) of a folder's entries: state is `folder`, a file's state, or `pruned:` and why."""
        with os.scandir(os.path.join(root, prefix) if prefix else root) as found:
            for entry in found:
                path = prefix + entry.name
                inside = entry.is_dir(follow_symlinks=False)
                why = "symbolic-link" if entry.is_symlink() else self.reason(path, entry.name, entry.path if inside else None) or ("depth" if inside and level >= self.depth else None)
                if why:
                    yield path, f"pruned:{why}", 0
                elif inside:
                    yield path, "folder", 0
                elif entry.is_file(follow_symlinks=False):
                    size = entry.stat(follow_symlinks=False).st_size
                    yield path, "unsafe-path" if UNSAFE.search(path) else "too-large" if size > self.limit else "listed", size


def _bytes(path: str) -> bytes:
    return path.encode("utf-8", "surrogateescape")


def _text(path: bytes) -> str:
    return path.decode("utf-8", "replace")


def listing(root: str, options: dict) -> tuple[list[tuple[str, int, str]], dict[str, int]]:
    """(path, size, state) in path order, and what was pruned by reason; all on the driver."""
    rules, pruned, found, folders = Rules(options), {}, [], [("", 1)]
    while folders:
        prefix, level = folders.pop()
        for path, state, size in rules.entries(root, prefix, level):
            if state == "folder":
                folders.append((f"{path}/", level + 1))
            elif state.startswith("pruned:"):
                pruned[state[7:]] = pruned.get(state[7:], 0) + 1
            else:
                found.append((path, size, state))
    return _admitted(sorted(found, key=lambda f: _bytes(f[0])), options), pruned


#: Entries that a task meets before it hands the folders left to the next round, and files a task reads.
ENTRIES_A_TASK, FILES_A_TASK = 20_000, 100
ENTRY = "place binary, state string, size_bytes long, level int"


def _walk(root: str, options: dict, most: int):
    """A task of a round: lists its folders, and those below, until it has met `most` entries; folders that are left are rows."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, met, rows = Rules(options), 0, []
        kind = pa.schema([("place", pa.binary()), ("state", pa.string()), ("size_bytes", pa.int64()), ("level", pa.int32())])

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], kind)
            rows.clear()
            return out

        for given in batches:
            folders = [(p.decode("utf-8", "surrogateescape"), n) for p, n in zip(given["place"].to_pylist(), given["level"].to_pylist(), strict=True)]
            first = len(folders)  # those given are listed in any case, so every round goes on
            while folders:
                prefix, level = folders.pop()
                own = len(folders) < first
                first = min(first, len(folders))
                if not own and met >= most:
                    rows.append((_bytes(prefix), "folder", 0, level))
                    continue
                try:
                    for path, state, size in rules.entries(root, prefix, level):
                        met += 1
                        if state == "folder":
                            folders.append((f"{path}/", level + 1))
                        else:
                            rows.append((_bytes(path), state, size, level))
                        if len(rows) >= 10_000:
                            yield batch()
                except FileNotFoundError:
                    if not prefix:
                        raise  # the root itself; a folder that went while the tree was listed has no files
        yield batch()

    return walk


def listed(spark: SparkSession, path: str, options: dict, entries_a_task: int = ENTRIES_A_TASK) -> tuple[DataFrame, dict[str, int]]:
    """((place, state, size_bytes): a row a file, its path as bytes; what was pruned by reason).

    As many rounds as it takes to go through the tree, a table a round; what a round lists is dealt by size to the tasks of the next.
    """
    Rules(options)  # faults of the options are the caller's, not a task's
    frontier, rounds, walk = spark.createDataFrame([(bytearray(), 1)], "place binary, level int"), [], _walk(path, options, entries_a_task)
    while True:
        met = cut(frontier.mapInArrow(walk, ENTRY))
        rounds.append(met)
        left = met.filter("state = 'folder'").count()
        if not left:
            break
        frontier = met.filter("state = 'folder'").select("place", "level").repartition(min(left, MOST_TASKS))
    every = reduce(DataFrame.unionByName, rounds)
    pruned = {r.why: r["count"] for r in every.filter("state LIKE 'pruned:%'").groupBy(F.substring("state", 8, 64).alias("why")).count().collect()}
    return admitted(every.filter("state <> 'folder' AND state NOT LIKE 'pruned:%'").select("place", "state", "size_bytes"), options), pruned


def admitted(files: DataFrame, options: dict) -> DataFrame:
    """In the order of places: the first max_files, and of these what fits the total; from the first that doesn't, none. Only a tree that is over a limit is sorted."""
    most, budget = int(options.get("max_files", 1_000_000)), int(options.get("max_total_bytes", 16 << 40))
    size = F.when(F.col("state") == "listed", F.col("size_bytes")).otherwise(0)
    n, total = files.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if n <= most and total <= budget:
        return files
    placed = windows.running_totals(files, ["place"], {"__n": F.lit(1), "__total": size})  # sums only grow
    state = F.when(F.col("__n") > most, "over-limit").when((F.col("state") == "listed") & (F.col("__total") > budget), "over-budget").otherwise(F.col("state"))
    return placed.select("place", state.alias("state"), "size_bytes")


def _admitted(found: list[tuple[str, int, str]], options: dict) -> list[tuple[str, int, str]]:
    """In path order: the first max_files, and of these what fits the total; from the first that doesn't, none."""
    files, budget, total, spent = int(options.get("max_files", 1_000_000)), int(options.get("max_total_bytes", 16 << 40)), 0, False
    out = []
    for i, (path, size, state) in enumerate(found):
        if i >= files:
            state = "over-limit"
        elif state == "listed":
            spent = spent or total + size > budget
            total += 0 if spent else size
            state = "over-budget" if spent else state
        out.append((path, size, state))
    return out


def open_inside(root: str, path: str) -> int:
    """A file below the root, opened part by part, so that no part of its path is a link by now."""
    within = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
    try:
        *folders, name = path.split("/")
        for folder in folders:
            below = os.open(folder, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=within)
            os.close(within)
            within = below
        return os.open(name, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK, dir_fd=within)
    finally:
        os.close(within)


def content_of(root: str, path: str, state: str, limit: int) -> tuple[str, bytes | None]:
    """(state, content) of a file that was listed; one that grew since, or is no regular file by now, has none."""
    if state != "listed":
        return state, None
    try:
        with os.fdopen(open_inside(root, path), "rb") as file:
            if not stat.S_ISREG(os.fstat(file.fileno()).st_mode):
                return "unreadable", None
            content = file.read(limit + 1)
    except OSError:
        return "unreadable", None
    return (state, content) if len(content) <= limit else ("too-large", None)


def contents(files: DataFrame, root: str, options: dict) -> DataFrame:
    """Rows of SCHEMA for what `listed` gave: read by tasks of about a hundred files each, in batches of bounded bytes."""
    name, limit = options.get("repository") or os.path.basename(os.path.abspath(root)), int(options.get("max_bytes", 1 << 20))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("repository", pa.string()), ("path", pa.string()), ("size_bytes", pa.int64()), ("state", pa.string()), ("sha256", pa.string()), ("content", pa.binary())])
        rows, held = [], 0
        for given in batches:
            for place, state, size in zip(*(given[c].to_pylist() for c in ("place", "state", "size_bytes")), strict=True):
                state, content = content_of(root, place.decode("utf-8", "surrogateescape"), state, limit)
                rows.append((name, _text(place), size, state, hashlib.sha256(content).hexdigest() if content is not None else None, content))
                held += len(content or b"")
                if held >= BATCH_BYTES or len(rows) >= 1000:
                    yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], kind)
                    rows, held = [], 0
        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], kind)

    wanted = int(options.get("partitions") or min(max(files.count() // FILES_A_TASK, 1), MOST_TASKS))
    return files.repartition(wanted).mapInArrow(read, SCHEMA)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.root = dict(options), options["path"]

    def partitions(self) -> list:
        found, _ = listing(self.root, self.options)
        wanted = int(self.options.get("partitions") or min(max(len(found) // FILES_A_TASK, 1), MOST_TASKS))
        n = max(1, min(wanted, len(found)))
        return [Files(found[k::n]) for k in range(n)]

    def read(self, partition: Files):
        name, limit = self.options.get("repository") or os.path.basename(os.path.abspath(self.root)), int(self.options.get("max_bytes", 1 << 20))
        for path, size, state in partition.names:
            state, content = content_of(self.root, path, state, limit)
            yield name, _text(_bytes(path)), size, state, hashlib.sha256(content).hexdigest() if content is not None else None, content


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def as_options(options: dict) -> dict:
    """Options as Spark's readers take them: texts."""
    return {key: str(value).lower() if isinstance(value, bool) else str(value) for key, value in options.items()}


def read_tree(spark: SparkSession, path: str, **options) -> DataFrame:
    """The tree's files, listed and read by tasks."""
    options = as_options(options)
    return contents(listed(spark, path, options)[0], path, options)


def inventory(files: DataFrame) -> DataFrame:
    """The files' classes, with the language of parsers; binary ones by content."""
    path, binary = F.col("path"), F.coalesce(classify.is_binary(F.col("content")), F.lit(False))
    return files.select(
        "path", "size_bytes", "state", F.col("sha256").alias("content_fingerprint"), classify.file_kind(path, binary).alias("kind"), classify.language(path).alias("language"),
        classify.origin(path).alias("origin"), binary.alias("is_binary"), classify.manifest_kind(path).alias("manifest"), classify.entry_point(path).alias("entry_point"), classify.parser_mode(path).alias("parser"),
    )


def cache_key(version: str):
    """What a file's records depend on: the scanner's version, the path (its language comes from it) and the content."""
    return F.sha2(F.concat_ws("\x00", F.lit(version), "path", "sha256"), 256)


def cache_misses(files: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Files whose (path, content, version) key the parse cache lacks."""
    return files.withColumn("cache_key", cache_key(version)).join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def kept_reports(reports: DataFrame, keep: int) -> DataFrame:
    """History: the newest reports by (saved_at, scan_id) of each repository."""
    order = Window.partitionBy("repository").orderBy(F.desc("saved_at"), F.desc("scan_id"))
    return reports.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= keep).drop("__n")
