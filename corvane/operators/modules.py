"""Where an import leads: module specifiers against the paths of a repository, as equality joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import normalize_path

#: Extensions that a specifier leaves out or names, and prefixes that stand for a repository's own root.
EXTENSIONS = ["js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts"]
ROOTS = ["@/", "~/"]
_EXTENSION = r"\.(?:" + "|".join(EXTENSIONS) + ")$"


def module_key(path: Column) -> Column:
    """A path without its extension, and without `/index`."""
    return F.regexp_replace(F.regexp_replace(path, _EXTENSION, ""), "(^|/)index$", "")


def relative_key(path: Column, module: Column) -> Column:
    """The key that a relative specifier of a file means; null for others and for those that climb out of the repository."""
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    return F.when(module.rlike(r"^\.{1,2}(/|$)"), module_key(normalize_path(F.concat_ws("/", F.when(folder != "", folder), module))))


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (repository, path, module), files (repository, path) -> repository, path, module, module_path: a row a file that the specifier may mean."""
    keyed = files.select("repository", F.col("path").alias("module_path"), module_key(F.col("path")).alias("key"))
    relative = imports.withColumn("key", relative_key(F.col("path"), F.col("module"))).filter("key IS NOT NULL").join(keyed, ["repository", "key"])
    # A root prefix means any folder: what is behind it equals a file's key or its end.
    parts = F.split("key", "/")
    ends = keyed.select("repository", "module_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("key"))
    rooted = imports.filter(F.col("module").rlike("^[@~]/")).withColumn("key", module_key(F.substring("module", 3, 1 << 20))).join(ends, ["repository", "key"])
    return relative.unionByName(rooted).select("repository", "path", "module", "module_path")
