"""Cutting lineage where loops or several readers need a table to stand still."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []
_NAMED: list[tuple[SparkSession, str]] = []


@atexit.register
def _delete_all() -> None:
    """Results may read such a table long after the call that made it, so they go when the program ends."""
    while _NAMED:
        spark, name = _NAMED.pop()
        with contextlib.suppress(Exception):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    while _MADE:
        spark, path = _MADE.pop()
        with contextlib.suppress(Exception):  # the session may be gone by then
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees; where it is unset (tests), a temporary one of a local master."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = context._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(frame: DataFrame) -> DataFrame:
    """The frame as a table of the shared folder: lost executors don't take it away, and later plans read only the columns they need.

    Its joins are dealt over tasks unless they say F.broadcast: the files' size tells little of the rows' in memory, as names that repeat
    take next to nothing in files, and what Spark broadcasts for small files can be more than the driver holds.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path).hint("merge")


def dealt(frame: DataFrame, *key: str, once: bool = True, sorts: bool = True) -> DataFrame:
    """The frame's distinct rows as such a table, in buckets of the key: loops join it on the key round by round, and only the other side is shuffled.

    Without `once` rows that are there twice stay, where that costs less than finding them. Without `sorts` the other side has to say how it is
    joined (as dataflow._beside does), or Spark goes by the size of files."""
    spark = frame.sparkSession
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"cut_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    _MADE.append((spark, path))
    _NAMED.append((spark, name))
    rows = frame.repartition(buckets, *key)
    (rows.distinct() if once else rows).write.bucketBy(buckets, *key).format("parquet").option("path", path).saveAsTable(name)
    return spark.table(name).hint("merge") if sorts else spark.table(name)
