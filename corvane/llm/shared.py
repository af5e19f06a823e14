"""What the operators of this subpackage have in common: the shared folder, Arrow batches, keyed folds and word hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that Python handles at a time; bounds a batch of long texts together with BATCH_BYTES.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: Entries of a worker's word cache; beyond that it starts anew, so memory stays bounded on any corpus.
CACHE_ENTRIES = 400_000


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


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration() if spark._jsc is None else spark._jsc.hadoopConfiguration()).delete(place, True)


_OPEN: list = []


@atexit.register
def _close_all() -> None:
    """Results are read after the call that made their tables, so what a call leaves goes when the driver program ends."""
    while _OPEN:
        spark, folder = _OPEN.pop()
        with contextlib.suppress(Exception):  # the session may be gone by then
            _delete(spark, folder)


class Scratch:
    """Tables of one call in the shared folder. They cut lineage and outlive lost executors. What a result needs no more is dropped at once, the rest when the program ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.kept: list[DataFrame] = []
        _OPEN.append((spark, self.folder))

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.folder}/{self.n:03d}-{name}"

    def keep(self, frame: DataFrame, name: str, **options) -> DataFrame:
        """Writes the frame as Parquet and reads it again."""
        path = self.path(name)
        frame.write.options(**options).parquet(path)
        back = self.spark.read.schema(frame.schema).parquet(path)
        back._scratch_path = path
        self.kept.append(back)
        return back

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            _delete(self.spark, frame._scratch_path)
        self.kept = [x for x in self.kept if not any(x is y for y in frames)]

    def drop_others(self, *needed: DataFrame) -> None:
        """All that a result doesn't read."""
        self.drop(*[x for x in self.kept if not any(x is y for y in needed)])


def files_of(folder: str) -> list[str]:
    """The Parquet files of a kept table, for workers that read it themselves."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    return sorted(f"{folder}/{f.base_name}" for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".parquet"))


def trim_memory() -> None:
    """Hands freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def split_batches(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Smaller batches: of at most so many rows, and of about so many bytes unless one row is larger. After the last, a worker that waits for its next task gives back what it needs no more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(rows, int(batch.num_rows * size / max(1, batch.nbytes))))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
        del batch
    trim_memory()


def whole_texts(column: pa.Array) -> pa.Array:
    """The texts as large strings, nulls as empty ones. A slice is copied first: casting a slice and then changing its texts mixes them up."""
    import pyarrow.compute as pc

    return pc.fill_null(column.take(pa.array(np.arange(len(column)))).cast(pa.large_string()), "")


def arrow_schema(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def ddl(schema: str) -> T.StructType:
    return T._parse_datatype_string(schema)


def free_memory() -> None:
    """Hands back to the system what Python and Arrow no longer use."""
    gc.collect()
    trim_memory()


def worker_state(key: tuple, make: Callable):
    """What a Python worker keeps between tasks: one object, of the operator that it runs. Another operator's goes, and its memory with it."""
    if key not in _STATE:
        _STATE.clear()
        free_memory()
        _STATE[key] = make()
    return _STATE[key]


_STATE: dict = {}


def fold(column, modulus: int):
    """crc32 of the key as text, modulo: the same fold in every engine. A null key is an empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (multiply, shift and exclusive-or)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class WordHashes:
    """64-bit hashes of words; frequent ones are remembered."""

    def __init__(self, seed: int = 0):
        self.seed, self.known = seed, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        known = self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > CACHE_ENTRIES:
                known.clear()
            out = np.empty(len(words), np.uint64)
            for i, w in enumerate(words):
                h = known.get(w)
                if h is None:
                    h = xxh3_64_intdigest(w, self.seed)
                    if len(w) <= 64:
                        known[w] = h
                out[i] = h
            return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed_words(texts: pa.Array, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased (A-Z alone) words, runs of other bytes than ASCII white space, and how many each text has."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(whole_texts(texts)))
    coded = lists.flatten().dictionary_encode()
    words = [w or b"" for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    codes, bounds = coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = np.array([len(w) > 0 for w in words], bool)[codes] if len(codes) else np.zeros(0, bool)
    counts = np.diff(np.concatenate([[0], np.cumsum(real)])[bounds])
    return (hashes(words)[codes][real] if len(codes) else np.zeros(0, np.uint64)), counts
