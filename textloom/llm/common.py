"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import itertools
import tempfile
import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Lower-casing of A-Z only.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class ColumnMissing(ValueError):
    """The input lacks a column that the operator needs."""


def _slot(df: DataFrame, name: str) -> int:
    exact = [i for i, c in enumerate(df.columns) if c == name]
    loose = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not exact and len(loose) != 1:
        raise ColumnMissing(f"no column {name!r} among {df.columns}")
    return (exact or loose)[0]


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast to the given types, whatever else the input holds.

    Other columns may have any names, even ones that differ from a needed
    column in case only: an exact match wins over such a twin.
    """
    renamed = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return renamed.select(*[F.col(f"_{_slot(df, name)}").cast(kind).alias(name) for name, kind in columns.items()])


class Whole:
    """Rows with all their columns out of the way, as _0, _1 ..., and the named ones beside them."""

    def __init__(self, df: DataFrame, **columns: str):
        self.names = df.columns
        self.slots = [f"_{i}" for i in range(len(self.names))]
        self.at = {name: f"_{_slot(df, name)}" for name in columns}
        renamed = df.toDF(*self.slots)
        self.rows = renamed.select("*", *[F.col(self.at[name]).cast(kind).alias(name) for name, kind in columns.items()])

    def back(self, rows: DataFrame, **new) -> DataFrame:
        """The columns as they were; ``new`` replaces some."""
        by_slot = {self.at[name]: value for name, value in new.items()}
        return rows.select(*[by_slot.get(s, F.col(s)).alias(s) for s in self.slots]).toDF(*self.names)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; one of our own only where none is set and all runs on one machine, as in tests."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
        spark.conf.set("spark.checkpoint.dir", given)
        atexit.register(_forget, spark, given)
    return given.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session has ended: nothing can be removed any more
        pass


def delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A lost executor costs a re-read of these files, never a recomputation of
    what came before them. ``drop`` removes a table that nothing reads any
    more; what is left goes with the session.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/textloom-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.count = itertools.count()
        atexit.register(_forget, spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{next(self.count)}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            delete(self.spark, self.paths.pop(id(f)))


#: Rows of a table of keys that may be broadcast, whatever the size of the corpus.
BROADCAST_ROWS = 100_000


def by_hot_and_cold(rows: DataFrame, groups: DataFrame, key: str, size: str, share: int = 1000) -> DataFrame:
    """``rows`` joined with the row of ``groups`` that has their key, hot keys apart.

    ``groups`` has a row for each key with the number of rows that hold it
    (``size``). Keys held by more than 1/``share`` of all rows number less than
    ``share``, so the rows of those are joined by broadcast where they lie;
    the others meet in a sort-merge join. Both inputs are read twice and
    should be written tables.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = max(100, total // share)
    hot = F.broadcast(groups.filter(F.col(size) > least))
    cold = rows.join(hot.select(key), key, "left_anti")
    return cold.join(groups.filter(F.col(size) <= least).hint("merge"), key).unionByName(rows.join(hot, key))


def raw_bytes(column: pa.Array) -> list:
    """A string column as bytes (None for null), without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def lean(work):
    """``work`` on Arrow batches; the worker, which is used again for other tasks, gives back the memory that it took."""

    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # a C library without it
            pass

    return run


class WordHashes(dict):
    """word -> 64-bit hash, remembered; emptied before it grows beyond ``most`` words."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hashed_words(words: list, table: WordHashes):
    """The words' hashes as a numpy array."""
    import numpy as np

    return np.fromiter(map(table.__getitem__, words), dtype=np.uint64, count=len(words))


def window_hashes(h, width: int):
    """A 64-bit hash of each run of ``width`` word hashes."""
    import numpy as np

    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, 0x9E3779B97F4A7C15, dtype=np.uint64)
    for k in range(width):
        out ^= h[k : k + n]
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out
