"""A token stream as a data source: ``df.write.format("token_stream")`` and ``spark.read.format("token_stream")``."""

from __future__ import annotations

import contextlib
import dataclasses
import json
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST = "metadata.json"
#: Tokens that a partition reads, about.
PARTITION_TOKENS = 4 << 20
#: Tokens that are read at once, at most.
READ_TOKENS = 1 << 18


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: one without is a path of the session's own file system, wherever that is."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jpath).toString()


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path. A path without a scheme is refused: a worker would take it for one of its own machine."""
    if ":/" not in uri:
        raise ValueError(f"{uri!r} names no file system: give a URI, as token_source.qualified() makes of a path")
    if uri.startswith(("s3a:", "s3n:")):
        uri = "s3" + uri[3:]
    store, root = fs.FileSystem.from_uri(uri)
    return store, root.rstrip("/")


def width_of(vocabulary: int) -> str:
    """The least unsigned integer type that holds every id."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def read_manifest(uri: str) -> dict:
    store, root = opened(uri)
    with store.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclasses.dataclass
class Part(WriterCommitMessage):
    """What a task wrote."""

    number: int
    file: str
    docs: int
    tokens: int


class Writer(DataSourceArrowWriter):
    """A file for each task, under a name that no other attempt has. The manifest, which comes last, names those that count."""

    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.overwrite = options["path"], overwrite
        self.vocabulary = int(options["vocabulary"])
        self.end = int(options["end"]) if options.get("end") not in (None, "") else None

    def write(self, batches) -> Part:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        name = f"part-{number:05d}-{uuid.uuid4().hex}.bin"
        store, root = opened(self.uri)
        store.create_dir(root, recursive=True)
        docs = tokens = 0
        try:
            with store.open_output_stream(f"{root}/{name}") as out:
                for batch in batches:
                    ids = self.joined(batch.column(batch.schema.get_field_index("ids")))
                    if len(ids) and (ids.min() < 0 or ids.max() >= self.vocabulary):
                        raise ValueError(f"an id lies outside the vocabulary of {self.vocabulary}")
                    out.write(ids.astype(width_of(self.vocabulary)).tobytes())
                    docs, tokens = docs + batch.num_rows, tokens + len(ids)
        except BaseException:
            store.delete_file(f"{root}/{name}")
            raise
        return Part(number, name, docs, tokens)

    def joined(self, lists: pa.Array) -> np.ndarray:
        """The ids of all documents of a batch, each followed by the end id. A null document is empty."""
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if self.end is None:
            return ids
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return np.insert(ids, np.cumsum(lengths), self.end)

    def commit(self, messages) -> None:
        store, root = opened(self.uri)
        store.create_dir(root, recursive=True)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        old = []
        with contextlib.suppress(FileNotFoundError):
            old = [p["file"] for p in read_manifest(self.uri)["parts"]]
        if old and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.uri} holds a stream already")
        manifest = {
            "dtype": width_of(self.vocabulary), "vocabulary": self.vocabulary, "docs": sum(p.docs for p in parts), "tokens": sum(p.tokens for p in parts),
            "parts": [{"file": p.file, "docs": p.docs, "tokens": p.tokens} for p in parts],
        }
        fresh = f"{root}/{MANIFEST}.{uuid.uuid4().hex}"
        with store.open_output_stream(fresh) as out:
            out.write(json.dumps(manifest).encode())
        store.move(fresh, f"{root}/{MANIFEST}")
        for name in old:
            store.delete_file(f"{root}/{name}")

    def abort(self, messages) -> None:
        store, root = opened(self.uri)
        for m in messages:
            if m is not None:
                with contextlib.suppress(OSError):
                    store.delete_file(f"{root}/{m.file}")


@dataclasses.dataclass
class Run(InputPartition):
    """Tokens from ``first`` up to ``last`` of the stream."""

    first: int
    last: int


class Reader(DataSourceReader):
    """Runs of whole blocks; a run goes on from file to file, so blocks that lie across files need no join."""

    def __init__(self, options: dict):
        self.uri, self.block = options["path"], int(options.get("block", 1024))
        self.run = max(1, int(options.get("partitiontokens", PARTITION_TOKENS)) // self.block) * self.block
        self.manifest = read_manifest(self.uri)

    def partitions(self) -> list[Run]:
        tokens = self.manifest["tokens"]
        return [Run(at, min(at + self.run, tokens)) for at in range(0, tokens, self.run)] or [Run(0, 0)]

    def pieces(self, first: int, last: int):
        """The tokens of a run in arrays of ``READ_TOKENS`` at most."""
        store, root = opened(self.uri)
        kind, base = np.dtype(self.manifest["dtype"]), 0
        for part in self.manifest["parts"]:
            low, high = max(first, base), min(last, base + part["tokens"])
            if low < high:
                with store.open_input_file(f"{root}/{part['file']}") as f:
                    f.seek((low - base) * kind.itemsize)
                    while low < high:
                        ids = np.frombuffer(f.read(min(high - low, READ_TOKENS) * kind.itemsize), kind)
                        if not len(ids):
                            raise ValueError(f"{part['file']} is shorter than the manifest says")
                        if int(ids.max()) >= self.manifest["vocabulary"]:
                            raise ValueError(f"{self.uri}: id {int(ids.max())} lies outside the vocabulary of {self.manifest['vocabulary']}")
                        yield ids
                        low += len(ids)
            base += part["tokens"]

    def read(self, run: Run):
        start, rest = run.first, np.empty(0, dtype=np.int64)
        for ids in self.pieces(run.first, run.last):
            rest = np.concatenate([rest, ids.astype(np.int64)])
            whole = len(rest) // self.block * self.block
            if whole:
                yield self.blocks(start, rest[:whole])
                start, rest = start + whole, rest[whole:]
        if len(rest):
            yield self.blocks(start, rest)

    def blocks(self, start: int, ids: np.ndarray) -> pa.RecordBatch:
        ends = np.append(np.arange(0, len(ids), self.block), len(ids)).astype(np.int32)
        return pa.record_batch([pa.array(start + ends[:-1].astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["start", "ids"])


class TokenStream(DataSource):
    """Ids as little-endian 16- or 32-bit numbers in files, with a manifest of type, vocabulary and files in order.

    To write (any columns, of which ``ids`` counts, in the order of partitions and rows): options ``path`` (a URI),
    ``vocabulary`` and ``end`` (an id after each document; without it none). A task that fails or runs twice
    leaves a file that no manifest names, and a folder without a manifest is no stream. Mode
    ``append`` writes a new stream only; ``overwrite`` puts the new manifest in place of the old one and then removes the old files.

    To read (start, ids): ``path``, ``block`` (1024), ``partitionTokens``. The last block may be short.
    """

    @classmethod
    def name(cls) -> str:
        return "token_stream"

    def schema(self) -> str:
        return "start long, ids array<long>"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)

    def reader(self, schema) -> Reader:
        return Reader(self.options)
