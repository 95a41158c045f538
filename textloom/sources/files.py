"""Files as rows: their hash and whether they look whole, from their ends alone."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .token_source import opened

#: Bytes of a file's beginning that its hash covers, and of its two ends that must hold something.
HASHED, ENDS = 1_000_000, 100


def files_seen(spark: SparkSession, path: str, least_bytes: int = 1_000_000) -> DataFrame:
    """file, bytes, sha256 (of the first ``HASHED`` bytes), problem (missing, too_small, blank_ends or null) for each file of a path or pattern.

    Spark lists the files, and tasks read their beginnings and ends only, however long
    they are: a file is too small under ``least_bytes``, and blank where its first or last ``ENDS`` bytes are white space. A file that goes
    after it was listed is missing or left out. Spark doesn't list empty files. Files must lie where workers can open them (a scheme that ``token_source.opened`` knows).
    """

    def look(batches):
        for b in batches:
            out = []
            for file, size in zip(b.column("file").to_pylist(), b.column("bytes").to_pylist()):
                try:
                    store, root = opened(file)
                    with store.open_input_file(root) as f:
                        head = f.read(min(size, HASHED))
                        f.seek(max(0, size - ENDS))
                        tail = f.read(ENDS)
                except FileNotFoundError:
                    out.append((None, "missing"))
                    continue
                blank = not head[:ENDS].strip() or not tail.strip()
                out.append((hashlib.sha256(head).hexdigest(), "too_small" if size < least_bytes else "blank_ends" if blank else None))
            hashes, problems = zip(*out) if out else ((), ())
            yield pa.record_batch([b.column("file"), b.column("bytes"), pa.array(hashes, pa.string()), pa.array(problems, pa.string())], names=["file", "bytes", "sha256", "problem"])

    listed = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(path).selectExpr("path AS file", "length AS bytes")  # contents aren't asked for, so none are read
    return listed.mapInArrow(look, "file string, bytes long, sha256 string, problem string")


def whole_files(spark: SparkSession, path: str, least_bytes: int = 1_000_000) -> DataFrame:
    """The files without a problem."""
    return files_seen(spark, path, least_bytes).filter("problem IS NULL").drop("problem")
