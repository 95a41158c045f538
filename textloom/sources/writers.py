"""Sinks; every one is a plain Spark writer, so files commit whole or not at all."""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


EXPORTERS: dict[str, Callable[[DataFrame, str], None]] = {"jsonl": jsonl, "parquet": parquet, "csv": csv}


def export(df: DataFrame, fmt: str, path: str) -> None:
    if fmt not in EXPORTERS:
        raise ValueError(f"no exporter {fmt!r}")
    EXPORTERS[fmt](df, path)


def sharded_jsonl(df: DataFrame, path: str) -> None:
    """A folder for each shard; a shard's rows are written by pos."""
    df.repartition("shard").sortWithinPartitions("shard", "pos").write.mode("overwrite").partitionBy("shard").json(path)


def by_column(df: DataFrame, column: str, path: str) -> None:
    df.write.mode("overwrite").partitionBy(column).json(path)


def by_column_and_merged(df: DataFrame, column: str, path: str) -> None:
    """A folder for each value under ``by``, and all rows, with the column, under ``merged``."""
    by_column(df, column, f"{path}/by")
    jsonl(df, f"{path}/merged")


def metric_log(rows: DataFrame, path: str) -> None:
    """(step, metric, value) added to a log of CSV files, each with a header; what was there stays."""
    rows.select("step", "metric", "value").write.mode("append").option("header", "true").option("escape", "\"").csv(path)


def tokenizer_text(df: DataFrame, path: str) -> None:
    """Stripped texts, one after another; a text with line breaks takes several lines."""
    df.select(tx.strip(F.col("text")).alias("value")).write.mode("overwrite").text(path)


def split_by(df: DataFrame, kept: str, path: str) -> None:
    """Rows that ``kept`` names and the rest in folders of their own; a second run adds to both."""
    df.withColumn("part", F.when(F.expr(kept), "verified").otherwise("rejected")).write.mode("append").partitionBy("part").json(path)


def token_stream(tokens: DataFrame, path: str, end: int, wide: bool = False) -> dict:
    """One binary row for each document of (seq, ids): little-endian 16- or 32-bit ids and then ``end``; in order by seq."""
    code = "I" if wide else "H"

    def pack(frames):
        for f in frames:
            f["data"] = [struct.pack(f"<{len(x) + 1}{code}", *x, end) for x in f["ids"]]
            yield f[["seq", "data"]]

    tokens.select("seq", "ids").orderBy("seq").mapInPandas(pack, "seq long, data binary").write.mode("overwrite").parquet(path)
    n, docs = tokens.agg(F.sum(F.size("ids") + 1), F.count("*")).first()
    return {"dtype": "uint32" if wide else "uint16", "total_tokens": n or 0, "documents": docs}
