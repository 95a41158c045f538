"""Splitting, deduplicating and keeping records by their ids."""

from __future__ import annotations

import bisect
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.counting import few_batches


def packed_runs(parts: list[str], gap: str, most: int) -> list[str]:
    """The longest runs of parts that, with gaps between them, fit into ``most`` characters; a part that doesn't is a run by itself.

    Where each run ends is looked up among the running lengths. Empty parts at a run's beginning take no room.
    """
    ends = [0, *itertools.accumulate(len(p) + len(gap) for p in parts)]
    out, start = [], 0
    while start < len(parts):
        if parts[start]:
            end = max(start + 1, bisect.bisect_right(ends, ends[start] + most + len(gap)) - 1)
            out.append(gap.join(parts[start:end]).strip())
        else:
            end = start + 1
        start = end
    return [x for x in out if x]


def split_text(text: str, most: int) -> list[str]:
    """Runs of paragraphs; what is too long still in runs of sentences."""
    if len(text) <= most:
        return [text]
    runs = packed_runs(text.split("\n\n"), "\n\n", most)
    pieces = [[run] if len(run) <= most else packed_runs(re.split(r"(?<=[.!?])\s+", run), " ", most) for run in runs]
    return list(itertools.chain.from_iterable(pieces)) or [text]


def split_documents(df: DataFrame, most: int) -> DataFrame:
    """seq, part, text: long texts in parts; those that fit never leave the JVM's batch of one."""

    def run(batches):
        for b in few_batches(batches):
            rows = [(s, i, p) for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, p in enumerate(split_text(t or "", most))]
            columns = zip(*rows) if rows else [()] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.string()])], names=["seq", "part", "text"])

    long = F.length("text") > most
    whole = df.filter(~F.coalesce(long, F.lit(False))).select(F.col("seq").cast("long").alias("seq"), F.lit(0).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.unionByName(df.filter(long).select(F.col("seq").cast("long").alias("seq"), "text").mapInArrow(run, "seq long, part int, text string"))


def first_by_id(df: DataFrame, key: str = "id") -> DataFrame:
    """The first row (by seq) of each id."""
    row = F.min_by(F.struct(*df.columns), "seq").alias("r")
    return df.groupBy(F.col(key).alias("_k")).agg(row).select("r.*")


def last_by_id(df: DataFrame, key: str = "id") -> DataFrame:
    """The last row (by seq) of each id: what a later result replaces is gone."""
    row = F.max_by(F.struct(*df.columns), "seq").alias("r")
    return df.groupBy(F.col(key).alias("_k")).agg(row).select("r.*")


def licensed(df: DataFrame, field: str, values: list[str]) -> DataFrame:
    """Rows with a permitted license; one that isn't named is not."""
    return df.filter(F.coalesce(F.col(field).isin(values), F.lit(False)))


def tail_split(df: DataFrame, fraction: float) -> DataFrame:
    """split: the last ``fraction`` of positions is val."""
    total = F.broadcast(df.agg((F.max("pos") + 1).alias("_n")))
    return df.join(total).withColumn("split", F.when(F.col("pos") >= F.floor(F.col("_n") * (1 - fraction)), "val").otherwise("train")).drop("_n")
